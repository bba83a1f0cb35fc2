"""Byte-level BPE encoding and decoding, with tree concatenation for long texts.

A text of up to ``split`` characters is encoded by its task as it is. A longer one is cut into pieces, which
are written to the shared folder and encoded by any tasks; then pairs of neighbours are joined level by level. A join
re-encodes a window around the seam and widens it until both sides agree with what they had, so the ids are
exactly those of the whole text.

When a side agrees. The splitting pattern makes every text a row of words, each merged on its own. A side agrees at

- a place where white space follows another character: a word ends there whatever surrounds it;
- a token edge well inside a run of one kind of character (letters, digits, white space, other), when the
  window's outermost token is the one the side had. Tokens of a word are its encoding exactly if every two
  neighbours are the encoding of their joint text, and all neighbours then come from a valid encoding;
- the side's own outer end.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.session import settle

SPECIAL = {"<|endoftext|>": 50256}
SPLIT = 32768
#: A token edge counts as well inside a run with so many characters of the run on either side.
INSIDE = 3


class Tokenizer:
    """One vocabulary, as ranks: encoding of a text in one go, decoding, and joining of encodings."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = special
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.length = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        for token, rank in special.items():
            self.length[rank] = len(token.encode())
        n = 2 * INSIDE
        self.run = regex.compile(rf"\p{{L}}{{{n}}}|\p{{N}}{{{n}}}|\s{{{n}}}|[^\s\p{{L}}\p{{N}}]{{{n}}}")

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", errors="replace")

    def pieces(self, text: str, split: int) -> list[str]:
        """Equal pieces, a power of two of them, of at most ``split`` characters; no special token is cut."""
        parts = 1 << max(0, math.ceil(math.log2(max(1, len(text)) / split)))
        cuts = [0]
        for i in range(1, parts):
            at = len(text) * i // parts
            for token in self.special:
                start = text.find(token, max(0, at - len(token) + 1), at + len(token) - 1)
                if start >= 0:
                    at = max(at, start + len(token))
            cuts.append(max(at, cuts[-1]))
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def _fits(self, text: bytes, at: int) -> bool:
        """Whether a token edge is well inside a run of one kind."""
        before = text[max(0, at - 4 * INSIDE):at].decode("utf-8", "ignore")[-INSIDE:]
        after = text[at:at + 4 * INSIDE].decode("utf-8", "ignore")[:INSIDE]
        whole = at == len(text) or text[at] & 0xC0 != 0x80
        return whole and self.run.fullmatch(before + after) is not None

    @staticmethod
    def _word_end(text: bytes, at: int) -> bool:
        """Whether ASCII white space follows an ASCII character that is none."""
        space = b" \t\n\r\x0b\x0c"
        return 0 < at < len(text) and text[at] in space and text[at - 1] < 128 and text[at - 1] > 32 and text[at - 1] != 127

    def join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Text and ids of two neighbours as one."""
        (a, x), (b, y) = left, right
        text = a + b
        if not len(x) or not len(y):
            return text, np.concatenate([x, y])
        starts = len(a) - np.cumsum(self.length[x[::-1]])  # of the left tokens, from the last one back
        ends = np.cumsum(self.length[y])
        reach = 16
        while True:
            n, m = min(reach, len(x)), min(reach, len(y))
            # Each side's candidates, the outermost first: (tokens taken, whether the outer token must agree).
            lefts = [(n, False)] if n == len(x) else [
                (k, kind) for k in range(n, n // 2, -1)
                for kind in (False, True) if (self._fits if kind else self._word_end)(a, int(starts[k - 1]))][:1]
            rights = [(m, False)] if m == len(y) else [
                (k, kind) for k in range(m, m // 2, -1)
                for kind in (False, True) if (self._fits if kind else self._word_end)(b, int(ends[k - 1]))][:1]
            if lefts and rights:
                (n, agree_left), (m, agree_right) = lefts[0], rights[0]
                window = np.asarray(self.encode(
                    (a[int(starts[n - 1]):] + b[:int(ends[m - 1])]).decode("utf-8")), dtype=np.int64)
                if not (agree_left and window[0] != x[-n]) and not (agree_right and window[-1] != y[m - 1]):
                    return text, np.concatenate([x[:-n], window, y[m:]])
            reach *= 2

    def join_all(self, nodes: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """Ids of a row of pieces, joined as a binary tree."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0][1]


@functools.lru_cache(maxsize=4)
def tokenizer(ranks_path: str, pattern: str, special: tuple) -> Tokenizer:
    return Tokenizer(ranks_path, pattern, dict(special))


def vocabulary(name: str = "byte_bpe_50k.tiktoken", special: dict[str, int] | None = None) -> tuple:
    """Arguments of ``tokenizer`` for an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN, tuple((SPECIAL if special is None else special).items())


IDS = pa.list_(pa.int32())


def _nullable(column: pa.StructArray) -> pa.StructArray:
    """The same rows with all fields nullable, as the result's schema has them."""
    return pa.StructArray.from_arrays(column.flatten(), names=[f.name for f in column.type])


def encode(docs: DataFrame, vocab: tuple, text: str = "text", split: int = SPLIT, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``text``. Null and empty texts have no ids.

    A column named ``ids`` is replaced; all others are carried, the text itself only with ``keep_text``. Rows are
    independent: repeated rows give repeated results, an empty table an empty one.
    """
    docs = docs.drop("ids")
    kept = F.struct(F.lit(None).cast("boolean").alias("_row"), *[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    long = F.char_length(body) > split

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(*vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.asarray(tok.encode(t), dtype=np.int32) for t in part.column("body").to_pylist()]
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), type=pa.int32())
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_nullable(part.column("kept")), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["kept", "ids"])

    fields = docs.select(kept.alias("kept")).schema["kept"].dataType.fields
    kept_type = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    out = T.StructType([T.StructField("kept", kept_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    short = docs.where(~long).select(kept.alias("kept"), body.alias("body")).mapInArrow(encode_rows, out)
    return short.unionByName(_encode_long(docs.where(long).select(kept.alias("kept"), body.alias("body")), vocab, split, out)
                             ).select("kept.*", "ids").drop("_row")


def _encode_long(rows: DataFrame, vocab: tuple, split: int, out) -> DataFrame:
    """Long texts: written as pieces, encoded piece by piece, joined text by text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(*vocab)
        for batch in batches:
            for i, whole in enumerate(batch.column("body").to_pylist()):
                parts = tok.pieces(whole, split)
                first = batch.slice(i, 1)
                one = [0] + [None] * (len(parts) - 1)  # the other columns travel with the first piece
                yield pa.RecordBatch.from_arrays(
                    [first.column("row").take(pa.array([0] * len(parts))), _nullable(first.column("kept")).take(pa.array(one, pa.int32())),
                     pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["row", "kept", "nth", "piece"])

    schema = T.StructType([T.StructField("row", T.LongType()), out["kept"], T.StructField("nth", T.IntegerType()),
                           T.StructField("piece", T.StringType())])
    pieces = settle(
        # Numbered rows are written at once, so no later task sees another numbering.
        rows.withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, schema), "bpe-pieces")

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(*vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                ids = [tok.encode(t) for t in part.column("piece").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, IDS)], [*part.schema.names, "ids"])

    def join(table: pa.Table) -> pa.Table:
        tok = tokenizer(*vocab)
        table = table.sort_by("nth")
        nodes = [(t.encode(), np.asarray(i, dtype=np.int64))
                 for t, i in zip(table.column("piece").to_pylist(), table.column("ids").to_pylist())]
        ids = tok.join_all(nodes)
        return pa.Table.from_arrays([table.column("kept").slice(0, 1), pa.array([ids.astype(np.int32)], IDS)], ["kept", "ids"])

    with_ids = T.StructType([*schema.fields, out["ids"]])
    return pieces.mapInArrow(encode_pieces, with_ids).groupBy("row").applyInArrow(join, out)


def decode(rows: DataFrame, vocab: tuple, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with ``into``, the text of the ids; bytes that are no UTF-8 become U+FFFD, null ids give null."""
    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer(*vocab)
        for column in batches:
            yield column.map(lambda x: None if x is None else tok.decode(x.tolist()))

    return rows.withColumn(into, text_of(F.col(f"`{ids}`")))
