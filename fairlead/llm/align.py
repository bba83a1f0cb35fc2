"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked id pairs.

Tokenizer A is a byte-level BPE as the tokenizers library applies it to ``" " + text``; tokenizer B a sentencepiece model
applied to ``text`` (it adds the space itself). Neither adds special tokens, and their strings inside texts are plain
text. A token's bytes: A's token string through the byte-level alphabet; B's piece in UTF-8 with U+2581 as a space and
``<0xHH>`` as the byte HH. A text is aligned only when both tokens' bytes joined give the bytes of ``" " + text``.

A's vocabulary file is encoded through tiktoken, several times faster, where that gives the library's ids (see
``_mergeable_ranks``); any other file, and texts with very long runs of white space, through the tokenizers library.

Per text, in one Arrow task: byte offsets where an A token and a B token both end cut the tokens into groups; a link is
every pair of an A and a B token occurrence whose byte ranges overlap, found by two searches over the sorted ends.
Links are handed on as (id pair, how often in this text).

Counting (external, spill-bounded): the pair-document records are dealt to partitions by their id pair (the radix of
the packed pair key), combined inside each task first, and counted by Spark's sort-based aggregation, which writes
compressed sorted runs when memory runs short and merges them k-way; no count is held whole in memory. Counts are
then read side-major (by B id) for each B id's largest count. Contributions go back to the records by a join on the
pair: pairs that occur in very many documents (at least 1/2048 of all records, so at most 2,048 of them) are salted
over 32 tasks on both sides, so that no single task gets a hot pair's records.

Results per input row (repeated rows and null ids included, each its own row): doc_id, n_a, n_b, n_groups, n_links,
n_best (links whose pair count is the highest of their B id, ties included), count_sum (pair counts summed over the
links), groups_sha256 (lowercase hex SHA-256 of ``a1,a2|b1;a3|b2,b3``). A null, empty or unaligned text has zeros and
groups_sha256 ''. Other columns pass through; existing columns named like an output column are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.session import drop_folder, fresh_path

OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: Packed pair key: A id times this plus B id.
PACK = 1 << 20
#: Records of a pair at or above this share of all records make it hot; hot pairs are spread over SALTS tasks.
HOT_SHARE, SALTS = 1 / 2048, 32


def byte_alphabet() -> dict[str, int]:
    """The byte-level BPE alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {}, 0
    for b in range(256):
        if b in kept:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return table


class _Pieces:
    """Token bytes of a vocabulary as one byte array with offsets, for checks without a loop over tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def spell(self, ids: np.ndarray, target: np.ndarray) -> bool:
        """Do the tokens' bytes, joined, equal ``target``?"""
        lengths = self.length[ids]
        if lengths.sum() != target.size:
            return False
        before = np.cumsum(lengths) - lengths
        where = np.arange(target.size) + np.repeat(self.offset[ids] - before, lengths)
        return bool(np.array_equal(self.blob[where], target))


#: The words of the library's byte-level splitting.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken gives up on runs of about a million white-space characters; from this length on the library encodes the text.
LONG_SPACE = 100_000


def _mergeable_ranks(a_path: str, a) -> dict[bytes, int] | None:
    """Ranks for tiktoken if it gives the ids of the tokenizers library ``a`` for this vocabulary file, else None.

    tiktoken merges the neighbours whose joined bytes have the lowest id, the library those of the first merge in the
    file. They agree if merges are listed by rising id, every token is a byte or a merge, and the library encodes each
    token as itself: then neighbours that join to a token any other way than by its merge never meet.
    """
    with open(a_path, encoding="utf-8") as lines:
        spec = json.load(lines)
    model, split, alphabet = spec["model"], spec["pre_tokenizer"] or {}, byte_alphabet()
    plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
             and split.get("use_regex", True) and all(t["special"] for t in spec.get("added_tokens") or ())
             and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                "fuse_unk", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocab.get(t, -1) for t in merged]
    if (any(x >= y for x, y in zip(ids, ids[1:])) or vocab.keys() != alphabet.keys() | set(merged)
            or any([p.id for p in a.model.tokenize(t)] != [i] for t, i in vocab.items())):
        return None
    return {bytes(alphabet[ch] for ch in t): i for t, i in vocab.items()}


def _encoder(a_path: str, a) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers library ``a`` gives them, special tokens' strings being plain text."""
    import tiktoken

    def library(text: str) -> list[int]:
        return a.encode(text, add_special_tokens=False).ids

    ranks = _mergeable_ranks(a_path, a)
    if ranks is None:
        return library
    fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in re.finditer(r"\s+", text)):
            return library(text)
        return fast.encode_ordinary(text)

    return encode


@functools.lru_cache(maxsize=4)
def _tokenizers(a_path: str, b_path: str):
    """A's encoder, B's processor and the token bytes of both."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    vocab = a.get_vocab(with_added_tokens=True)
    a_bytes = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        a_bytes[i] = bytes(alphabet[ch] for ch in token) if all(ch in alphabet for ch in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i):
            b_bytes.append(bytes([int(piece[3:5], 16)]))
        elif b.is_control(i) or b.is_unknown(i):
            b_bytes.append(b"")
        else:
            b_bytes.append(piece.replace("\u2581", " ").encode())
    return _encoder(a_path, a), b, _Pieces(a_bytes), _Pieces(b_bytes)


#: Separator bytes after a token: same side of a group, A side to B side, next group, end; 0 is dropped.
_SEPARATORS = np.frombuffer(b",|;\x00", dtype=np.uint8)


def align_ids(text: str | None, a_ids: np.ndarray, b_ids: np.ndarray, a_pieces: _Pieces, b_pieces: _Pieces) -> dict:
    """Groups and links of one text from its two encodings: counts, the groups' digest, (pair key, occurrences)."""
    empty = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "keys": _NONE, "mult": _NONE}
    if not text:
        return empty
    target = np.frombuffer((" " + text).encode(), dtype=np.uint8)
    if not a_pieces.spell(a_ids, target) or not b_pieces.spell(b_ids, target):
        return empty
    a_end, b_end = np.cumsum(a_pieces.length[a_ids]), np.cumsum(b_pieces.length[b_ids])
    a_start, b_start = a_end - a_pieces.length[a_ids], b_end - b_pieces.length[b_ids]
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    # Each group holds at least one token of either side: its A tokens, then its B tokens, in order.
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    n = len(a_ids) + len(b_ids)
    ids, keys = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    a_place = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, side="left")
    b_place = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")
    ids[a_place], ids[b_place], keys[a_place], keys[b_place] = a_ids, b_ids, a_group * 2, b_group * 2 + 1
    step = np.diff(keys)
    code = np.where(step == 0, 0, np.where((step == 1) & (keys[:-1] % 2 == 0), 1, 2))
    digest = hashlib.sha256(_decimal_text(ids, _SEPARATORS[np.append(code, 3)])).hexdigest()
    low = np.searchsorted(b_end, a_start, side="right")
    high = np.searchsorted(b_start, a_end, side="left")
    per = high - low
    which_a = np.repeat(np.arange(len(a_ids)), per)
    which_b = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(low, per)
    pair_keys, mult = np.unique(a_ids[which_a] * PACK + b_ids[which_b], return_counts=True)
    return {"n_a": len(a_ids), "n_b": len(b_ids), "n_groups": len(cuts), "n_links": int(per.sum()), "groups_sha256": digest,
            "keys": pair_keys, "mult": mult.astype(np.int64)}


_NONE = np.zeros(0, dtype=np.int64)
_POWERS = 10 ** np.arange(18, -1, -1, dtype=np.int64)


def _decimal_text(ids: np.ndarray, after: np.ndarray) -> bytes:
    """Decimal digits of each non-negative id followed by its separator byte (0: none), as one byte string."""
    width = len(str(int(ids.max()))) if ids.size else 1
    powers = _POWERS[-width:]
    digits = (ids[:, None] // powers[None, :]) % 10
    lead = ids[:, None] >= powers[None, :]
    lead[:, -1] = True
    cells = np.where(lead, digits + ord("0"), 0).astype(np.uint8)
    text = np.concatenate([cells, after[:, None]], axis=1).ravel()
    return text[text != 0].tobytes()


def align_text(text: str | None, a, b, a_pieces: _Pieces, b_pieces: _Pieces) -> dict:
    """``align_ids`` of one text, encoding it by ``a`` (a function) and ``b`` (a processor)."""
    if not text:
        return align_ids(text, _NONE, _NONE, a_pieces, b_pieces)
    return align_ids(text, np.array(a(" " + text), dtype=np.int64),
                     np.array(b.encode(text), dtype=np.int64), a_pieces, b_pieces)


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else _NONE
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int64()))


def tokens(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows of ``docs`` with a row key ``_row`` (partition and place), counts, digest, keys and mult of their links.

    Texts are encoded one at a time by both libraries; the other columns pass through as Arrow arrays.
    """
    rest = [c for c in docs.columns if c not in (*OUTPUTS, "_row", "keys", "mult") and (keep_text or c != text)]
    schema = T.StructType([docs.schema[c] for c in rest] + [
        T.StructField("_row", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups_sha256", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("mult", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        a, b, a_pieces, b_pieces = _tokenizers(a_path, b_path)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            # One text at a time: only its ids are kept, never a batch of encodings with offsets and strings.
            found = [align_text(t, a, b, a_pieces, b_pieces) for t in batch.column(text).to_pylist()]
            n = batch.num_rows
            columns = [batch.column(c) for c in rest] + [
                pa.array(np.arange(place, place + n, dtype=np.int64)),
                *[pa.array(np.array([f[c] for f in found], dtype=np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")],
                pa.array([f["groups_sha256"] for f in found], type=pa.string()),
                _lists([f["keys"] for f in found]), _lists([f["mult"] for f in found])]
            place += n
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "_row", "n_a", "n_b", "n_groups", "n_links",
                                                             "groups_sha256", "keys", "mult"])

    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 per row (see the module).

    The text column is returned only with ``keep_text``. Runs jobs while called: the per-text alignment and the pair
    counts are written to the shared folder, so that the tokenizers run once per text and lost executors cost a re-read.
    """
    spark = docs.sparkSession
    aligned_path, counts_path = (fresh_path(spark, f"align-{k}") for k in ("tokens", "counts"))
    tokens(docs, a_path, b_path, text, keep_text).write.parquet(aligned_path)
    aligned = spark.read.parquet(aligned_path)
    rest = [c for c in aligned.columns if c not in (*OUTPUTS, "_row", "keys", "mult")]

    records = aligned.select("_row", F.explode(F.arrays_zip("keys", "mult")).alias("l")).select(
        "_row", F.col("l.keys").alias("key"), F.col("l.mult").alias("mult"))
    counted = records.groupBy("key").agg(F.sum("mult").alias("count"), F.count("*").alias("docs"))
    side = counted.withColumn("b", F.col("key") % PACK)
    best = side.groupBy("b").agg(F.max("count").alias("best"))
    side.join(best, "b").select("key", "count", "docs", (F.col("count") == F.col("best")).alias("is_best")).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)

    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = counts.where(F.col("docs") >= max(1.0, total * HOT_SHARE)).select("key", F.lit(True).alias("hot"))
    salted = (records.join(F.broadcast(hot), "key", "left")
              .withColumn("salt", F.when(F.col("hot"), F.abs(F.xxhash64("_row")) % SALTS).otherwise(0)))
    spread = (counts.join(F.broadcast(hot), "key", "left")
              .withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
                                            .otherwise(F.array(F.lit(0).cast("bigint"))))))
    back = (salted.join(spread.select("key", "salt", "count", "is_best"), ["key", "salt"])
            .groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("mult")).otherwise(0)).alias("n_best"),
                                 F.sum(F.col("mult") * F.col("count")).alias("count_sum")))
    return (aligned.join(back, "_row", "left")
            .select(*rest, "n_a", "n_b", "n_groups", "n_links",
                    F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256"))
