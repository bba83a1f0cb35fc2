"""Secret scanning with a recursive decoding worklist.

A text is scanned, then every layer that can be unwrapped from it: URL escapes, Unicode escapes, base64 runs and gzip or zlib
data inside base64. New layers go on a worklist until none is new. A layer whose text was seen before at the same
place is dropped, so cycles end. Each layer keeps, per character, the span of the text it came from; a secret
found in a layer is reported as the span in the text.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Each match of ASSIGN has one of these, in lower case.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
#: A run of base64 characters, over line breaks too, with 16 or more of them.
_BREAK, _CHAR = r"(?:[ \t]*\r?\n[ \t]*)", "[A-Za-z0-9+/_-]"
BASE64 = re.compile(rf"(?<!{_CHAR})(?={_CHAR}(?:{_BREAK}?{_CHAR}){{15}}){_CHAR}+(?:{_BREAK}{_CHAR}+)*={{0,2}}")
#: The end of a text that a match or a run may go on from; the keyword part is for ASSIGN.
UNFINISHED = re.compile(
    rf"""(?:(?i:{'|'.join(KEYWORDS)})["']?\x20*(?:[:=]\x20*["']?[A-Za-z0-9+/_.=-]*)?|(?<!{_CHAR}){_CHAR}+(?:{_BREAK}{_CHAR}+)*={{0,2}}[ \t\r\n]*"""
    r"""|(?<![%0-9A-Fa-f\\xuU{}])[%\\][%0-9A-Fa-f\\xuU{}]*)?\Z""", re.ASCII)
SPACES = re.compile("\x20{2,}")

GZIP = b"\x1f\x8b\x08"
#: Bytes or characters of a compressed layer handled at once.
CHUNK = 4 << 20
#: Rows with a compressed layer of more bytes are flagged. It is scanned whole all the same.
MOST_UNFOLDED = 32 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with, per character, the first and the end position in the original it came from."""

    __slots__ = ("text", "first", "end", "large")

    def __init__(self, text: str, first: np.ndarray, end: np.ndarray, large: bool = False):
        self.text, self.first, self.end, self.large = text, first, end, large

    def spans(self) -> Iterator[tuple[int, int, int]]:
        for a, kind, b in base_spans(self.text):
            yield int(self.first[a]), kind, int(self.end[b - 1])


def _rewritten(layer: Layer, pieces: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with spans replaced: (start, end, [(character, first, end) within the layer])."""
    text, first, end, at = [], [], [], 0
    for a, b, chars in pieces:
        text.append(layer.text[at:a])
        first.append(layer.first[at:a])
        end.append(layer.end[at:a])
        text.extend(c for c, _, _ in chars)
        first.append(layer.first[[x for _, x, _ in chars]] if chars else layer.first[:0])
        end.append(layer.end[[y - 1 for _, _, y in chars]] if chars else layer.end[:0])
        at = b
    text.append(layer.text[at:])
    return Layer("".join(text), np.concatenate([*first, layer.first[at:]]), np.concatenate([*end, layer.end[at:]]))


def _utf8(data: bytes) -> tuple[str, np.ndarray]:
    """Characters of bytes read as UTF-8, and where each begins, the end as well. A byte that is not UTF-8 is a half surrogate."""
    text = data.decode(errors="surrogateescape")
    if len(text) == len(data):
        return text, np.arange(len(data) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xDC80) & (code < 0xDD00)] = 1
    return text, np.concatenate([[0], np.cumsum(size)])


def _url(layer: Layer) -> Layer | None:
    """All runs of percent escapes, unescaped."""
    if "%" not in layer.text:
        return None
    pieces = []
    for m in URL.finditer(layer.text):
        chars, at = _utf8(bytes.fromhex(m[0].replace("%", "")))
        at = (m.start() + 3 * at).tolist()
        pieces.append((m.start(), m.end(), list(zip(chars, at, at[1:]))))
    return _rewritten(layer, pieces) if pieces else None


def _unicode(layer: Layer) -> Layer | None:
    """All Unicode escapes, surrogate pairs as one character; half pairs and impossible code points stay."""
    if "\\" not in layer.text:
        return None
    pieces, high = [], None
    for m in UNICODE.finditer(layer.text):
        code = int(m[m.lastindex], 16)
        if high and high[1] == m.start() and 0xDC00 <= code < 0xE000:
            start, _, first = high
            c = chr(0x10000 + (first - 0xD800 << 10) + code - 0xDC00)
            pieces.append((start, m.end(), [(c, start, m.end())]))
        elif code < 0xD800 or 0xE000 <= code < 0x110000:
            pieces.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
        high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
    return _rewritten(layer, pieces) if pieces else None


def _packed(data: bytes, at: int = 0) -> bool:
    """Whether gzip or zlib data may begin at a place."""
    head = data[at:at + 3]
    return head == GZIP or len(head) > 2 and head[0] & 15 == 8 and head[0] >> 4 < 8 and (head[0] << 8 | head[1]) % 31 == 0


def _unfold(blocks: Iterator[bytes], used: list[int]) -> Iterator[bytes]:
    """What blocks of gzip members or zlib data unfold to, in chunks, up to where they break off. ``used[0]`` counts bytes read."""
    decoder, block, gz = zlib.decompressobj(47), b"", None
    while True:
        if not block:
            block = next(blocks, b"")
            if not block:
                return
        if gz is None:
            gz = block[:2] == GZIP[:2]
        if decoder.eof:  # further members, with zeros between
            rest = block.lstrip(b"\0")
            if not rest:
                block = rest
                continue
            if len(rest) < 2:
                rest += next(blocks, b"")
            if not gz or rest[:2] != GZIP[:2]:
                return
            used[0] += len(block) - len(rest) if len(rest) < len(block) else 0
            block, decoder = rest, zlib.decompressobj(47)
        try:
            out = decoder.decompress(block, CHUNK)
        except zlib.error:
            return
        rest = decoder.unused_data if decoder.eof else decoder.unconsumed_tail
        used[0] += len(block) - len(rest)
        block = rest
        if out:
            yield out
        elif not decoder.eof and not block:
            continue


def _promising(text: str) -> bool:
    """Whether a decoded text may hold a secret or a further layer."""
    if "%" in text or "\\" in text or "AKIA" in text or HEX.search(text) or BASE64.search(text):
        return True
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def _open_end(text: str) -> int:
    """Where the unfinished end of a text begins."""
    back = 256
    while True:
        start = max(0, len(text) - back)
        at = UNFINISHED.search(text, start).start()
        if at > start + 16 or not start:
            return at
        back *= 16


def _texts(blocks: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """A stream of bytes as texts of about CHUNK characters, and whether more than MOST_UNFOLDED came so far.

    What a match or run may need of a text's end begins the next text too.
    """
    decoder, rest, total = codecs.getincrementaldecoder("utf-8")("surrogateescape"), [], 0
    size = 0
    for data in blocks:
        total += len(data)
        rest.append(decoder.decode(data))
        size += len(rest[-1])
        if size < CHUNK:
            continue
        text = "".join(rest)
        tail = min(_open_end(text), max(0, len(text) - 64))
        if tail:
            yield text, total > MOST_UNFOLDED
        rest, size = [SPACES.sub(" ", text[tail:])], 0
    text = "".join([*rest, decoder.decode(b"", True)])
    if text:
        yield text, total > MOST_UNFOLDED


def _unfolded(data: bytes, at: int, used: list[int]) -> Iterator[tuple[str, bool]]:
    """The texts of compressed data at a place, and of compressed data that this holds in turn, each level read anew."""
    def blocks(depth: int) -> Iterator[bytes]:
        if depth:
            return _unfold(blocks(depth - 1), [0])
        return (data[i:i + CHUNK] for i in range(at, len(data), CHUNK))

    for _ in _unfold(blocks(0), used):
        pass
    seen, depth = set(), 1
    while True:
        yield from _texts(blocks(depth))
        head = next(blocks(depth), b"")
        mark = hashlib.md5(head).digest()
        if mark in seen or not _packed(head):
            return
        seen.add(mark)
        depth += 1


def _base64(layer: Layer) -> Iterator[Layer]:
    """Layers of the base64 runs: each run decoded at its four alignments, and compressed data in it unfolded.

    Compressed data is sought at every gzip header, and for zlib where a line or a part between separators begins.
    """
    for m in BASE64.finditer(layer.text):
        raw = np.frombuffer(m[0].encode(), dtype=np.uint8)
        where = np.flatnonzero((raw > 32) & (raw != ord("=")))
        raw = raw[where]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(where) > 1) | np.isin(raw[:-1], np.frombuffer(b"/-_", np.uint8))]))
        where += m.start()
        run = raw.tobytes().translate(bytes.maketrans(b"-_", b"+/"))
        for shift in range(4):
            part = run[shift:len(run) - ((len(run) - shift) % 4 == 1)]
            data = base64.b64decode(part + b"=" * (-len(part) % 4))
            text, at = _utf8(data)
            if _promising(text):
                # Byte k comes from the characters 4k/3 and the next; a group of three from four.
                first = where[shift + at[:-1] * 4 // 3]
                last = where[np.minimum(shift + (at[1:] * 4 + 2) // 3, len(where)) - 1]
                yield Layer(text, layer.first[first], layer.end[last])
            heads = {h.start() for h in re.finditer(re.escape(GZIP), data)}
            heads.update(p for p in ((begins[begins % 4 == shift] - shift) // 4 * 3).tolist() if _packed(data, p))
            done = 0
            for head in sorted(heads):
                if head < done:
                    continue
                used = [0]
                for text, large in _unfolded(data, head, used):
                    end = head + used[0]
                    last = m.end() if end >= len(data) - 1 else int(where[min(shift + (end * 4 + 2) // 3, len(where)) - 1]) + 1
                    span = layer.first[where[shift + head * 4 // 3]], layer.end[last - 1]
                    yield Layer(text, *(np.broadcast_to(x, len(text)) for x in span), large)
                    done = end


def _inside(layer: Layer) -> Iterator[Layer]:
    """The layers that can be unwrapped from a layer."""
    for unescaped in (_url, _unicode):
        if (inner := unescaped(layer)) is not None:
            yield inner
    yield from _base64(layer)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """The plain spans, the further spans of decoded layers, and whether a compressed layer had more than MOST_UNFOLDED bytes."""
    base = base_spans(text)
    n = len(text)
    if "%" not in text and "\\" not in text and not BASE64.search(text):
        return base, [], False
    origin = np.arange(n + 1, dtype=np.int64)
    work, seen, found, cut = [iter([Layer(text, origin[:-1], origin[1:])])], set(), set(), False
    while work:
        layer = next(work[-1], None)  # depth first: only layers on the way are held
        if layer is None:
            work.pop()
            continue
        cut = cut or layer.large
        mark = (hashlib.md5(layer.text.encode(errors="surrogatepass")).digest(), int(layer.first[0]) if len(layer.first) else -1)
        if mark in seen:
            continue
        seen.add(mark)
        if len(seen) > 1:
            found.update(layer.spans())
        work.append(_inside(layer))
    return base, sorted(found.difference(base)), cut


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Secrets of each row: key, n_assign, n_access, n_hex, base_sha256, spans, n_decoded, oversize.

    The counts and base_sha256 are of the plain patterns; ``spans`` has those and the ``n_decoded`` further ones of decoded
    layers, by start, kind and end, in code points, ends exclusive. ``oversize`` says that a compressed layer was larger than
    MOST_UNFOLDED. Null and empty texts have none. Rows are independent; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                out = []
                for body in part.column(1).to_pylist():
                    base, more, cut = scan(body or "")
                    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                    out.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more), cut))
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                    ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "oversize"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(
        rows, "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
              "n_decoded bigint, oversize boolean").withColumnRenamed("id", key)


def redacted(text: str) -> str:
    """The text with every secret, plain or decoded, replaced by its kind in brackets; overlapping spans are one."""
    base, more, _ = scan(text)
    out, at, todo = [], 0, sorted(base + more)
    while todo:
        a, kind, b = todo.pop(0)
        while todo and todo[0][0] < b:
            b = max(b, todo.pop(0)[2])
        out += [text[at:a], f"[{KINDS[kind]}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; null stays null, texts without secrets are unchanged."""
    import pandas as pd

    def clean(column):
        return column.map(lambda t: None if t is None else redacted(t))

    clean.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return docs.withColumn(text, F.pandas_udf(clean, "string")(F.col(f"`{text}`")))
