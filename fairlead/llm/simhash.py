"""SimHash near-duplicates by anchor-point covering.

Two fingerprints link when at most ``max_bits`` of their 64 bits differ. The bits are cut into parts of 23, 23 and 18.
Of k differing bits, a part gets no more than its allowance t, as the allowances add up to k - 2; for 4 bits they are 1, 1 and 0.

The anchors of a 23-bit part are the words of the binary Golay code: a perfect code of covering radius 3, so every value has
exactly one anchor within 3 bits, its home. A value is replicated to every anchor within 3 + t bits. If two values
differ in at most t bits, each is among the visitors of the other's home. The 18-bit part has the trivial
code, every value its own anchor. At 4 bits a fingerprint has 5.3 + 5.3 + 1 replicas on average.

Fingerprints are compared per anchor, homes against visitors. A crowded anchor is cut into tiles of bounded
size. A tile returns a spanning forest of its links, not the links.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.components import components
from fairlead.session import settle

SEED = 42
#: Parts: first bit and number of bits.
PARTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: a generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
RADIUS = 3
#: Fingerprints of a tile, per side.
TILE = 4096


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a text as an unsigned number.

    A-Z are lower-cased, words are separated by ASCII white space, shingles of ``words`` words are joined by spaces and
    hashed by XXH64. A bit is set if it is set in over half the hashes, repeats included. A shorter text is one shingle; a
    text without words, or null, has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    spans = zip(first[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist())
    counts = np.zeros(64, dtype=np.int64)
    while block := [xxh64_intdigest(joined[a:b], SEED) for a, b in itertools.islice(spans, 65536)]:
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of each row, fp as a signed bigint."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    ids = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return ids.mapInArrow(rows, "id bigint, fp bigint").withColumnRenamed("id", key)


def _syndrome(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit values modulo the generator polynomial."""
    rest = values.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0).astype(rest.dtype)
    return rest


@functools.lru_cache(maxsize=8)
def _offsets(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the offsets to all anchors within ``reach`` bits, nearest first; as starts and a flat array."""
    patterns = np.array([sum(1 << b for b in c) for w in range(reach + 1) for c in itertools.combinations(range(23), w)],
                        dtype=np.int64)
    syndromes = _syndrome(patterns)
    order = np.argsort(syndromes, kind="stable")
    return np.searchsorted(syndromes[order], np.arange(2049)), patterns[order]


def allowances(max_bits: int) -> tuple[int, int, int]:
    """Bits that may differ in each part so that some part keeps to its allowance."""
    if not 0 <= max_bits <= 8:
        raise ValueError("max_bits must be 0 to 8")
    rest = max(0, max_bits - 2)
    return (rest + 1) // 2, rest // 2, 0


def anchors(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, anchor and home flag of all replicas of unsigned fingerprints. An anchor's number holds its part."""
    rows, keys, homes = [], [], []
    for p, ((start, bits), t) in enumerate(zip(PARTS, allowances(max_bits))):
        value = (fps >> np.uint64(start) & np.uint64((1 << bits) - 1)).astype(np.int64)
        if bits == 23:
            starts, flat = _offsets(RADIUS + t)
            s = _syndrome(value)
            n = starts[s + 1] - starts[s]
            row = np.repeat(np.arange(len(fps)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = value[row] ^ flat[starts[s][row] + nth]
            home = nth == 0
        else:
            row, key, home = np.arange(len(fps)), value, np.ones(len(fps), dtype=bool)
        rows.append(row)
        keys.append(key | p << 23)
        homes.append(home)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _forest(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what the links between homes and visitors connect."""
    nodes, at = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
    label = np.arange(len(nodes))
    mine, theirs = at[:len(homes)], at[len(homes):]
    for i in range(0, len(homes), 256):
        near = np.bitwise_count(homes[i:i + 256, None] ^ visitors[None, :]) <= max_bits
        near &= mine[i:i + 256, None] != theirs[None, :]
        for j in np.flatnonzero(near.any(axis=1)):
            found = np.unique(np.append(label[theirs[near[j]]], label[mine[i + j]]))
            if len(found) > 1:
                label[np.isin(label, found[1:])] = found[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _tiles(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Edges of sorted tiles (key, i, j, fp, home); a tile may go on in the next batch, one tile is held at a time."""
    rest = np.empty((5, 0), dtype=np.int64)

    def edges(block: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((block[:3, 1:] != block[:3, :-1]).any(axis=0)) + 1
        bounds = np.concatenate([[0], change, [block.shape[1]]])
        fp, home = block[3].view(np.uint64), block[4] == 1
        us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        n_home = np.add.reduceat(home.astype(np.int64), bounds[:-1]) if block.shape[1] else np.empty(0)
        for g in np.flatnonzero((n_home > 0) & (np.diff(bounds) > n_home)):
            one = slice(bounds[g], bounds[g + 1])
            u, v = _forest(fp[one][home[one]], fp[one][~home[one]], max_bits)
            us.append(u)
            vs.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

    for batch in batches:
        block = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        if not block.shape[1]:
            continue
        last = np.flatnonzero((block[:3] != block[:3, -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0
        rest = block[:, cut:]
        if cut:
            yield edges(block[:, :cut])
    if rest.shape[1]:
        yield edges(rest)


def links(distinct: DataFrame, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints linked within ``max_bits``. ``distinct`` has one column fp, no repeats."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fps = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
                row, key, home = anchors(fps.view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int32)), pa.array(fps[row]), pa.array(home)], ["key", "fp", "home"])

    replicas = distinct.select("fp").mapInArrow(replicate, "key int, fp bigint, home boolean")
    crowded = settle(replicas.groupBy("key").count().where(F.col("count") > tile).select(
        "key", F.ceil(F.col("count") / tile).cast("int").alias("m")), "crowded-anchors")
    cut = replicas.join(crowded, "key", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    tiles = cut.where("home").select("key", F.col("chunk").alias("i"), each.alias("j"), "fp", F.lit(1).alias("home")).unionByName(
        cut.select("key", each.alias("i"), F.col("chunk").alias("j"), "fp", F.lit(0).alias("home")))
    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        lambda batches: _tiles(batches, max_bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) of each row: its fingerprint and the smallest key reachable through links.

    Null and empty texts share fingerprint zero and link as any other. Rows with a null key have a component too; they
    never name one unless all its keys are null, then the name is null. Repeated rows stay. Groups of equal texts are one
    fingerprint from the start. Runs jobs while it is called.
    """
    fps = settle(fingerprints(docs, words, text, key), "fingerprints")
    distinct = settle(fps.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    root = components(links(distinct, max_bits))
    rooted = distinct.join(root, distinct["fp"] == root["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(names, "root").select("fp", "component_id"), "named-fingerprints")
    return fps.join(named, "fp").select(key, "fp", "component_id")
