"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK embedding walks over a sequence, writing the present symbol at every step and moving on when a random bit of
(step, symbol) says so. Two sequences at a small edit distance fall back into step soon after each edit, so their embeddings
differ in few places: edit distance becomes Hamming distance, and sampling places of the embedding is an LSH for it.

Here symbols are words. Walks drift apart as edits add up, so long items are cut into pieces of about PIECE words. However the
edits lie, one piece at least has no larger share of them than the item may have, and mostly several have: recall grows with the length.
Each document is read in windows of the length of each piece. A window whose sampled places equal a piece's in any of the
repetitions makes the item a candidate there, and the exact edit distance of the whole item to the best passage around it decides.

Windows that cannot match are not embedded. A replaced or missing word destroys two of a piece's n - 1 word pairs, an added one destroys
one and pushes one out of the window; so after k edits the window at the piece's beginning holds n - 1 - 2k of them.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = re.compile(r"\w+")
#: Edits allowed, as a share of an item's words: a similarity of 0.8.
EDITS = 0.2
#: Items with fewer words name no passage.
LEAST_WORDS = 5
#: Repetitions of the LSH and places each samples. Tests hold recall at the full number of edits against brute force.
REPETITIONS, SAMPLED = 32, 4
#: Words of a piece, about: items of 1.5 times as many and more are cut.
PIECE = 20
#: Items handled at once: the bound of what is broadcast. More items go in further blocks.
BLOCK = 20_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORDS.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embedding_keys(windows: np.ndarray, repetitions: int = REPETITIONS, sampled: int = SAMPLED) -> np.ndarray:
    """LSH keys of windows of one length, (repetitions, windows).

    ``windows`` holds word numbers, -1 for a word of no item. Places are sampled from the walk's first 2n steps, by when it has passed
    most of the n words. The sampled symbols are hashed into one key.
    """
    m, n = windows.shape
    steps = 2 * n
    places = np.zeros((repetitions, steps), dtype=bool)
    for r in range(repetitions):
        places[r, np.random.default_rng([n, r]).choice(steps, min(sampled, steps), replace=False)] = True
    symbols, seen = np.unique(np.concatenate([windows, np.full((m, 1), -2)], axis=1), return_inverse=True)
    symbols = symbols.astype(np.int64).view(np.uint64)
    seen = seen.reshape(-1)
    at = np.tile(np.arange(m) * (n + 1), (repetitions, 1))
    last = np.arange(m)[None, :] * (n + 1) + n
    shift = (np.arange(repetitions) * len(symbols))[:, None]
    keys = np.zeros((repetitions, m), dtype=np.uint64)
    for j in range(steps):
        seeds = _mix(np.arange(repetitions, dtype=np.uint64) * np.uint64(2 * 10**9 + 33) + np.uint64(j))[:, None]
        moves = (_mix(symbols * np.uint64(0x9E3779B97F4A7C15) ^ seeds) & np.uint64(1)).astype(np.int64).reshape(-1)
        now = seen[at]
        taken = np.flatnonzero(places[:, j])
        keys[taken] = _mix(keys[taken] ^ symbols[now[taken]]) + np.uint64(j + 1)
        at += moves[now + shift]
        np.minimum(at, last, out=at)
    return keys


def passage(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Edit distance of an item to the nearest passage of a region, and its start and end; the first of equals, the shortest."""
    def ends(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, dtype=np.int64) if free else steps.copy()
        for i, symbol in enumerate(a, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (b != symbol))
            best = np.concatenate([[i], best])
            row = np.minimum.accumulate(best - steps) + steps
        return row

    row = ends(item, region, True)
    end = int(row.argmin())
    back = ends(item[::-1], region[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


@dataclass
class Items:
    """A block of items, ready for matching."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    #: Word pairs of the pieces, sorted, with the piece lengths each occurs in (starts into lengths) and how often in one piece at most.
    pairs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    times: np.ndarray
    #: Per piece length and repetition: the keys, and for each its pieces: places of their items in ``ids``, first words in the items.
    tables: dict[int, list[tuple[np.ndarray, dict[int, list[tuple[int, int]]]]]] = field(default_factory=dict)
    edits: float = EDITS

    def pair_codes(self, words: np.ndarray) -> np.ndarray:
        return np.where((words[:-1] >= 0) & (words[1:] >= 0), words[:-1] * len(self.vocabulary) + words[1:], -1)


def pieces(n: int) -> list[tuple[int, int]]:
    """(first word, end) of the pieces of an item of n words, of about equal lengths."""
    parts = max(1, round(n / PIECE))
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def prepare(items: list[tuple[int, str | None]], edits: float = EDITS, least: int = LEAST_WORDS) -> Items:
    vocabulary: dict[str, int] = {}
    ids, words = [], []
    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")):
        found = words_of(text)
        if len(found) >= least:
            ids.append(item)
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], dtype=np.int64))
    out = Items(ids, words, vocabulary, *(np.empty(0, np.int64),) * 4, edits=edits)
    by_length = defaultdict(list)
    times: dict[tuple[int, int], int] = defaultdict(int)
    for i, w in enumerate(words):
        for a, b in pieces(len(w)):
            by_length[b - a].append((i, a))
            for pair, n in zip(*np.unique(out.pair_codes(w[a:b]), return_counts=True)):
                times[int(pair), b - a] = max(times[int(pair), b - a], int(n))
    if times:
        codes, out.lengths = np.array(sorted(times)).T
        out.times = np.array([times[k] for k in sorted(times)])
        out.pairs, out.starts = np.unique(codes, return_index=True)
        out.starts = np.append(out.starts, len(codes))
    for n, group in by_length.items():
        keys = embedding_keys(np.stack([words[i][a:a + n] for i, a in group]))
        out.tables[n] = []
        for row in keys:
            table = defaultdict(list)
            for key, piece in zip(row.tolist(), group):
                table[key].append(piece)
            out.tables[n].append((np.unique(row), dict(table)))
    return out


def windows(items: Items, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(piece length, starts) of the windows of a document that hold enough pairs of pieces of that length."""
    if len(words) < 2 or not len(items.pairs):
        return
    codes = items.pair_codes(words)
    at = np.minimum(np.searchsorted(items.pairs, codes), len(items.pairs) - 1)
    places = np.flatnonzero(items.pairs[at] == codes)
    if not len(places):
        return
    at = at[places]
    n = items.starts[at + 1] - items.starts[at]
    places = np.repeat(places, n)
    entry = np.repeat(items.starts[at], n) + np.arange(len(places)) - np.repeat(np.cumsum(n) - n, n)
    lengths = items.lengths[entry]
    n = np.arange(int(items.lengths.max()) + 1)
    enough = np.maximum(1, n - 1 - 2 * (items.edits * n).astype(np.int64))
    for length in np.flatnonzero(np.bincount(lengths, minlength=len(n)) >= enough).tolist():
        mine = lengths == length
        here = places[mine]
        least = int(enough[length])
        # A window with so many pairs begins at or before a pair that the least-1 next ones follow closely enough.
        last, first = here[least - 1:], here[:max(0, len(here) - least + 1)]
        close = last - first <= length - 2
        if not close.any():
            continue
        # A pair counts in a window as often as in a piece at most: not where so many earlier ones of it are inside.
        pair = entry[mine]
        order = np.argsort(pair, kind="stable")
        pair, here = pair[order], here[order]
        back = np.arange(len(pair)) - items.times[pair]
        before = np.where((back >= 0) & (pair[np.maximum(back, 0)] == pair), here[np.maximum(back, 0)], -1)
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(np.maximum(before + 1, here - length + 2), 0), 1)
        np.add.at(edge, here + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge) >= least)
        if len(starts):
            yield length, starts


def find(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start word, end word, distance) of every passage within the allowed edits.

    Overlapping candidate windows of one item are one region, with one passage, the nearest.
    """
    look = items.vocabulary.get
    words, todo = [], defaultdict(list)
    for t, text in enumerate(texts):
        w = np.array([look(x, -1) for x in words_of(text)], dtype=np.int64)
        words.append(None)
        for length, starts in windows(items, w):
            words[t] = w
            todo[length].append((t, starts))
    candidates = defaultdict(set)
    for length, found in todo.items():
        owner = np.concatenate([np.full(len(s), t) for t, s in found])
        starts = np.concatenate([s for _, s in found])
        for at in range(0, len(starts), 4096):
            own, first = owner[at:at + 4096], starts[at:at + 4096]
            block = np.full((len(own), length), -2, dtype=np.int64)
            for row, (t, s) in enumerate(zip(own.tolist(), first.tolist())):
                part = words[t][s:s + length]
                block[row, :len(part)] = part
            block, same = np.unique(block, axis=0, return_inverse=True)
            same = same.reshape(-1)
            for (known, table), row in zip(items.tables[length], embedding_keys(block)):
                hit = np.isin(row, known)
                for at_row in np.flatnonzero(hit[same]).tolist() if hit.any() else ():
                    for i, a in table[int(row[same[at_row]])]:
                        candidates[int(own[at_row]), i].add((int(first[at_row]) - a, int(items.edits * length)))
    out = []
    for (t, i), starts in sorted(candidates.items()):
        item, most = items.words[i], int(items.edits * len(items.words[i]))
        regions = []
        # The window may lie beside its piece, by the piece's edits, and that beside its place, by the edits before it.
        for a, b in sorted((max(0, s - most - beside), s + len(item) + most + beside) for s, beside in starts):
            if regions and a <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], b)
            else:
                regions.append([a, b])
        for a, b in regions:
            if np.isin(item, words[t][a:b]).sum() < len(item) - most:
                continue  # each word of the item that the region lacks is an edit
            distance, start, end = passage(item, words[t][a:b])
            if distance <= most:
                out.append((t, i, a + start, a + end, distance))
    return out


HITS = "id bigint, item_id bigint, start_word bigint, end_word bigint, distance bigint"


def shared_blocks(spark: SparkSession, benchmark: DataFrame, edits: float = EDITS) -> list:
    """The items, prepared and broadcast in blocks of about BLOCK. Counts and collects them, block by block."""
    known = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks = max(1, -(-known.count() // BLOCK))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [spark.sparkContext.broadcast(prepare([(r["item_id"], r["text"]) for r in known.where(block_of == b).collect()], edits))
            for b in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, item_id, start_word, end_word, distance) of each benchmark passage in a document; clean documents have no row.

    Null and empty texts have none; null and empty items, and items under LEAST_WORDS words, name none. Equal items are found each
    under its own id; items whose id is null too. Each block of items is sought in all documents.
    """
    parts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))

    def finder(shared):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    hits = np.array(find(items, part.column(1).to_pylist()), dtype=np.int64).reshape(-1, 5)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(hits[:, 0])), pa.array([items.ids[i] for i in hits[:, 1]], pa.int64()),
                         *(pa.array(hits[:, c]) for c in (2, 3, 4))], [f.split()[0] for f in HITS.split(", ")])
        return rows

    found = [parts.mapInArrow(finder(shared), HITS) for shared in shared_blocks(docs.sparkSession, benchmark, edits)]
    return functools.reduce(DataFrame.unionByName, found).withColumnRenamed("id", key)


def without_passages(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns carried. One pass a block of items, no join."""
    at_text = docs.columns.index(text)

    def keeper(shared):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[[hit[0] for hit in find(shared.value, part.column(at_text).to_pylist())]] = False
                    yield part.filter(pa.array(clean))
        return rows

    for shared in shared_blocks(docs.sparkSession, benchmark, edits):
        docs = docs.mapInArrow(keeper(shared), docs.schema)
    return docs
