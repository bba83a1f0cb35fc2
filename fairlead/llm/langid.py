"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces; each language has its own probability for every piece. The likelihood of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities, which the forward algorithm adds up in one pass.
A text's likelihood is the product over its words. The probabilities are expected piece counts of training words, by the forward-backward
algorithm under equal piece probabilities.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
UNKNOWN = 0


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes and their numbers. Number 0 is any character that is no piece."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    size: int

    @property
    def longest(self) -> int:
        return max(self.by_length, default=1)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n characters of words of one length, (words, windows)."""
    width = codes.shape[1] - n + 1
    h = np.zeros((codes.shape[0], width), dtype=np.uint64)
    for i in range(n):
        h = (h ^ codes[:, i:i + width]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model, in lower case, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size())
                     if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
    pieces = [p for p in pieces if p == START or LETTERS.fullmatch(p.removeprefix(START))]
    groups = defaultdict(list)
    for number, piece in enumerate(pieces, 1):
        groups[len(piece)].append((number, piece))
    by_length = {}
    for n, group in groups.items():
        h = _hashes(_codes([p for _, p in group]), n)[:, 0]
        order = np.argsort(h)
        by_length[n] = h[order], np.array([i for i, _ in group])[order]
    return Vocabulary(by_length, len(pieces) + 1)


def lattice(codes: np.ndarray, vocab: Vocabulary) -> dict[int, np.ndarray]:
    """For each piece length, the piece number at each start, -1 for none; every single character has one, UNKNOWN if need be."""
    out = {}
    for n, (hashes, numbers) in vocab.by_length.items():
        if n <= codes.shape[1]:
            h = _hashes(codes, n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            out[n] = np.where(hashes[at] == h, numbers[at], UNKNOWN if n == 1 else -1)
    if 1 not in out:
        out[1] = np.full(codes.shape, UNKNOWN)
    return out


def forward(pieces: dict[int, np.ndarray], length: int, prob: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward sums at every position, each rescaled, and the log of what position i was divided by so far.

    ``prob`` has a row per piece and, last, a row of zeros for none; a column per language.
    """
    alpha, scale = [np.ones((pieces[1].shape[0], prob.shape[1]))], np.zeros((length + 1, pieces[1].shape[0]))
    for j in range(1, length + 1):
        total = np.zeros_like(alpha[0])
        for n, ids in pieces.items():
            if n <= j:
                gain = np.exp(scale[j - n] - scale[j - 1])[:, None]
                total += alpha[j - n] * gain * prob[ids[:, j - n]]
        most = np.maximum(total.max(axis=1), 1e-300)
        alpha.append(total / most[:, None])
        scale[j] = scale[j - 1] + np.log(most)
    return alpha, scale


def word_scores(words: list[str], vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log likelihood of each word per language, (words, languages)."""
    out = np.empty((len(words), prob.shape[1]), dtype=np.float32)
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    for n, rows in by_length.items():
        step = max(1, 400_000 // (n + 1))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            alpha, scale = forward(lattice(_codes([START + words[i] for i in part]), vocab), n + 1, prob)
            out[part] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1][:, None]
    return out


def expected_counts(words: Counter, vocab: Vocabulary) -> np.ndarray:
    """Expected number of uses of each piece in counted words, under equal piece probabilities."""
    counts = np.zeros(vocab.size)
    flat = np.full((vocab.size + 1, 1), 1e-4)
    flat[UNKNOWN], flat[-1] = 1e-5, 0.0
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for n, group in by_length.items():
        step = max(1, 400_000 // (n + 1))
        for at in range(0, len(group), step):
            part = group[at:at + step]
            weight = np.array([words[w] for w in part], dtype=float)
            codes, length = _codes([START + w for w in part]), n + 1
            pieces = lattice(codes, vocab)
            alpha, scale = forward(pieces, length, flat)
            # Backward sums are the forward sums of the mirrored lattice.
            mirrored = {k: ids[:, ::-1] for k, ids in pieces.items()}
            beta, back = forward(mirrored, length, flat)
            for k, ids in pieces.items():
                for i in range(length - k + 1):
                    use = (alpha[i] * beta[length - i - k])[:, 0] * flat[ids[:, i], 0] * np.exp(
                        scale[i] + back[length - i - k] - scale[length]) / alpha[length][:, 0] * weight
                    np.add.at(counts, np.maximum(ids[:, i], 0), np.where(ids[:, i] >= 0, use, 0.0))
    return counts


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: Probability of each piece per language, with a last row of zeros.
    prob: np.ndarray
    vocabulary: str


def fit(rows: DataFrame, vocabulary_path: str, most: int = 4000, text: str = "text", lang: str = "lang") -> Model:
    """Learn piece probabilities from rows with a language.

    Per language about ``most`` distinct texts are used, each once, those with the smallest hashes: the bound of what is fitted on;
    languages with fewer use all. The prior counts rows. Texts and languages that are null are left out. Runs jobs while it is called.
    """
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Copies are counted together before the shuffle.
    texts = known.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    sizes = texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()
    n, distinct = {r["lang"]: r["n"] for r in sizes}, {r["lang"]: r["distinct"] for r in sizes}
    languages = sorted(n)
    if not n:
        return Model([], np.empty(0), np.empty((0, 0)), vocabulary_path)
    part = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, most / distinct[k]) * 2**32))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, words = vocabulary(vocabulary_path), defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for language, counter in words.items():
                counts = expected_counts(counter, vocab)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])],
                    ["lang", "piece", "n"])
            words.clear()

        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[language].update(LETTERS.findall(body.lower()))
            if sum(map(len, words.values())) > 300_000:
                yield from told()
        yield from told()

    chosen = known.where(F.pmod(F.xxhash64("text"), F.lit(2**32)) < part[F.col("lang")]).distinct()
    # At most one row per language and piece of the vocabulary.
    counted = chosen.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    vocab = vocabulary(vocabulary_path)
    counts = np.full((vocab.size, len(languages)), 0.05)
    for r in counted:
        counts[r["piece"], languages.index(r["lang"])] += r["n"]
    prob = np.vstack([counts / counts.sum(axis=0), np.zeros(len(languages))])
    prior = np.log(np.array([n[k] for k in languages], dtype=float) / sum(n.values()))
    return Model(languages, prior, prob, vocabulary_path)


class Scorer:
    """Scores words, remembering them until there are many."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.vocab = vocabulary(model.vocabulary)
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)), dtype=np.float32)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text, und and 0 without letters. Texts are handled a few at a time."""
        words = [LETTERS.findall(t.lower()) if t and self.model.languages else [] for t in texts]
        if len(self.place) > self.most:
            self.place, self.scores = {}, self.scores[:0]
        new = list({w for ws in words for w in ws}.difference(self.place))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        if new:
            self.scores = np.concatenate([self.scores, word_scores(new, self.vocab, self.model.prob)])
        out = []
        for ws in words:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = self.model.prior.copy()
            for at in range(0, len(ws), 65536):
                rows = np.fromiter(map(self.place.__getitem__, ws[at:at + 65536]), dtype=np.int64)
                total += self.scores[rows].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of each row: the likeliest language and its posterior; und and 0 for null or without a letter.

    Equal likelihoods go to the first language in order; a model that learned no language says und. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = scorer.texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())],
                    ["id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(
        rows, "id bigint, lang_pred string, score double").withColumnRenamed("id", key)
