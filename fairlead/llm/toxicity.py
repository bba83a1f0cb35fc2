"""Toxicity by a weighted finite-state pattern grammar.

A text becomes clauses of word classes. Negation, reported speech and target are small transducers over these classes, composed
into one machine; it turns an insult or threat into a symbol that says in which setting it stands (plain, negated,
reported, with a target). The weights of a text's symbols, by clause and in sum, are the features of a logistic
regression. Word classes come from short fixed lists and from stems learned from labelled texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.tables import id_crc
from fairlead.session import settle

# Word lists, lower case.
LISTS = {
    "insult": "idiot moron stupid trash scum loser pathetic worthless disgusting clown fool dumb imbecile jerk bastard pig "
              "vermin filth garbage dummkopf trottel abschaum idiote crétin imbécile ordure idiota estúpido basura imbécil",
    "threat": "kill murder hurt destroy shoot stab strangle beat töten umbringen erschießen tuer frapper détruire matar golpear",
    "target": "you your yours u ur du dich dir dein euch tu toi ton vous tú ti usted ustedes",
    "negation": "not no never none nobody don't isn't aren't won't nicht kein keine nie niemals jamais aucun nunca jamás ningún",
    "report": "said says told wrote claimed claims called quoted reported sagte behauptet schrieb dit affirme déclare dijo dice afirma",
}
CLASSES = ("word", "break", "target", "negation", "report", "insult", "threat")
MARKED = CLASSES.index("insult")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.,;:!?|\n]")
STEM_LENGTHS = range(3, 9)
#: Words a negation reaches.
SCOPE = 4


@dataclass
class Transducer:
    """Deterministic: arcs[state][symbol] = (next state, output). A symbol without an arc passes unchanged and stays."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get(state, {}).get(symbol, (state, symbol))

    def states(self) -> set:
        return {self.start, *self.arcs, *(n for a in self.arcs.values() for n, _ in a.values())}


def negation_machine() -> Transducer:
    """insult becomes insult- for SCOPE words after a negation; threat likewise."""
    t = Transducer(0)
    for left in range(SCOPE + 1):
        down = max(0, left - 1)
        t.arcs[left] = {s: (down, s + "-" if left and s in ("insult", "threat") else s) for s in CLASSES}
        t.arcs[left] |= {"negation": (SCOPE, "negation"), "break": (0, "break")}
    return t


def report_machine() -> Transducer:
    """insult becomes insult~ after a verb of reporting, to the clause's end."""
    t = Transducer("own")
    t.arcs["own"] = {"report": ("reported", "report")}
    t.arcs["reported"] = {"break": ("own", "break")} | {s: ("reported", s + "~") for s in ("insult", "threat")}
    return t


def target_machine() -> Transducer:
    """insult becomes insult+ after a target in its clause; a target after an insult gives aimed."""
    t = Transducer("none")
    plain = ("insult", "threat")
    t.arcs["none"] = {"target": ("target", "target")} | {s: ("insulted", s) for s in plain}
    t.arcs["target"] = {"break": ("none", "break")} | {s: ("target", s + "+") for s in plain}
    t.arcs["insulted"] = {"break": ("none", "break"), "target": ("target", "aimed")}
    return t


def compose(a: Transducer, b: Transducer, alphabet=CLASSES) -> Transducer:
    """The machine that feeds a's output to b."""
    out, todo = Transducer((a.start, b.start)), [(a.start, b.start)]
    while todo:
        p, q = pair = todo.pop()
        if pair in out.arcs:
            continue
        out.arcs[pair] = {}
        for symbol in alphabet:
            p2, middle = a.step(p, symbol)
            q2, result = b.step(q, middle)
            out.arcs[pair][symbol] = ((p2, q2), result)
            todo.append((p2, q2))
    return out


GRAMMAR = compose(compose(negation_machine(), report_machine()), target_machine())
#: Outputs that count, in the order of the features; the last feature is the heaviest clause.
OUTPUTS = ("insult", "insult+", "insult-", "insult~", "threat", "threat+", "threat-", "threat~", "aimed")
#: Weights of outputs within a clause.
IN_CLAUSE = dict(zip(OUTPUTS, (1.0, 1.5, 0.2, 0.4, 0.5, 1.5, 0.1, 0.2, 0.5)))


#: What a word of no class is.
PLAIN = (0, 0.0)


class Lexicon(dict):
    """(class number, weight) of lower-case words; learned stems match the beginning of a word. Forgets when it has grown large."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.fixed = {c: (1, 0.0) for c in ".,;:!?|\n"}
        for name, words in LISTS.items():
            self.fixed |= {w: (CLASSES.index(name), 1.0) for w in words.split()}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 100_000:
            self.clear()
        code, weight = self.fixed.get(word, (0, 0.0))
        for n in self.lengths:
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                code, weight = (code if code >= MARKED else MARKED), max(weight, w)
        found = self[word] = (code, weight) if code else PLAIN
        return found


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Feature vector of a text: log of one plus the weight of each output, and of the heaviest clause."""
    tokens = TOKEN.findall((text or "").lower())
    sums, heaviest = dict.fromkeys(OUTPUTS, 0.0), 0.0
    marked = [i for i, t in enumerate(tokens) if lexicon[t][0] >= MARKED]
    at = -1
    for i in marked:
        if i < at:
            continue  # its clause is done
        begin = i
        while begin and lexicon[tokens[begin - 1]][0] != 1:
            begin -= 1
        state, clause, at = GRAMMAR.start, 0.0, begin
        while at < len(tokens):
            code, weight = lexicon[tokens[at]]
            if code == 1:
                break
            state, output = GRAMMAR.step(state, CLASSES[code])
            if output in sums:
                weight = weight or 1.0
                sums[output] += weight
                clause += weight * IN_CLAUSE[output]
            at += 1
        heaviest = max(heaviest, clause)
    return np.log1p(np.array([*sums.values(), heaviest]))


@dataclass
class Model:
    stems: dict[str, float]
    coef: np.ndarray
    intercept: float


def _prefixes(text: str | None) -> set[str]:
    words = {w for w in TOKEN.findall((text or "").lower()) if len(w) > 2}
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | {w for w in words if len(w) < 24}


def _group(text: str | None) -> int:
    """A number that near copies mostly share: the least hash of the five-word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").split()
    return min(xxh64_intdigest(" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))) >> 1


def learn_stems(sample: DataFrame, most: int = 200) -> dict[str, float]:
    """Beginnings of words that mark toxic texts, with weights, from a bounded sample (text, toxic).

    A stem counts once per group of near copies. Stems are chosen greedily, the one that newly covers most toxic
    groups first, twice its clean groups' share held against it, until every group is covered twice or nothing is gained.
    """

    def rows(which: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, in zip(batch.column(0).to_pylist()):
                    found = sorted(_prefixes(text) if which is None else _prefixes(text) & which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.string()), pa.array([_group(text)] * len(found), pa.int64())], ["stem", "grp"])
        return run

    texts = lambda toxic: sample.where(F.col("toxic") == toxic).select("text")
    distinct = F.collect_set("grp").alias("groups")
    schema = "stem string, grp bigint"
    n = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in n}
    if not n.get(1) or not n.get(0):
        return {}
    least = max(2, n[1] // 200)
    # At most 2,000 groups each, of the sample's toxic texts.
    found = texts(1).mapInArrow(rows(None), schema).groupBy("stem").agg(distinct).where(F.size("groups") >= least).collect()
    clean = texts(0).mapInArrow(rows(frozenset(r["stem"] for r in found)), schema).groupBy("stem").agg(
        F.count_distinct("grp").alias("n")).collect()
    clean = {r["stem"]: r["n"] for r in clean}
    all_groups = sorted({g for r in found for g in r["groups"]})
    number = {g: i for i, g in enumerate(all_groups)}
    open_ = np.full(len(all_groups), 2)
    stems = {}
    odds = lambda a, c: math.log((a + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
    able = [(r["stem"], np.array([number[g] for g in r["groups"]]), clean.get(r["stem"], 0)) for r in found]
    able = [x for x in able if odds(len(x[1]), x[2]) >= 1.5]
    while able and len(stems) < most:
        gains = [((open_[groups] > 0).sum() - 2 * c * n[1] / n[0], len(stem), stem) for stem, groups, c in able]
        at = max(range(len(able)), key=lambda i: gains[i])
        if gains[at][0] < least:
            break
        stem, groups, c = able.pop(at)
        stems[stem] = odds(len(groups), c)
        open_[groups] -= 1
        able = [x for x, g in zip([*able[:at], *able[at:]], [*gains[:at], *gains[at + 1:]]) if g[0] >= least]
    return stems


def fit_logistic(x: np.ndarray, y: np.ndarray, shift: float, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; ``shift`` is added to the intercept at the end."""
    one = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(one.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + penalty, one.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1] + shift)


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 4000) -> Model:
    """Learn stems and weights from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Of these, the toxic and clean ids with the smallest hashes are used, at most ``most_toxic`` and ``most_clean``: the bound of
    what is fitted on. Several labels of one id count as toxic if one is. Without labels of both kinds the model is the
    fixed lists alone. Runs jobs while it is called.
    """
    usable = labels.where(F.col("toxic").isNotNull() & (id_crc() % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = usable.where("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(
        usable.where("toxic = 0").orderBy(order, "doc_id").limit(most_clean))
    sample = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-sample")
    stems = learn_stems(sample)
    schema = "toxic int, f array<double>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            f = [features(t, lexicon).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

    seen = sample.mapInArrow(rows, schema).collect()
    y = np.array([r["toxic"] for r in seen], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(stems, np.array([1.0] * 2 + [0.0] * 2 + [0.5, 1.5, 0.0, 0.0, 0.5, 1.0]), -2.0)
    shift = math.log(total[1] / total[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(stems, *fit_logistic(np.array([r["f"] for r in seen]), y, shift))


def _scores(texts: list[str | None], model: Model, lexicon: Lexicon) -> np.ndarray:
    x = np.array([features(t, lexicon) for t in texts]).reshape(-1, len(model.coef))
    return 1 / (1 + np.exp(-np.clip(x @ model.coef + model.intercept, -30, 30)))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns carried. One pass, no join."""
    at_text = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.stems)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield part.filter(pa.array(_scores(part.column(at_text).to_pylist(), model, lexicon) < 0.5))

    return docs.mapInArrow(rows, docs.schema)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of each row; null and empty texts get the score of a text without any marked word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.stems)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = _scores(part.column(1).to_pylist(), model, lexicon)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(
        rows, "id bigint, score double, predicted int").withColumnRenamed("id", key)
