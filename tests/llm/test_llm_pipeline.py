"""The pipeline against plain versions of its stages, and the registered queries."""

import hashlib
import os

import pytest

import corpus_pipeline
from fairlead.llm import bpe, decontaminate, queries, secretscan, simhash, tables, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_pipeline_matches_plain_stages(spark):
    tables.prepare_session(spark)
    docs = tables.table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, tables.table(spark, SF, "labels"))
    lexicon = toxicity.Lexicon(model.stems)
    rows = {k: t for k, t in rows.items() if toxicity._scores([t], model, lexicon)[0] < 0.5}
    fps = {k: simhash.fingerprint(t) for k, t in rows.items()}
    root = {k: k for k in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    rows = {k: t for k, t in rows.items() if root[k] == k}
    items = decontaminate.prepare([(r["item_id"], r["text"]) for r in tables.table(spark, SF, "benchmark").collect()])
    keys = sorted(rows)
    hits = {keys[h[0]] for h in decontaminate.find(items, [rows[k] for k in keys])}
    rows = {k: secretscan.redacted(t) for k, t in rows.items() if k not in hits}
    tok = bpe.tokenizer(*bpe.vocabulary())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(rows)
    for k, t in rows.items():
        assert got[k]["ids"] == tok.encode(t) and got[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_take_empty_and_odd_tables(spark):
    docs = tables.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, "s", 0), (2, "a b", "en", None, 3), (2, "a b", "en", None, 3)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, SF)
        counts.append(odd.count())
    assert counts == [5, 3, 3, 3, 3]


def test_ids_that_repeat_across_groups_lose_no_group(spark):
    first, second, third = (" ".join(f"{x}{i}" for i in range(60)) for x in ("apple", "stone", "river"))
    rows = [(7, first), (3, second), (7, second), (7, third), (9, third), (None, third), (None, third)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(7, first), (3, second), (7, third), (None, third), (None, third)], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    from check import compare, duck
    ok, text = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, text
