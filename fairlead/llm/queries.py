"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import align, bpe, decontaminate, htmltext, langid, outliers, pii, secretscan, simhash, slots, toxicity, warc, whiten
from fairlead.llm.tables import id_crc, prepare_session, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Key of the registered pseudonym query. A real job passes its own, from a secret store.
PII_KEY = "registered query"


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


@query("op1_toxicity_grammar")
def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op2_mcd_outliers")
def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on all documents."""
    return outliers.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op3_cgk_decontamination")
def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_layered_secrets")
def op4_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, in the text and in its decoded layers."""
    return secretscan.scan_secrets(table(spark, sf_dir, "documents"))


@query("op5_anchor_simhash")
def op5_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_tree_bpe")
def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    vocab = bpe.vocabulary()
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, keep_text=False)
    return bpe.decode(encoded, vocab).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_warc_ranges", """
    with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
    f as (select payload_digest as d, min(page_id) as first from p where payload_bytes >= 100 group by 1)
    select page_id, payload_bytes, payload_digest,
           case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
           case when first is not null and page_id is distinct from first then first end as refers_to
    from p left join f on payload_digest = d""")
def op7_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op8_piece_langid")
def op8_piece_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the rows that are not held out."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(F.coalesce(id_crc() % 4 != 2, F.lit(True))), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: CRC-32 by its table, bytes from the hexadecimal text; then the walk over the slots, largest first.
_SLOTS_SQL = """
with recursive polynomial as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
body as (select doc_id, coalesce(text, '') as text from documents),
coded as (select doc_id, strlen(text) + 1 as size, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as text_crc32 from body, polynomial),
placed as materialized (select *, (('0x' || substr(md5(coalesce(doc_id::varchar, 'crc ' || text_crc32)), 1, 8))::bigint % 4096)::int
    as vslot from coded),
totals as materialized (select s::int as vslot, coalesce(sum(size), 0)::bigint as bytes, row_number() over (
    order by coalesce(sum(size), 0) desc, s) as k from range(4096) r(s) left join placed on vslot = s group by s),
walk as (
  select 0::bigint as k, list_transform(range(8), lambda i: 0::bigint) as loads, -1 as vslot, 0 as shard
  union all
  select t.k, list_transform(loads, lambda v, i: case when i = list_position(loads, list_min(loads)) then v + t.bytes else v end),
    t.vslot, list_position(loads, list_min(loads))::int - 1
  from walk w join totals t on t.k = w.k + 1)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (
    partition by shard order by vslot, doc_id nulls first, text_crc32, size) - 1 as slot, null::int as grown_shard, vslot
from placed join walk using (vslot)"""


@query("op9_virtual_slots", _SLOTS_SQL)
def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    return slots.shard_documents(table(spark, sf_dir, "documents"), shards=8, slots=4096).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query("op10_feistel_pseudonyms")
def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal numbers, dates and addresses replaced."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY).select(
        "doc_id", "text", F.size("pii_kinds").cast("bigint").alias("n_pii"), F.array_join("pii_kinds", ",").alias("kinds"))


@query("op11_gkl_whitening")
def op11_gkl_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid embeddings whitened on up to 16 components of the covariance of their distinct whole-number vectors."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op12_spill_alignment")
def op12_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of both public vocabularies aligned over all documents, with corpus-wide pair counts."""
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_ttr_extraction")
def op13_ttr_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
