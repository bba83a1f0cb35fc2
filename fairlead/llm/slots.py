"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of slots. Bytes are added up per slot and a small versioned
table says which shard holds which slot. Rebalancing edits that table; records never change their slot.
Everything is DataFrame or SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.session import settle

#: Bound on the slots, so that the map (one row per slot) may always be broadcast.
MOST_SLOTS = 65536


def slot_of(key, slots: int):
    """Slot of a key given as text: the first 32 bits of its MD5, modulo the slots."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, slots: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, CRC and slot of each row, without the text.

    size is the text's UTF-8 bytes plus one; null counts as empty. A null key is replaced by the text's CRC,
    so that rows without a key spread. Other columns, whatever their names, are not carried.
    """
    if not 1 <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be 1 to {MOST_SLOTS}")
    body = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(body.cast("binary"))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("crc "), crc.cast("string")))
    return docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("bigint").alias("size"), crc.alias("text_crc32"),
        slot_of(name, slots).alias("vslot"))


def slot_totals(rows: DataFrame, slots: int = 4096) -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(sums), "vslot", "left").na.fill(0, ["bytes", "n_rows"])


def first_map(totals: DataFrame, shards: int = 8) -> DataFrame:
    """Version 1 of the map (vslot, shard, version): largest slot first, each to the shard with the fewest bytes.

    One row per slot, at most MOST_SLOTS; the walk over them is one array fold. Equal sizes go by slot
    number, equally loaded shards by shard number.
    """
    order = totals.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("todo"))
    fold = f"""
        aggregate(todo,
          named_struct('loads', array_repeat(0L, {shards}), 'placed', cast(array() as array<int>)),
          (done, x) -> named_struct(
            'loads', transform(done.loads, (v, i) ->
                if(i + 1 = array_position(done.loads, array_min(done.loads)), v - x.less, v)),
            'placed', array_append(done.placed, cast(array_position(done.loads, array_min(done.loads)) - 1 as int))),
          done -> done.placed)"""
    return order.select(F.posexplode(F.arrays_zip(
        F.transform("todo", lambda x: x["vslot"]).alias("vslot"), F.expr(fold).alias("shard")))).select(
        F.col("col.vslot").alias("vslot"), F.col("col.shard").alias("shard"), F.lit(1).alias("version"))


def grown_map(old: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of the map with one shard more, numbered ``shards``.

    Each old shard keeps its slots, lowest number first, up to an even share of all bytes; the rest move to the
    new shard. No slot moves between old shards. Windows here run over the slots of the map alone.
    """
    total = totals.agg(F.sum("bytes").alias("all_bytes"))
    upto = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)
    return (
        old.join(totals, "vslot").crossJoin(F.broadcast(total))
        .withColumn("reached", F.sum("bytes").over(upto))
        .select(
            "vslot",
            F.when(F.col("reached") * (shards + 1) > F.col("all_bytes"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
            (F.col("version") + 1).alias("version")))


def write_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version of the map to its history."""
    slot_map.write.partitionBy("version").mode("append").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    history = spark.read.schema("vslot int, shard int, version int").parquet(folder)
    if version is not None:
        return history.where(F.col("version") == version)
    return history.where(F.col("version") == history.select(F.max("version")).scalar())


def placed(rows: DataFrame, slot_map: DataFrame, totals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with their shard and their place in it, counted without gaps from 0.

    A row's place is the rows of earlier slots of its shard plus its place within its slot; no shard is ever
    sorted as a whole. Within a slot rows go by key, CRC and size; equal rows in any order.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(totals, "vslot").select(
        F.col("vslot"), "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("vslot").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    return rows.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(starts), "vslot").withColumn(
        "slot", (F.col("start") + F.col("nth") - 1).cast("bigint"))


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = 4096) -> DataFrame:
    """Each document's shard, balanced by bytes, and its place in the shard.

    Empty tables give no rows; nulls count as empty texts; repeated rows are placed one by one.
    """
    rows = settle(slotted(docs, slots), "slotted")
    totals = settle(slot_totals(rows, slots).coalesce(1), "slot-totals")
    slot_map = settle(first_map(totals, shards), "slot-map")
    return placed(rows, slot_map, totals)
