"""Jump consistent hashing (Lamping and Veach, 2014) in SQL functions: key and shard count decide the shard.

No ring table is kept. Appending a shard moves only the rows that land on it, 1/(n+1) of all. Slots number the rows of
a shard: each shard is ranked in parts, and the parts' sizes are summed up, so that no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpoint

SHARDS = 24
#: Parts that each shard is ranked in.
SLOT_PARTS = 256

#: The multiplier of the published generator in 16-bit limbs, lowest first (2862933555777941757).
LIMBS = (0xB0FD, 0x87B0, 0x2EE6, 0x27BB)
LOW32 = 0xFFFFFFFF


def _next(key: Column) -> Column:
    """key * 2862933555777941757 + 1 modulo 2^64, without overflow: partial products stay below 2^52."""
    k0, k1 = key.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(key, 32)
    c0, c1, c2, c3 = (F.lit(c).cast("long") for c in LIMBS)
    up = lambda x: F.shiftleft(x.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    low = k0 * c0 + up(k0 * c1) + F.lit(1).cast("long")
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(k0 * c1, 16) + k0 * c2 + up(k0 * c3) + k1 * c0 + up(k1 * c1)
    return F.shiftleft(high.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to shards - 1, as the published function gives it."""
    if shards < 1:
        raise ValueError("there must be a shard")
    land = lambda s: F.floor((s["b"] + 1) * (F.lit(2.0**31) / (F.shiftrightunsigned(s["key"], 33) + 1).cast("double")))
    step = lambda s, _: F.when(land(s) < shards, F.struct(_next(s["key"]).alias("key"), land(s).cast("long").alias("b"))).otherwise(s)
    start = F.struct(_next(key).alias("key"), F.lit(0).cast("long").alias("b"))
    if shards == 1:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["b"].cast("int")


def key_of(doc_id: Column) -> Column:
    """Mixes ids, which often follow each other; a null id has a key too."""
    return F.xxhash64(doc_id)


def assign(docs: DataFrame, shards: int = SHARDS, parts: int = SLOT_PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per row of docs.

    size: UTF-8 bytes plus 8; a null text has no bytes, and very long ones count whole. Rows with equal doc_id, or none,
    share a shard, which is ranked in parts, and have slots of their own; so have repeated rows. slot runs from 0 without
    gaps in each shard; grown_shard is the shard with one more. An empty table gives no rows. Other columns, of whatever
    name, are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(F.col("doc_id").cast("long")).alias("key"))
    rows = rows.withColumn("shard", jump_hash(F.col("key"), shards)).withColumn("grown_shard", jump_hash(F.col("key"), shards + 1))
    # rows are dealt to parts by their place, so that a shard's parts are equal whatever its keys
    rows = checkpoint(rows.drop("key").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")))
    sizes = rows.groupBy("shard", "part").count()
    before = sizes.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("rank", rank).join(before, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") + F.col("before")).cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes all columns of docs under path/shard=k, in the order of doc_id within a file."""
    keyed = docs.withColumn("shard", jump_hash(key_of(F.col("doc_id").cast("long")), shards))
    keyed.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path)


def query(docs: DataFrame) -> DataFrame:
    """The rows of assign(), for the number of shards that the contract fixes."""
    return assign(docs)
