"""Mixing sources to target weights over a time-varying curriculum.

Each source is a stream of words: its documents in the order of a hash, over and over. Its share of the mix is a weight
that changes with training time t from 0 to 1: w(t) = share * (1 + drift * (2t - 1)). The integral over [0, t] is the
source's cumulative demand, and its inverse gives each document the time at which its words are due. Documents are
range-sorted by that time. A document is taken once per round of the stream; the last one is cut where demand ends.

Streams are summed up in two levels (parts of a source, then documents of a part), so that no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, n_words, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
#: How each source's weight leans over time, by its rank, repeating: late, early, even.
DRIFT = (0.5, -0.5, 0.0)
SEED = 17
#: Bits of the hash that part a stream: 1024 parts a source.
PART_BITS = 10


def _prepared(rows: DataFrame, source: Column, doc_id: Column, text: Column) -> DataFrame:
    # the text parts rows that share an id, or have none
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id, text), 1)
    # null and text sources must not meet; "=" keeps the order of code points
    rows = rows.withColumn("_source", F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source)))
    return rows.withColumn("_null", source.isNull()).withColumn("_id", doc_id).withColumn("_size", n_words(text)).withColumn("_u", u).withColumn("_part", F.shiftright(F.col("_u"), 63 - PART_BITS).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_source, source_size, target, rank. sizes: _source, _null, source_size, one row per source.

    share * (sum of sizes) is dealt by weight; a target stops at most * size and its excess goes to the others by
    weight. As sources run full in the order of size / weight, the level they are filled to is found in one pass.
    """
    all_rows = Window.partitionBy()  # of sources, not of documents
    rank = F.row_number().over(Window.orderBy("_null", "_source")) - 1
    s = sizes.withColumn("rank", rank).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(share)).withColumn("w_all", F.sum("w").over(all_rows))
    s = s.withColumn("full", F.sum("cap").over(by_fill) - F.col("cap")).withColumn("rest", F.col("w_all") - F.sum("w").over(by_fill) + F.col("w"))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    # the first source that isn't full sets the level
    s = s.withColumn("level", F.min_by(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level")), F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("full"))).over(all_rows))
    return s.select("_source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"), "rank")


def due(q: Column, drift: Column) -> Column:
    """Time at which a source has given the part q of its target: inverse of t + drift * (t^2 - t)."""
    b = 1 - drift
    return F.when(q <= 0, F.lit(0.0)).otherwise(2 * q / (b + F.sqrt(b * b + 4 * drift * q)))


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, drift: tuple[float, ...] = DRIFT) -> DataFrame:
    """Prepared rows with source_size, target, taken and copies: an array of (epoch, taken, position) of what is taken.

    rows is computed twice and must not change between (a table or checkpoint).
    """
    parts = rows.groupBy("_source", "_null", "_part").agg(F.sum("_size").alias("size"))
    sizes = parts.groupBy("_source", "_null").agg(F.sum("size").alias("source_size"))
    before = F.sum("size").over(Window.partitionBy("_source").orderBy("_part")) - F.col("size")
    offsets = parts.select("_source", "_part", before.alias("before")).join(targets(sizes, weights, share, most), "_source")
    at = F.sum("_size").over(Window.partitionBy("_source", "_part").orderBy("_u", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    out = rows.withColumn("_at", at).join(offsets, ["_source", "_part"]).withColumn("_at", F.col("_at") + F.col("before"))
    lean = F.element_at(F.array(*map(F.lit, drift)), (F.col("rank") % len(drift) + 1).cast("int"))
    whole = F.round("target").cast("long")
    copies = []
    for e in range(most):
        first = F.col("_at") + F.lit(e) * F.col("source_size")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), whole - first))
        copies.append(F.struct(F.lit(e).alias("epoch"), taken.alias("taken"), due(first / F.greatest("target", F.lit(1.0)), lean).alias("position")))
    out = out.withColumn("copies", F.filter(F.array(*copies), lambda c: c["taken"] > 0))
    return out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["taken"]))


def query(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of the first copy (null if not taken), sorted by position.

    Null and blank texts have size 0 and are never taken. Very long texts count whole. Repeated rows are documents of
    their own. Rows without a source are a source of their own. An empty table gives no rows. Other columns, of whatever
    name, are ignored. The sources' targets are found in one task, which holds a row for each source.
    """
    rows = _prepared(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")), F.col("source"), F.col("doc_id"), F.col("text"))
    rows = checkpoint(rows.select("_id", "_source", "_null", "_size", "_u", "_part"))
    mixed = mix(rows, **options)
    first = F.when(F.size("copies") > 0, F.col("copies")[0]["position"])
    out = mixed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken", first.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: a row of docs for each copy taken, range-sorted by position; a cut copy has its first words.

    Documents without words are never taken, and go. n_chars, where there is one, follows the text.
    """
    columns = docs.columns
    row = docs.select(F.struct(*docs.columns).alias("row"))
    rows = _prepared(row, F.col("row.source").cast("string"), F.col("row.doc_id").cast("long"), F.col("row.text").cast("string"))
    mixed = mix(rows, **options).select("row", "_size", F.explode("copies").alias("c"))
    start = F.array_join(F.slice(words(F.col("row.text").cast("string")), 1, F.col("c.taken").cast("int")), " ")
    out = mixed.select("row", F.when(F.col("c.taken") < F.col("_size"), start).alias("cut"), F.col("c.position").alias("position"))
    new = {"text": F.coalesce("cut", "row.text"), "n_chars": F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut"))} if "n_chars" in columns else {"text": F.coalesce("cut", "row.text")}
    out = out.orderBy("position", "row.doc_id")
    return out.select(*((new[c] if c in new else F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in columns))
