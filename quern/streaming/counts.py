"""Extension: incremental counts of words by Structured Streaming. Counts add up, so that each batch is merged into a table
of all before; batches that come again after a failure are left out by their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import spaced_words


def word_stream(stream: DataFrame, text: Column) -> DataFrame:
    """w: a row for each word of a stream of texts."""
    return stream.select(F.explode(spaced_words(text)).alias("w"))


def count_into(words: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes each batch's counts (batch, w, cnt) under path; `counted` sums them up."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("w").agg(F.count("*").alias("cnt"))
        # a batch that comes again replaces what it wrote
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return words.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counted(spark, path: str) -> DataFrame:
    """w, cnt over all batches so far."""
    return spark.read.option("basePath", path).parquet(path).groupBy("w").agg(F.sum("cnt").alias("cnt"))
