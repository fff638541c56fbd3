"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import mixing, packing, quality, simhash, substrings
from quern.llm.common import checkpoint, materialise, table

#: Parts of the training time that are packed apart, so that sequences keep the order of the mix.
TIMES = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base tests or the learned rules reject go; all columns stay.

    Null, empty and short texts fail the base tests. Very long texts are judged whole. Repeated rows are judged each, an
    empty table stays empty, and no column's name matters but doc_id's and text's.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; all columns stay.

    Texts without words are copies of each other. Very long texts are compared whole. Of repeated rows one stays; rows
    without a doc_id stay. An empty table stays empty, and no column's name matters but doc_id's and text's.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that are found elsewhere go from the texts; all rows and columns stay.

    Null, empty and short texts stay as they are. Very long texts are taken whole. Repeated rows are documents of their
    own. An empty table stays empty, and no column's name matters but doc_id's, text's and n_chars'.
    """
    return substrings.cleaned(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their targets: a row for each copy that is taken, in training order, with all columns.

    Documents without words are never taken, and go. Rows without a source are a source of their own. Very long texts are
    cut like others where their source's demand ends. Repeated rows are documents of their own. An empty table stays
    empty, and no column's name matters but doc_id's, source's, text's and n_chars'.
    """
    return mixing.training_order(docs)


def _time(docs: DataFrame) -> DataFrame:
    """doc_id, text and time, 0 to TIMES - 1: the part of the rows, in the order of their files, that a row is in."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files: partitions stand for them
        at = F.monotonically_increasing_id()
        rows = docs.select("doc_id", "text", at.alias("at"))
        rows = rows.select("doc_id", "text", F.format_string("%08d", F.shiftright("at", 33)).alias("file"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("row"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    n = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row per file
    time = F.least(F.floor((F.col("before") + F.col("row")) * TIMES / max(n, 1)), F.lit(TIMES - 1)).cast("int")
    # texts stay where they are read
    return rows.join(F.broadcast(before), "file").select("doc_id", "text", time.alias("time"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences, whose numbers follow the training order in TIMES steps.

    doc_id, time, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts have the end id alone. Longer
    texts than a sequence are cut. Repeated rows are documents of their own. An empty table gives no rows, and no column's
    name matters but doc_id's and text's.
    """
    return packing.pack(checkpoint(packing.pieces(_time(docs), carried=("time",), room=1 << 20, keep=False)), by="time")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The rules are learned and ids come from a tokenizer: SQL can't express it. Tested against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
