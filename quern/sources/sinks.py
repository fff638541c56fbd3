"""Writers of the text formats and of tables."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import without_angles
from quern.operators.ranks import ranked, running
from quern.operators.skipgram import WordVectors
from quern.sources import files


def _one_file(rows: DataFrame, order: list, path: str) -> None:
    """A column of text as lines of a file, in order: for results that one reader takes whole."""
    rows.repartition(1).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def numbered_graphs(nodes: DataFrame, edges: DataFrame, labels: DataFrame, width: int = 4096) -> files.Graphs:
    """Tables (graph_id, node, text), (graph_id, src, dst), (graph_id, label) with nodes numbered from 1 over all graphs, in
    the order of graphs and nodes, and edges in both directions; graphs are numbered from 1, too."""
    g = ranked(labels, [F.col("graph_id")], [(F.floor(F.col("graph_id") / width), False)], (), "_graph").select("graph_id", "label", "_graph")
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    offsets = running(sizes, "n", [F.col("graph_id")], F.floor(F.col("graph_id") / width)).select("graph_id", "before")
    own = ranked(nodes, [F.col("node")], [(F.lit(0), False)], ("graph_id",), "_r").join(offsets, "graph_id").join(g, "graph_id")
    out = own.select(F.lit("").alias("binary"), (F.col("before") + F.col("_r")).alias("node_id"), F.col("_graph").alias("graph_id"), "text", F.col("graph_id").alias("_own"), "node")
    a = out.select(F.col("_own").alias("graph_id"), F.col("node").alias("src"), F.col("node_id").alias("i"), F.col("graph_id").alias("_graph"))
    b = out.select(F.col("_own").alias("graph_id"), F.col("node").alias("dst"), F.col("node_id").alias("j"))
    one = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    both = one.select("_graph", "i", "j").unionByName(one.select("_graph", F.col("j").alias("i"), F.col("i").alias("j")))
    both = both.select(F.lit("").alias("binary"), F.col("_graph").alias("graph_id"), F.col("i").alias("src"), F.col("j").alias("dst"))
    return files.Graphs(out.drop("_own", "node"), both, g.select(F.lit("").alias("binary"), F.col("_graph").alias("graph_id"), "label"), out.where("false").select("binary", "graph_id", F.lit(0).alias("pos"), "text"))


def write_graphs(graphs: files.Graphs, root: str, binary: str) -> None:
    """The files of one binary, each a folder with a part file of the name's end: nodes by number, graphs by number."""
    at = lambda end: f"{root}/{binary}{end}"
    line = lambda *c: F.concat_ws(",", *(F.col(x).cast("string") for x in c)).alias("value")
    _one_file(graphs.nodes.select("node_id", line("graph_id")), ["node_id"], at(files.INDICATOR))
    _one_file(graphs.nodes.select("node_id", F.col("text").alias("value")), ["node_id"], at(files.ATTRIBUTES))
    _one_file(graphs.edges.select("src", "dst", line("src", "dst")), ["src", "dst"], at(files.EDGES))
    _one_file(graphs.labels.select("graph_id", F.col("label").alias("value")), ["graph_id"], at(files.LABELS))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    _one_file(graphs.instructions.groupBy("graph_id").agg(F.array_join(texts, "\t").alias("value")), ["graph_id"], at(files.INSTRUCTIONS))


def append_pairs(pairs: DataFrame, path: str) -> None:
    """Adds pairs (pairs: array of texts) to a corpus, one a line; those of a character or less are left out."""
    each = pairs.select(F.explode("pairs").alias("value")).where(F.length("value") > 1)
    each.write.mode("append").text(path)


def pair_line(name: Column, pairs: Column) -> Column:
    """A record of a pair file: the name, then pairs, by semicolons."""
    return F.concat_ws(";", name, pairs)


def write_lexicon(counts: DataFrame, path: str) -> None:
    """word, weight by tabs, sorted by word; ranges of words make the files."""
    sorted_counts = counts.select("word", "weight").repartitionByRange("word").sortWithinPartitions("word")
    sorted_counts.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def save_table(rows: DataFrame, path: str, *by: str) -> None:
    """A table in place of pickled objects: it splits, and reading it runs nothing."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prediction_lines(target: Column, guess: Column) -> Column:
    """What was expected and got, without special tokens, as two lines and an empty one."""
    words = lambda x: F.array_join(without_angles(x), " ")
    return F.concat(F.lit("- expected: "), words(target), F.lit("\n- got: "), words(guess), F.lit("\n"))


def write_predictions(rows: DataFrame, path: str) -> None:
    """rows: target and guess, arrays of words."""
    rows.select(prediction_lines(F.col("target"), F.col("guess")).alias("value")).write.mode("overwrite").text(path)


def write_related(rows: DataFrame, path: str) -> None:
    """word and its related words (related: array), by a tab, each with a blank after it; words without any are left out."""
    line = F.concat(F.col("word"), F.lit("\t"), F.array_join(F.transform("related", lambda x: F.concat(x, F.lit(" "))), ""))
    rows.where(F.size("related") > 0).select(line.alias("value")).write.mode("overwrite").text(path)


def logger(path: str | None = None, name: str = "quern", echo: bool = True) -> logging.Logger:
    """A log that appends to a file and, if wanted, echoes."""
    out = logging.getLogger(f"{name}.{path or '-'}")
    if not out.handlers:
        out.setLevel(logging.INFO)
        out.propagate = False
        for handler in ([logging.FileHandler(path)] if path else []) + ([logging.StreamHandler()] if echo else []):
            handler.setFormatter(logging.Formatter("%(message)s"))
            out.addHandler(handler)
    return out


def save_vectors(model: WordVectors, path: str) -> None:
    """Word vectors as a table (word, v)."""
    model.rows.write.mode("overwrite").parquet(path)


def load_vectors(path: str) -> WordVectors:
    return WordVectors(SparkSession.active().read.parquet(path))
