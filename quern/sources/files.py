"""Readers of the text formats: graphs in files whose lines belong together by number, pair corpora, lexicons, lists.

Formats couple lines of several files by their number. A file is one split here (its lines are numbered as they stand), so
that numbers have no gaps; files are many and small, one set for each binary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import trimmed

#: The ends of the files that describe a binary's graphs.
EDGES, INDICATOR, ATTRIBUTES, LABELS, INSTRUCTIONS = "_cfg_A.txt", "_cfg_graph_indicator.txt", "_cfg_node_attributes.txt", "_cfg_graph_labels.txt", "_inst.txt"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column, last: int, first: int = 0) -> Column:
    """A file's name without its first and last parts, by underscores."""
    parts = F.split(base_name(path), "_")
    return F.array_join(F.slice(parts, first + 1, F.greatest(F.size(parts) - last - first, F.lit(0))), "_")


def level_path(path: Column, level: str, base: str = "O0") -> Column:
    """The path for another optimisation level: every place of the base level in it."""
    return F.replace(path, F.lit(base), F.lit(level))


def partner_path(path: Column, kind: str = "_cfg_", other: str = "_dfg_") -> Column:
    """The path of the same binary's file of another kind, in the same folder."""
    return F.concat(folder(path), F.lit("/"), F.replace(base_name(path), F.lit(kind), F.lit(other)))


def paths(spark: SparkSession, root: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """path, length: files under a folder whose names match. Only names and sizes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", glob).load(root)
    return found.select("path", "length")


def candidates(spark: SparkSession, root: str, ends: tuple[str, ...] = (), magic: dict[str, bytes] | None = None) -> DataFrame:
    """path, kind: files by the ends of their names, or by their first bytes. Nothing is deleted or started."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.lit(None).cast("string")
    for e in ends:
        kind = F.when(F.col("path").endswith(e), e).otherwise(kind)
    for name, start in (magic or {}).items():
        kind = F.coalesce(kind, F.when(F.substring("content", 1, len(start)) == F.lit(bytearray(start)), name))
    return rows.select("path", kind.alias("kind")).where("kind IS NOT NULL")


def lines(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """path, line_no (from 1), line: of files, each read whole. A line end after the last line makes no line."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    text = F.regexp_replace("value", "\r\n", "\n")
    rows = whole.select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace(text, "\n$", ""), "\n").alias("l"), "value").where("value <> ''")
    return rows.select("path", F.posexplode("l").alias("n", "line")).select("path", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path: one a line."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("path")).where("path <> ''")


def half(rows: DataFrame, order: str) -> DataFrame:
    """The first half of some rows, rounded down: the small form of a list."""
    return rows.orderBy(order).limit(rows.count() // 2)


@dataclass(frozen=True)
class Graphs:
    """Tables of a set of binaries: nodes (binary, node_id, graph_id, text), edges (binary, graph_id, src, dst), labels
    (binary, graph_id, label), instructions (binary, graph_id, pos, text)."""

    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame
    instructions: DataFrame


def graphs(spark: SparkSession, root: str) -> Graphs:
    """Reads the five files of each binary under a folder: lines with one number belong together.

    Edges hang on the graph of their first node. Raises if a binary has another number of labels than of graphs.
    """

    def part(end: str) -> DataFrame:
        rows = lines(spark, root, f"*{end}").where(~base_name(F.col("path")).startswith("raw_"))
        return rows.select(F.regexp_replace("path", f"{end}$", "").alias("binary"), "line_no", "line")

    indicator = part(INDICATOR).select("binary", F.col("line_no").alias("node_id"), trimmed(F.col("line")).cast("long").alias("graph_id"))
    attributes = part(ATTRIBUTES).select("binary", F.col("line_no").alias("node_id"), trimmed(F.col("line")).alias("text"))
    nodes = indicator.join(attributes, ["binary", "node_id"], "left")
    ends = F.split("line", ",")
    edges = part(EDGES).select("binary", F.get(ends, 0).cast("long").alias("src"), F.get(ends, 1).cast("long").alias("dst"))
    edges = edges.join(indicator.select("binary", F.col("node_id").alias("src"), "graph_id"), ["binary", "src"]).select("binary", "graph_id", "src", "dst")
    labels = part(LABELS).select("binary", F.col("line_no").alias("graph_id"), trimmed(F.col("line")).alias("label"))
    sizes = indicator.groupBy("binary").agg(F.max("graph_id").alias("n")).join(labels.groupBy("binary").agg(F.count("*").alias("m")), "binary", "full")
    wrong = sizes.where("NOT (n <=> m)").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['binary']} has {wrong[0]['n']} graphs and {wrong[0]['m']} labels")
    instructions = part(INSTRUCTIONS).select("binary", F.col("line_no").alias("graph_id"), F.posexplode(F.split(trimmed(F.col("line")), "\t")).alias("pos", "text"))
    return Graphs(nodes, edges, labels, instructions)


def pair_records(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, pairs: records `name;pair;pair` of two pairs or more; of records of one name in a file the first."""
    fields = F.split(trimmed(F.col("line")), ";")
    rows = lines(spark, path, glob).select("path", "line_no", F.get(fields, 0).alias("name"), F.slice(fields, 2, 1 << 30).alias("pairs"))
    return rows.where(F.size("pairs") > 1).groupBy("path", "name").agg(F.min_by("pairs", "line_no").alias("pairs"))


def pair_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, left, right: pairs by tabs, a pair a line."""
    f = F.split(trimmed(F.col("line")), "\t")
    return lines(spark, path).select("path", "line_no", F.get(f, 0).alias("left"), F.get(f, 1).alias("right"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, weight: by tabs, without a heading; words that look like missing values are words."""
    reader = spark.read.schema("word STRING, weight DOUBLE").option("sep", "\t").option("quote", "").option("nullValue", "\u0000").option("emptyValue", "")
    return reader.csv(path)


def word_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line: of the files in a folder, not of those below it."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """word, clusters: from JSON objects of words and lists."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("word", "clusters"))
    return rows.select("word", "clusters")
