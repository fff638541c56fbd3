"""From functions of several builds to pairs of variants for training, and test tables for each build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import tables as O
from quern.operators.encode import flattened


def variants(functions: DataFrame) -> DataFrame:
    """name, h, opt: distinct bodies (name, opt, body: array of id lists) of each name, by a hash of the ids, each with its
    first build."""
    hashed = functions.select("name", "opt", F.md5(flattened(F.col("body")).cast("binary")).alias("h"))
    return hashed.groupBy("name", "h").agg(F.min("opt").alias("opt"))


def by_build(functions: DataFrame, builds: list[str], value: str) -> DataFrame:
    """name and a column for each build: null where a build lacks the name."""
    return functions.groupBy("name").pivot("opt", builds).agg(F.first(value))


def training_pairs(functions: DataFrame, seed: str) -> DataFrame:
    """name, k, v1, v2, class_id: five pairs of builds of each name's distinct bodies, and the name's number, in order."""
    pairs = O.variant_pairs(variants(functions).select("name", F.col("opt").alias("v")), "name", seed)
    classes = O.ranked(functions.select("name").distinct(), [F.col("name")], [(F.substring("name", 1, 2), False)], (), "class_id")
    return pairs.join(classes, "name")
