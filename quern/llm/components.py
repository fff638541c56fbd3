"""Connected components of a link table, distributed: alternating large-star and small-star rounds.

Kiveris et al., "Connected components in MapReduce and beyond" (2014). Each round is two aggregations with map-side
combine and two joins; its result is checkpointed. Nodes with very many neighbours are dealt over tasks by a salt.
Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, hot_keys, salted, spread

ROUNDS = 40


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m of least (a, m, n), where n counts a's edges."""
    hot = hot_keys(least, ["a"])
    return salted(edges, hot, ["a"], F.col("b")).join(spread(least.drop("n"), hot, ["a"]), ["a", "salt"])


def connected(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """links: a, b long. node, component: every node that reaches a smaller one, and the smallest it reaches."""
    edges = checkpoint(_tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    before = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = checkpoint(_tidy(_to_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        # each edge points down now: a's smaller neighbours and a itself move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _to_least(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpoint(_tidy(small))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
