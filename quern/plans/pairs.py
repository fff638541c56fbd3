"""From walks and records to aligned pair corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import tables as O
from quern.sources import files


def walk_pairs(walks: DataFrame, key: list[str], token: str, reach: int = 2, least: int = 4) -> DataFrame:
    """left, right, n: pairs up to `reach` steps apart of walks (key, step, token) of `least` steps or more."""
    rows = walks.withColumn("_walk", F.concat_ws("\u0000", *(F.col(k).cast("string") for k in key)))
    return O.context_pairs(rows, "_walk", ["step"], token, reach, least)


def allowed(paths: DataFrame, names: DataFrame, drop: int = 3) -> DataFrame:
    """path, partner: files whose base name, without its last parts, is in a list (name), and the other kind's file."""
    own = paths.withColumn("name", files.stem(F.col("path"), drop))
    return own.join(names.select("name").distinct(), "name", "left_semi").select("path", files.partner_path(F.col("path")).alias("partner"))


def aligned_records(cfg: DataFrame, dfg: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cfg, dfg: lists of pairs (keys, pairs) of the records that both sides have, cut to the shorter."""
    both = cfg.select(*keys, F.col("pairs").alias("a")).join(dfg.select(*keys, F.col("pairs").alias("b")), keys)
    n = F.least(F.size("a"), F.size("b"))
    return both.select(*keys, F.slice("a", F.lit(1), n).alias("cfg"), F.slice("b", F.lit(1), n).alias("dfg"))


def split_files(paths: DataFrame, seed: str = "0", held: float = 0.05) -> DataFrame:
    """path, part: train and val, the latter's share rounded up."""
    return O.split_exact(paths, "path", seed, {"train": 1 - held}, "val")
