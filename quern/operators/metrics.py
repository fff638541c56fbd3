"""Measures of predictions and tokenisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f1(hits: Column, guessed: Column, wanted: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and their harmonic mean; 0 where there is nothing to divide by."""
    p, r = F.coalesce(F.try_divide(hits, guessed), F.lit(0.0)), F.coalesce(F.try_divide(hits, wanted), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _bags(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return a.groupBy(key, "w").agg(F.count("*").alias("x")), b.groupBy(key, "w").agg(F.count("*").alias("y"))


def multiset_f1(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, p, r, f1 of bags of words (key, w): b is the guess."""
    x, y = _bags(a, b, key)
    s = x.join(y, [key, "w"], "full").groupBy(key).agg(F.sum("x").alias("n"), F.sum("y").alias("m"), F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("hit"))
    p, r, f = f1(F.col("hit"), F.col("m"), F.col("n"))
    return s.select(key, F.round(p, 9).alias("p"), F.round(r, 9).alias("r"), F.round(f, 9).alias("f1"))


def fuzzy_f1(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, f1 of bags of words (key, w), b the guess: a guessed word that is not wanted counts with each wanted word that
    is one character longer or shorter at an end, if either has four characters or more."""
    x, y = _bags(a, b, key)
    exact = y.join(x, [key, "w"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("hit"))
    lone = y.join(x.select(key, "w"), [key, "w"], "left_anti")
    # the shorter word is the longer one without its first or last character: an equi-join on that
    cut = lambda df, n: df.select(key, n, F.col("w"), F.explode(F.array_distinct(F.array(F.expr("substring(w, 2)"), F.expr("left(w, length(w) - 1)")))).alias("core"))
    longer_guess = cut(lone, "y").where("length(w) > 3").select(key, "y", F.col("w").alias("g"), F.col("core").alias("w")).join(x, [key, "w"]).select(key, "y", "x")
    longer_wanted = cut(x, "x").where("length(w) > 3").select(key, "x", F.col("w").alias("t"), F.col("core").alias("w")).join(lone, [key, "w"]).select(key, "y", "x")
    near = longer_guess.unionByName(longer_wanted).groupBy(key).agg(F.sum(F.least("x", "y")).alias("near"))
    sizes = x.groupBy(key).agg(F.sum("x").alias("n")).join(y.groupBy(key).agg(F.sum("y").alias("m")), key, "full")
    s = sizes.join(exact, key, "left").join(near, key, "left")
    _, _, f = f1(F.coalesce("hit", F.lit(0)) + F.coalesce("near", F.lit(0)), F.col("m"), F.col("n"))
    return s.select(key, F.round(f, 9).alias("f1"))


def replaced(target: Column, guess: Column, clusters) -> Column:
    """guess with each word that is not wanted, but shares a cluster with a wanted one, as the first such word.

    clusters: a column function that gives a word's clusters as an array, null if it has none.
    """
    share = lambda t, p: F.coalesce(F.arrays_overlap(clusters(t), clusters(p)), F.lit(False))
    one = lambda p: F.when(F.array_contains(target, p), p).otherwise(F.coalesce(F.get(F.filter(target, lambda t: share(t, p)), F.lit(0)), p))
    return F.transform(guess, one)


def set_counts(target: Column, guess: Column) -> Column:
    """A struct of tp, fp and fn: equal lists count each of their words, others as sets."""
    same = target == guess
    n = lambda x: F.size(x).cast("long")
    return F.struct(
        F.when(same, n(target)).otherwise(n(F.array_intersect(target, guess))).alias("tp"),
        F.when(same, F.lit(0).cast("long")).otherwise(n(F.array_except(guess, target))).alias("fp"),
        F.when(same, F.lit(0).cast("long")).otherwise(n(F.array_except(target, guess))).alias("fn"),
    )


def micro(rows: DataFrame, *by: str) -> DataFrame:
    """by, tp, fp, fn, p, r, f1 over rows with tp, fp and fn."""
    s = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r, f = f1(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    none = (F.col("tp") + F.col("fp") == 0) | (F.col("tp") + F.col("fn") == 0)
    zero = lambda x: F.round(F.when(none, F.lit(0.0)).otherwise(x), 9)
    return s.select(*by, "tp", "fp", "fn", zero(p).alias("p"), zero(r).alias("r"), zero(f).alias("f1"))


def masked_accuracy(rows: DataFrame, guess: Column, label: Column, ignored: int = -100) -> DataFrame:
    """acc, n: the share of labels that are guessed, without ignored ones."""
    seen = rows.where(label != ignored)
    return seen.agg(F.round(F.avg((guess == label).cast("int")), 9).alias("acc"), F.count("*").alias("n"))


def entropy(counts: DataFrame, by: str) -> DataFrame:
    """by, h, anti: entropy in bits of counts (by, cnt), over log2 of their number where that is above two, and 1 less it."""
    t = counts.groupBy(by).agg(F.sum("cnt").alias("n"), F.count("*").alias("k"))
    h = -F.sum(F.col("cnt") / F.col("n") * F.log2(F.col("cnt") / F.col("n")))
    out = counts.join(t, by).groupBy(by, "k").agg(h.alias("h"))
    out = out.select(by, F.round(F.when(F.col("k") > 2, F.col("h") / F.log2("k")).otherwise(F.col("h")), 9).alias("h"))
    return out.withColumn("anti", F.round(1 - F.col("h"), 9))


def compression(tokens: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """by, ratio: 1 less what a lexicon of the distinct tokens and a number for each token take, over the texts' lengths.

    tokens: by, w; texts: by, text. Raises if the tokens' lengths do not add up to the texts'.
    """
    kinds = tokens.groupBy(by, "w").agg(F.count("*").alias("n"))
    t = kinds.groupBy(by).agg(F.sum(F.length("w")).alias("lexicon"), F.sum("n").alias("tokens"), F.sum(F.length("w") * F.col("n")).alias("held"))
    n = texts.groupBy(by).agg(F.sum(F.length("text")).alias("size"))
    ratio = F.when(F.col("held") != F.col("size"), F.raise_error(F.lit("tokens do not make up their texts"))).otherwise(1 - (F.col("lexicon") + F.col("tokens")) / F.col("size"))
    return t.join(n, by).select(by, F.round(ratio, 9).alias("ratio"))


def mean_of(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """by, mean of a column to two digits, halves to the even one."""
    return rows.groupBy(*by).agg(F.bround(F.avg(column), 2).alias("mean"))
