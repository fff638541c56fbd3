"""Quality rules as a learned decision list.

Statistics of every text are SQL functions. Sequential covering (as in Cohen's RIPPER) learns from labelled statistics:
a rule grows by the threshold condition with the best information gain, is pruned on rows held back, and is kept if it
is precise there; the rows it covers go, and the next rule is grown. The list becomes one ordered conditional
expression. A document no rule rejects is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, fewest, words

#: Labelled rows that rules are learned from, at most; chosen by a hash of doc_id.
MAX_LABELLED = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule must be so precise on the rows held back, and cover so many there.
LEAST_PRECISION = 0.8
LEAST_COVER = 5
CUTS = 64
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text."""
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    twice = lambda s: F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
    cover = lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), v + 3) - v)), F.lit(0).cast("long"), lambda n, x: n + x)
    return let(F.sort_array(grams), lambda s: let(F.sort_array(twice(s)), cover))


def statistics(text: Column) -> Column:
    """A struct of the base counts and what the ratios need; a null text is an empty one."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = lambda pattern: F.length(F.regexp_replace(plain, pattern, "")).cast("long")

    def stats(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    base = let(words(plain), stats)
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        base.alias("base"),
        by_line.alias("lines"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        kept(r"[^A-Z]+").alias("n_upper"),
        kept(r"[^0-9]+").alias("n_digits"),
        kept(r"[^.,;:!?]+").alias("n_marks"),
    )


#: Ratios that rules may test.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the features of every row of docs."""
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("s"))
    s = s.select("doc_id", "s.base.*", "s.lines.*", "s.n_symbols", "s.n_upper", "s.n_digits", "s.n_marks")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumns({f"f_{k}": F.expr(e) for k, e in FEATURES.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(f"f_{self.feature}")
        return c >= self.threshold if self.above else c <= self.threshold

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for c in rule:
        m &= c.covers(x)
    return m


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    m = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[m]).any():
        p, n = bad[m].sum(), m.sum()
        best, gain = None, 1e-9
        for f, v in x.items():
            held, y = v[m], bad[m]
            for t in np.unique(np.quantile(held[y], np.linspace(0, 1, CUTS))) if p else []:
                for above in (True, False):
                    got = held >= t if above else held <= t
                    p1, n1 = y[got].sum(), got.sum()
                    if p1 and n1 < n:
                        g = p1 * (np.log2(p1 / n1) - np.log2(p / n))
                        if g > gain:
                            best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        m &= best.covers(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        m = _covers(r, x, len(bad))
        return (2 * bad[m].sum() - m.sum()) / max(1, m.sum())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[Rule]:
    """Rules for bad rows, in the order they were found. order: a hash; two thirds grow rules, a third prunes them."""
    grow = order % 3 != 0
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES:
        g, h = left & grow, left & ~grow
        if bad[g].sum() < LEAST_COVER:
            break
        pick = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = _prune(_grow(*pick(g)), *pick(h))
        if not rule:
            break
        m = _covers(rule, x, len(bad))
        held = m & h
        if held.sum() < LEAST_COVER or bad[held].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~m
    return rules


def fit(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """Learns from at most `most` labelled rows that pass the base tests, chosen by a hash. labels: doc_id, quality.

    Without labels, or with one class only, there are no rules. Rows with a null label or id are left out; the lowest
    label of an id counts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = fewest(known, "quality", most)  # rows that fail the base tests among them are not replaced
    h = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    # of rows that share an id the one whose statistics sort first, so that no more than `most` are collected
    row = F.struct(h.alias("h"), "quality", *(f"f_{f}" for f in FEATURES))
    found = stats.where("NOT base_failed").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(row).alias("v")).select("v.*").collect()
    rows = sorted(found, key=tuple)
    if not rows:
        return []
    x = {f: np.array([r[f"f_{f}"] for r in rows]) for f in FEATURES}
    return learn(x, np.array([r["quality"] == 0 for r in rows]), np.array([r["h"] for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """The decision list: false at the first rule that holds, true at its end."""
    out = F.lit(True)
    for rule in reversed(rules):
        held = rule[0].column()
        for c in rule[1:]:
            held &= c.column()
        out = F.when(held, F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = checkpoint(measured(docs))
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(fit(stats, labels)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row per row of docs.

    Null, empty and blank texts have no words and fail. Very long texts are measured whole. Repeated rows stay. Without
    labels only the base tests reject. An empty table gives no rows. Other columns, of whatever name, are ignored.
    """
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: rejected rows go. The rules are learned first, then every row is judged where it stands."""
    rules = fit(measured(docs.join(F.broadcast(_few(labels)), "doc_id", "left_semi")), labels)
    s = F.col("_s")
    flat = docs.select(F.struct(*docs.columns).alias("_row"), statistics(F.col("text")).alias("_s"))
    flat = flat.select("_row", "_s.base.*", "_s.lines.*", *(f"_s.{c}" for c in ("n_symbols", "n_upper", "n_digits", "n_marks")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    flat = flat.withColumns({f"f_{k}": F.expr(e) for k, e in FEATURES.items()})
    return flat.where(~failed & verdict(rules)).select("_row.*")


def _few(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Labelled ids that rules are learned from in the pipeline: at most `most`, so that they can be broadcast."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return fewest(ids, "quality", most)
