"""From raw symbols to words: normalisation, three splitters, a vote, and expansion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.abbreviations import Lexicon
from quern.operators import segment as S
from quern.operators import tables as O

#: Longest gram of the freedom model, lengths that profiles are taken of, and the threshold of a boundary.
MOST_GRAM, LENGTHS, THRESHOLD = 10, (1, 2, 3, 4, 5), 0.1
#: Entries of a lexicon below this part of its greatest are left out.
LOSS = 1e-5


def unigrams(counts: DataFrame) -> DataFrame:
    """w, p: smoothed probabilities of words of two characters or more that are no numbers (w, cnt)."""
    return O.witten_bell(counts.where((F.length("w") > 1) & ~F.col("w").rlike("^[0-9]+$"))).select("w", "p")


def lexicon(counts: DataFrame) -> DataFrame:
    """w, weight: counts in lower case without the rarest."""
    folded = counts.groupBy(F.lower("w").alias("w")).agg(F.sum("cnt").alias("cnt"))
    return O.compress(folded.where("w <> ''"), LOSS).select("w", F.col("cnt").cast("double").alias("weight"))


def freedoms(texts: DataFrame, name: str = "name", most: int = max(LENGTHS)) -> DataFrame:
    """w, f_next, f_prev: how many characters follow and precede each gram of up to `most` characters of distinct texts."""
    return O.freedoms(O.char_grams(texts, name, most)).select(F.col("gram").alias("w"), "f_next", "f_prev")


def found(names: DataFrame, counts: DataFrame, grams: DataFrame, known: DataFrame) -> DataFrame:
    """name, size, and what each splitter needs to know of it: p, weight, after and before, words. Models of any size meet
    distinct names by joins on their substrings; none is collected.

    counts: w, cnt; grams: w, f_next, f_prev; known: w, of the dictionary.
    """
    d = names.select("name").distinct()
    parts = S.substrings(d)
    parts = parts.join(unigrams(counts), "w", "left").join(lexicon(counts), "w", "left").join(grams, "w", "left").join(known.select("w", F.lit(True).alias("word")).distinct(), "w", "left")
    parts = parts.where("p IS NOT NULL OR weight IS NOT NULL OR f_next IS NOT NULL OR word")
    entries = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("w", F.col(c).cast("double"))))).alias(c)
    maps = parts.groupBy("name").agg(entries("p"), entries("weight"), entries("f_next"), entries("f_prev"), F.collect_list(F.when(F.col("word"), F.col("w"))).alias("words"))
    size = unigrams(counts).agg(F.count("*").alias("size"))
    return d.join(maps, "name", "left").crossJoin(F.broadcast(size))


def split(rows: DataFrame, rules: Lexicon, mode: str = "faithful", shared_ends: bool = True) -> DataFrame:
    """name, parts: the vote of the three splitters on rows of `found`, joined by underscores, without numbers and blanks."""

    def one(name: str, size: int, p: dict, weight: dict, after: dict, before: dict, words) -> list[str]:
        lists = S.by_letter({w: x for w, x in weight.items()})
        own = Lexicon(frozenset(words if words is not None else ()), rules.abbreviations, rules.stopwords, rules.splits)
        unigram = S.spans_of(S.best_segmentation(name, p, mode=mode, size=int(size) if size and not math.isnan(size) else None))
        free = S.freedom_spans(name, after, before, S.greedy_lexicon(name, lists), LENGTHS, THRESHOLD)
        voted = S.vote(name, unigram, S.rule_spans(name, own), free, shared_ends)
        return [x.strip() for x in voted if x.strip() and not x.isdigit()]

    parts = S.named(one, *(F.col(c) for c in ("name", "size", "p", "weight", "f_next", "f_prev", "words")))
    return rows.select("name", parts.alias("parts"))


def expanded(parts, table: dict[str, str], lemmas=None):
    """Parts joined by underscores, written out by a table of abbreviations and, if given, by a column function for lemmas."""
    words = T.expand(F.split(parts, "_"), table)
    return F.array_join(words if lemmas is None else F.transform(words, lemmas), "_")


def lemmatised(words: DataFrame, lemmas: DataFrame, keys: list[str], stopwords: tuple[str, ...] = ()) -> DataFrame:
    """keys, pos, w: words (keys, pos, w, and tag if known) with each replaced by its base form (w, tag, lemma), that of a
    noun if it has no tag; stopwords, and words that have none, stay."""
    tagged = words if "tag" in words.columns else words.withColumn("tag", F.lit("n"))
    out = tagged.join(lemmas.select("w", "tag", "lemma"), ["w", "tag"], "left")
    stays = F.col("w").isin(*stopwords) if stopwords else F.lit(False)
    return out.select(*keys, "pos", F.when(stays, F.col("w")).otherwise(F.coalesce("lemma", "w")).alias("w"))
