"""Queries of schedules and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import abbreviations as A
from quern.operators import metrics as ME
from quern.operators import segment as S
from quern.operators import tables as O
from quern.plans import names as P
from quern.queries.registry import name_tokens, query, read


@query("noam_schedule", """
SELECT p_partkey, round(power(768, -0.5) * least(power(p_partkey + 1, -0.5), (p_partkey + 1) * power(10000, -1.5)), 12) AS lr
FROM part""")
def noam_schedule(spark, d):
    s = F.col("p_partkey") + 1
    return read(spark, d, "part").select("p_partkey", F.round(F.pow(F.lit(768.0), F.lit(-0.5)) * F.least(F.pow(s, F.lit(-0.5)), s * F.pow(F.lit(10000.0), F.lit(-1.5))), 12).alias("lr"))


def names(spark, d):
    """p_partkey and the name without blanks that is to be split."""
    return read(spark, d, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name"))


def word_counts(spark, d):
    """Words of the identifiers: the corpus that the splitters learn from."""
    return O.word_counts(name_tokens(spark, d).where("w <> ''"))


def split_by(spark, d, found, splitter, *columns):
    """Each part with its name's split: distinct names are split once, each with what was found of it."""
    rows = names(spark, d)
    parts = found.select("name", S.named(splitter, F.col("name"), *(F.col(c) for c in columns)).alias("parts"))
    return rows.join(parts, "name").select("p_partkey", "parts")


@query("unigram_segment")
def unigram_segment(spark, d):
    """Names without spaces, split by a unigram model of their words: tested against all segmentations."""
    p = P.unigrams(word_counts(spark, d))
    d_names = names(spark, d).select("name").distinct()
    found = d_names.join(S.found_in(d_names, p, "p"), "name", "left").crossJoin(F.broadcast(p.agg(F.count("*").alias("size"))))
    return split_by(spark, d, found, lambda s, m, n: S.best_segmentation(s, m, size=int(n)), "found", "size")


@query("lexicon_tokenize")
def lexicon_tokenize(spark, d):
    """Names split by a greedy lexicon of the corpus: tested against a plain version."""
    d_names = names(spark, d).select("name").distinct()
    found = d_names.join(S.found_in(d_names, P.lexicon(word_counts(spark, d)), "weight"), "name", "left")
    return split_by(spark, d, found, lambda s, m: S.greedy_lexicon(s, S.by_letter(m)), "found")


@query("vote_split")
def vote_split(spark, d):
    """Three-way vote on names without spaces: a unigram model, rules with a dictionary and abbreviations, and freedoms."""
    counts = word_counts(spark, d)
    grams_of = P.freedoms(read(spark, d, "part").select(F.lower("p_name").alias("name")))
    found = P.found(names(spark, d), counts, grams_of, counts.where(F.length("w") > 2))
    return names(spark, d).join(P.split(found, A.Lexicon()), "name").select("p_partkey", "parts")


@query("vote_expand")
def vote_expand(spark, d):
    """The vote's words with abbreviations written out."""
    return vote_split(spark, d).select("p_partkey", P.expanded(F.col("parts"), A.EXPANSIONS).alias("words"))


@query("delimiter_tokens")
def delimiter_tokens(spark, d):
    """Words, blanks, quotes and marks of turns: tested against the worked examples."""
    t = read(spark, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\u0001"), F.lit("")).alias("text"))
    return t.select("conv_id", "turn", S.named(lambda s: ["\u0001".join(S.delimited(s))], F.col("text")).alias("parts"))


@query("splitter_f1")
def splitter_f1(spark, d):
    """Mean F1 of two splitters against the names' own words."""
    own = read(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    out = None
    for name, parts in (("lexicon", lexicon_tokenize(spark, d)), ("unigram", unigram_segment(spark, d))):
        f = ME.multiset_f1(own, parts.select("p_partkey", F.explode(F.split("parts", "_")).alias("w")), "p_partkey")
        one = ME.mean_of(f.withColumn("splitter", F.lit(name)), "f1", "splitter")
        out = one if out is None else out.unionByName(one)
    return out


@query("substring_words", """
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '') AS name FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
s AS (SELECT DISTINCT name, substr(name, i, k) AS w FROM (SELECT name, i, unnest(range(1, length(name) - i + 2)) AS k FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM n)))
SELECT name, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS words FROM s SEMI JOIN w USING (w) GROUP BY name""")
def substring_words(spark, d):
    part = read(spark, d, "part")
    n = part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    found = S.substrings(n).join(words, "w", "left_semi")
    return found.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("w")), " ").alias("words"))
