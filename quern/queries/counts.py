"""Queries of counts, smoothing and grams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import tables as O
from quern.queries.registry import GRAM, NAMES, TOK, grams, ident, name_tokens, query, read, tokens


@query("token_counts", f"""
WITH {TOK}
SELECT w, count(*) AS cnt
FROM tok
WHERE NOT regexp_full_match(w, '[0-9]+')
GROUP BY w""")
def token_counts(spark, d):
    return O.word_counts(tokens(spark, d).where(~F.col("w").rlike("^[0-9]+$")))


@query("token_totals", f"""
WITH {TOK}
SELECT doc_id, count(*) AS n, sum(length(w))::BIGINT AS chars
FROM tok
GROUP BY doc_id""")
def token_totals(spark, d):
    return tokens(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("w")).alias("chars"))


@query("witten_bell", f"""
WITH c AS (SELECT w, count(*) AS cnt
FROM (SELECT unnest({NAMES}) AS w
FROM part)
GROUP BY w),
t AS (SELECT sum(cnt)::DOUBLE AS n, count(*)::DOUBLE AS t
FROM c)
SELECT w, cnt, round(cnt / (n + t), 12) AS p
FROM c, t""")
def witten_bell(spark, d):
    return O.witten_bell(O.word_counts(name_tokens(spark, d))).select("w", "cnt", F.round("p", 12).alias("p"))


@query("oov_seed", f"""
WITH {TOK}, a AS (SELECT w, count(*) AS cnt
FROM tok
WHERE doc_id % 5 <> 0
GROUP BY w),
b AS (SELECT w, cnt
FROM a
UNION ALL
SELECT DISTINCT w, 0
FROM tok
WHERE doc_id % 5 = 0 AND w NOT IN (SELECT w
FROM a)),
t AS (SELECT sum(cnt)::DOUBLE AS n, count(*) FILTER (cnt > 0)::DOUBLE AS t, count(*) FILTER (cnt = 0)::DOUBLE AS z
FROM b)
SELECT w, cnt::BIGINT AS cnt, round(CASE WHEN cnt > 0 THEN cnt / (n + t) ELSE t / ((n + t) * z) END, 12) AS p
FROM b, t""")
def oov_seed(spark, d):
    t = tokens(spark, d)
    seeded = O.seed_unseen(O.word_counts(t.where("doc_id % 5 <> 0")), t.where("doc_id % 5 = 0"))
    return O.witten_bell(seeded).select("w", "cnt", F.round("p", 12).alias("p"))


@query("char_ngrams", f"WITH {GRAM} SELECT n::BIGINT AS n, gram, count(*) AS cnt FROM gram GROUP BY n, gram")
def char_ngrams(spark, d):
    return grams(spark, d).groupBy(F.col("n").cast("long").alias("n"), "gram").agg(F.count("*").alias("cnt"))


@query("freedoms", f"""
WITH {GRAM}
SELECT gram, count(*) AS cnt, count(DISTINCT nxt) AS f_next, count(DISTINCT prv) AS f_prev
FROM gram
GROUP BY gram""")
def freedoms(spark, d):
    return O.freedoms(grams(spark, d))


@query("bigram_mi", f"""
WITH {GRAM}, b AS (SELECT gram, substr(gram, 1, 1) AS x, substr(gram, 2, 1) AS y, count(*) AS cnt FROM gram WHERE n = 2 GROUP BY gram)
SELECT gram, cnt, round(cnt::DOUBLE * sum(cnt) OVER () / (sum(cnt) OVER (PARTITION BY x) * sum(cnt) OVER (PARTITION BY y)), 9) AS mi FROM b""")
def bigram_mi(spark, d):
    return O.mutual_information(grams(spark, d)).select("gram", "cnt", F.round("mi", 9).alias("mi"))


@query("cond_probs", f"""
WITH {GRAM}, o AS (SELECT gram, count(*)::DOUBLE AS c
FROM gram
WHERE n = 1
GROUP BY gram),
b AS (SELECT gram, count(*) AS cnt
FROM gram
WHERE n = 2
GROUP BY gram)
SELECT b.gram, round(b.cnt / x.c, 9) AS p_next, round(b.cnt / y.c, 9) AS p_prev
FROM b
JOIN o x ON x.gram = substr(b.gram, 1, 1)
JOIN o y ON y.gram = substr(b.gram, 2, 1)""")
def cond_probs(spark, d):
    return O.conditional(grams(spark, d)).select("gram", F.round("p_next", 9).alias("p_next"), F.round("p_prev", 9).alias("p_prev"))


#: Lengths that profiles are taken of.
LENGTHS = range(1, 6)
PROFILE = f"""{GRAM}, f AS (SELECT gram, count(DISTINCT nxt) AS a, count(DISTINCT prv) AS b FROM gram GROUP BY gram),
p AS (SELECT p_name, pos, k AS n, substr(p_name, greatest(pos - k + 1, 0) + 1, pos - greatest(pos - k + 1, 0) + 1) AS gp,
  substr(p_name, pos + 1, least(k, length(p_name) - pos)) AS gm FROM gram, (SELECT unnest(range(1, 6)) AS k) WHERE n = 1),
v AS (SELECT p_name, n, pos, coalesce(x.a, 0) AS f_p, coalesce(y.b, 0) AS f_m FROM p LEFT JOIN f x ON x.gram = gp LEFT JOIN f y ON y.gram = gm),
w AS (SELECT *, f_p - lag(f_p) OVER o AS d_p, f_m - lead(f_m) OVER o AS d_m FROM v WINDOW o AS (PARTITION BY p_name, n ORDER BY pos)),
z AS (SELECT p_name, n::BIGINT AS n, pos::BIGINT AS pos, f_p, f_m, d_p, d_m, d_p - lead(d_p) OVER o AS peak_p, d_m - lag(d_m) OVER o AS peak_m
  FROM w WINDOW o AS (PARTITION BY p_name, n ORDER BY pos))"""


def profiles(spark, d):
    """Profiles of every length, side by side."""
    out = None
    for n in LENGTHS:
        one = O.profile(grams(spark, d), "p_name", n).select("p_name", F.lit(n).cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "f_p", "f_m", "d_p", "d_m", "peak_p", "peak_m")
        out = one if out is None else out.unionByName(one)
    return out


@query("freedom_profile", f"WITH {PROFILE} SELECT * FROM z")
def freedom_profile(spark, d):
    return profiles(spark, d)


@query("peak_sums", f"""
WITH {PROFILE}, s AS (SELECT p_name, pos, CASE WHEN count(peak_p) = 5 THEN sum(peak_p)::DOUBLE END AS s FROM z GROUP BY p_name, pos)
SELECT p_name, pos, round(s / nullif(max(s) OVER (PARTITION BY p_name), 0), 9) AS peak FROM s""")
def peak_sums(spark, d):
    rows = profiles(spark, d).withColumn("peak_p", F.col("peak_p").cast("double"))
    return O.summed_over(rows, "p_name", "peak_p", len(LENGTHS)).select("p_name", "pos", F.round("peak_p", 9).alias("peak"))


@query("freedom_deviation", f"""
WITH {PROFILE}, m AS (SELECT p_name, pos, greatest(f_p - avg(f_p) OVER q, 0) AS a, greatest(f_m - avg(f_m) OVER q, 0) AS b
 FROM z WHERE n = 1 WINDOW q AS (PARTITION BY p_name))
SELECT p_name, pos, round(a, 9) AS dv_p, round(b, 9) AS dv_m, round(a + lead(b) OVER o, 9) AS dv_sum, round(a * lead(b) OVER o, 9) AS dv_product
FROM m WINDOW o AS (PARTITION BY p_name ORDER BY pos)""")
def freedom_deviation(spark, d):
    rows = O.deviations(O.profile(grams(spark, d), "p_name", 1), "p_name", ["f_p", "f_m"])
    r = lambda c, name: F.round(c, 9).alias(name)
    return rows.select("p_name", F.col("pos").cast("long").alias("pos"), r("dv_f_p", "dv_p"), r("dv_f_m", "dv_m"), r("dv_sum", "dv_sum"), r("dv_product", "dv_product"))


@query("legacy_steps", f"""
WITH {PROFILE} SELECT p_name, pos, lead(f_p) OVER o - f_p AS d_p, f_m - lag(f_m) OVER o AS d_m FROM z WHERE n = 1 WINDOW o AS (PARTITION BY p_name ORDER BY pos)""")
def legacy_steps(spark, d):
    w = Window.partitionBy("p_name").orderBy("pos")
    rows = O.profile(grams(spark, d), "p_name", 1)
    return rows.select("p_name", F.col("pos").cast("long").alias("pos"), (F.lead("f_p").over(w) - F.col("f_p")).alias("d_p"), (F.col("f_m") - F.lag("f_m").over(w)).alias("d_m"))


@query("prob_profile", f"""
WITH {GRAM}, c AS (SELECT gram, count(*)::DOUBLE AS c FROM gram GROUP BY gram),
p AS (SELECT p_name, pos, k AS n, greatest(pos - k + 1, 0) AS a, least(pos + k, length(p_name)) AS b FROM gram, (SELECT unnest([1, 2]) AS k) WHERE n = 1),
q AS (SELECT p_name, pos, p.n, CASE WHEN pos = 0 THEN 0 ELSE coalesce(wp.c, 0) / coalesce(up.c, 1) END AS x,
  CASE WHEN pos = length(p_name) - 1 THEN 0 ELSE coalesce(wm.c, 0) / coalesce(um.c, 1) END AS y FROM p
  LEFT JOIN c wp ON wp.gram = substr(p_name, a + 1, pos + 1 - a) LEFT JOIN c up ON up.gram = substr(p_name, a + 1, pos - a)
  LEFT JOIN c wm ON wm.gram = substr(p_name, pos + 1, b - pos) LEFT JOIN c um ON um.gram = substr(p_name, pos + 2, b - pos - 1)),
t AS (SELECT *, CASE WHEN n = 1 THEN greatest(max(x) OVER w, max(y) OVER w) ELSE 1 END AS top FROM q WINDOW w AS (PARTITION BY p_name, n))
SELECT p_name, n::BIGINT AS n, pos::BIGINT AS pos, round(x / top, 9) AS p_p, round(y / top, 9) AS p_m FROM t""")
def prob_profile(spark, d):
    out = None
    for n in (1, 2):
        one = O.probability_profile(grams(spark, d), "p_name", n).select("p_name", F.lit(n).cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), F.round("p_p", 9).alias("p_p"), F.round("p_m", 9).alias("p_m"))
        out = one if out is None else out.unionByName(one)
    return out


@query("gram_freedoms", f"""
WITH {GRAM} SELECT gram, n::BIGINT AS n, count(*) AS cnt, count(DISTINCT nullif(substr(p_name, pos + n + 1, n), '')) AS f_next,
 count(DISTINCT CASE WHEN pos > 0 THEN substr(p_name, greatest(pos - n, 0) + 1, pos - greatest(pos - n, 0)) END) AS f_prev FROM gram GROUP BY gram, n""")
def gram_freedoms(spark, d):
    return O.gram_freedoms(grams(spark, d), "p_name").withColumn("n", F.col("n").cast("long"))


@query("model_leaves", f"""
WITH {GRAM} SELECT ((SELECT count(DISTINCT gram) FROM gram) + (SELECT count(*) FROM (SELECT DISTINCT gram, nxt FROM gram WHERE nxt IS NOT NULL))
 + (SELECT count(*) FROM (SELECT DISTINCT gram, prv FROM gram WHERE prv IS NOT NULL)))::BIGINT AS leaves""")
def model_leaves(spark, d):
    a, b, c = O.freedom_model(grams(spark, d))
    return a.select("cnt").unionByName(b.select("cnt")).unionByName(c.select("cnt")).agg(F.count("*").alias("leaves"))


@query("last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, d):
    return O.last_wins(read(spark, d, "events"), "user_id", "event_id", "event_type")


@query("longest_label", f"SELECT max(len({NAMES}))::BIGINT AS n FROM part")
def longest_label(spark, d):
    return read(spark, d, "part").agg(F.max(F.size(T.camel_words(ident()))).cast("long").alias("n"))


@query("letter_order", f"""
WITH {TOK}, c AS (SELECT w, count(*) AS cnt FROM tok GROUP BY w)
SELECT w, row_number() OVER (PARTITION BY w[1] ORDER BY round(log10(cnt) * length(w), 9) DESC, w) AS by_log,
 row_number() OVER (PARTITION BY w[1] ORDER BY length(w) DESC, w) AS by_length FROM c""")
def letter_order(spark, d):
    c = O.word_counts(tokens(spark, d)).withColumn("l", F.substring("w", 1, 1))
    log = F.round(F.log10(F.col("cnt").cast("double")) * F.length("w"), 9)
    place = lambda by: F.row_number().over(Window.partitionBy("l").orderBy(by.desc(), "w")).cast("long")
    return c.select("w", place(log).alias("by_log"), place(F.length("w")).alias("by_length"))


@query("dict_compress", f"""
WITH {TOK}, c AS (SELECT lang, w, count(*) AS cnt
FROM tok
JOIN documents USING (doc_id)
GROUP BY lang, w)
SELECT lang, w, cnt
FROM c
QUALIFY cnt >= 0.05 * max(cnt) OVER (PARTITION BY lang)""")
def dict_compress(spark, d):
    return O.compress(O.word_counts(tokens(spark, d, "documents", "doc_id", "lang"), "lang"), 0.05, "lang").select("lang", "w", "cnt")


@query("dict_diff", f"""
WITH {TOK}, a AS (SELECT w, count(*) AS x
FROM tok
WHERE doc_id % 2 = 0
GROUP BY w),
b AS (SELECT w, count(*) AS y
FROM tok
WHERE doc_id % 2 = 1
GROUP BY w)
SELECT w, coalesce(x, 0) - coalesce(y, 0) AS diff
FROM a FULL JOIN b USING (w)
WHERE x IS NULL OR y IS NULL OR x <> y""")
def dict_diff(spark, d):
    t = tokens(spark, d)
    return O.difference(O.word_counts(t.where("doc_id % 2 = 0")), O.word_counts(t.where("doc_id % 2 = 1")))


@query("dict_merge", f"WITH {TOK} SELECT w, count(*) AS cnt FROM tok GROUP BY w")
def dict_merge(spark, d):
    t = tokens(spark, d)
    return O.merge(O.word_counts(t.where("doc_id % 2 = 0")), O.word_counts(t.where("doc_id % 2 = 1")))


@query("case_merge", f"WITH {TOK} SELECT lower(w) AS w, count(*) AS cnt FROM tok GROUP BY lower(w)")
def case_merge(spark, d):
    return tokens(spark, d).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("cnt"))
