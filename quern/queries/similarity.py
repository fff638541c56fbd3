"""Queries of similarity and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import metrics as ME
from quern.operators import similarity as Q
from quern.operators import tables as O
from quern.queries.registry import CTOK, TOK, query, read, tokens


@query("knn_top5", """
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
FROM embeddings a
JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rk
FROM p
QUALIFY rk <= 5""")
def knn_top5(spark, d):
    return Q.nearest(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 5).select("a", "b", F.col("rk").cast("long").alias("rk"))


@query("scatter_sum", """
SELECT label, i::BIGINT AS i, round(sum(x), 5) AS s
FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i
FROM embeddings)
GROUP BY label, i""")
def scatter_sum(spark, d):
    return read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("s"))


@query("lev_similarity", """
WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT a.p_name AS a, b.p_name AS b, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS s
 FROM n a JOIN n b ON a.p_name < b.p_name)
SELECT a, b, round(s, 9) AS sim FROM s WHERE round(s, 9) >= 0.5""")
def lev_similarity(spark, d):
    return Q.near_names(read(spark, d, "part").select(F.col("p_name").alias("name")))


@query("name_rule", r"""
WITH p AS (SELECT DISTINCT p_name AS a, p_type || ' ' || split_part(p_name, ' ', 1) AS b FROM part), w AS (SELECT *, list_distinct(string_split(lower(a), ' ')) AS x, list_distinct(string_split(lower(b), ' ')) AS y FROM p),
t AS (SELECT *, list_distinct(list_transform(x, lambda v: regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, 'sses$', 'ss'), 'ies$', 'i'), '([^s])s$', '\1'), '([aeiou].*)(ed|ing)$', '\1'))) AS u,
 list_distinct(list_transform(y, lambda v: regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, 'sses$', 'ss'), 'ies$', 'i'), '([^s])s$', '\1'), '([aeiou].*)(ed|ing)$', '\1'))) AS v FROM w)
SELECT a, b, CASE WHEN contains(a, b) OR contains(b, a) THEN 'contained' WHEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.5 THEN 'edit'
 WHEN 1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) < 0.36787968862663154641 THEN 'words'
 WHEN 1 - len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) < 1 - 0.36787968862663154641 THEN 'stems' END AS rule FROM t""")
def name_rule(spark, d):
    p = read(spark, d, "part").select(F.col("p_name").alias("a"), F.concat("p_type", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("b")).distinct()
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return p.select("a", "b", Q.similar(F.col("a"), F.col("b"), words("a"), words("b")).alias("rule"))


@query("jaccard_docs", f"""
WITH {TOK}, s AS (SELECT doc_id, list_distinct(list(lower(w))) AS s FROM tok GROUP BY doc_id)
SELECT a.doc_id, round(1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS distance FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def jaccard_docs(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.array_distinct(F.transform(T.spaced_words(F.col("text")), F.lower)).alias("s")).where(F.size("s") > 0)
    pairs = s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id")
    return pairs.select("doc_id", F.round(Q.jaccard_distance(F.col("s"), F.col("t")), 9).alias("distance"))


@query("token_sets", f"""
WITH {CTOK}, x AS (SELECT DISTINCT conv_id, w FROM ctok JOIN conversations USING (conv_id, turn) WHERE role = 'user'), y AS (SELECT DISTINCT conv_id, w FROM ctok JOIN conversations USING (conv_id, turn) WHERE role = 'assistant')
SELECT conv_id, count(*) FILTER (x.w IS NOT NULL AND y.w IS NOT NULL) AS both, count(*) FILTER (y.w IS NULL) AS only_user, count(*) FILTER (x.w IS NULL) AS only_assistant FROM x FULL JOIN y USING (conv_id, w) GROUP BY conv_id""")
def token_sets(spark, d):
    w = tokens(spark, d, "conversations", "conv_id", "role")
    side = lambda r, c: w.where(F.col("role") == r).groupBy("conv_id").agg(F.collect_set("w").alias(c))
    s = side("user", "x").join(side("assistant", "y"), "conv_id", "full")
    none = F.array().cast("array<string>")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    return s.select("conv_id", F.size(F.array_intersect(x, y)).cast("long").alias("both"), F.size(F.array_except(x, y)).cast("long").alias("only_user"), F.size(F.array_except(y, x)).cast("long").alias("only_assistant"))


@query("stop_words", f"""
WITH {CTOK} SELECT conv_id, count(DISTINCT lower(w)) FILTER (lower(w) NOT IN ('the', 'and', 'of', 'to', 'a', 'in', 'is')) AS n FROM ctok GROUP BY conv_id""")
def stop_words(spark, d):
    w = tokens(spark, d, "conversations", "conv_id").groupBy("conv_id").agg(F.collect_set(F.lower("w")).alias("s"))
    return w.select("conv_id", F.size(F.array_except("s", F.lit(["the", "and", "of", "to", "a", "in", "is"]))).cast("long").alias("n"))


@query("synset_overlap", """
WITH w AS (SELECT DISTINCT p_brand AS b, unnest(string_split(p_name, ' ')) AS w FROM part), k AS (SELECT DISTINCT b FROM w), syn AS (SELECT DISTINCT w, unnest([w[1:3], w[2:4]]) AS syn FROM w),
p AS (SELECT x.b AS a, y.b AS b FROM k x JOIN k y ON x.b < y.b), n AS (SELECT b, count(*) AS n FROM w GROUP BY b),
h AS (SELECT p.a, p.b, count(DISTINCT wa.w) AS h FROM p JOIN w wa ON wa.b = p.a JOIN syn sa ON sa.w = wa.w JOIN (SELECT DISTINCT w.b, syn FROM w JOIN syn USING (w)) sb ON sb.b = p.b AND sb.syn = sa.syn GROUP BY 1, 2)
SELECT p.a, p.b, round(coalesce(h, 0) / greatest(m.n, n.n), 9) AS score FROM p JOIN n m ON m.b = p.a JOIN n ON n.b = p.b LEFT JOIN h ON h.a = p.a AND h.b = p.b""")
def synset_overlap(spark, d):
    w = read(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    k = w.select("p_brand").distinct()
    pairs = k.select(F.col("p_brand").alias("a")).join(k.select(F.col("p_brand").alias("b")), F.col("a") < F.col("b"))
    synonyms = w.select("w", F.explode(F.array(F.substring("w", 1, 3), F.substring("w", 2, 3))).alias("syn")).distinct()
    side = lambda c: pairs.join(w.select(F.col("p_brand").alias(c), "w"), c).select("a", "b", "w")
    return Q.synonym_overlap(side("a"), side("b"), synonyms, ["a", "b"]).select("a", "b", F.round("score", 9).alias("score"))


@query("alignment")
def alignment(spark, d):
    """Local alignment of neighbouring names: tested against a plain version, as SQL has no such scan."""
    p = read(spark, d, "part").select(F.col("p_name").alias("a"), F.concat("p_type", F.lit(" "), "p_brand").alias("b")).distinct()
    score = p.select("a", "b", Q.alignment_score(F.col("a"), F.col("b")).alias("score"))
    return score.select("a", "b", "score", (F.col("score") / F.greatest(F.length("a"), F.length("b")) > Q.ALIGNMENT).alias("alike"), F.round(Q.alignment_distance(F.col("score")), 9).alias("distance"))


@query("related_vote", """
WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, round(list_cosine_similarity(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]), 9) AS x,
 round(list_cosine_similarity(a.embedding[33:64]::DOUBLE[], b.embedding[33:64]::DOUBLE[]), 9) AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
u AS (SELECT a, b, same FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY x DESC, b) <= 5 UNION ALL SELECT a, b, same FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY y DESC, b) <= 5)
SELECT a, b FROM u GROUP BY a, b, same HAVING count(*) > 1 OR same""")
def related_vote(spark, d):
    """Neighbours by two models, the halves of the vectors: those of both, and of one if the labels are equal."""
    e = read(spark, d, "embeddings")
    half = lambda start: Q.nearest(e.select(F.col("vec_id").alias("id"), F.slice("embedding", start, 32).alias("v")), 5)
    label = lambda c: e.select(F.col("vec_id").alias(c), F.col("label").alias(f"label_{c}"))
    lists = [half(1), half(33)]
    every = Q.voted(lists, F.lit(True)).join(label("a"), "a").join(label("b"), "b")
    alike = every.where("label_a = label_b").select("a", "b")
    return Q.voted([*lists, alike], F.lit(False))


@query("word2vec_syn")
def word2vec_syn(spark, d):
    """The nearest words by skip-gram vectors of the turns' words: a trained model, so rows only."""
    w = read(spark, d, "conversations").select(T.vocabulary_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    ids = O.ranked(Q.word_vectors(w).rows, [F.col("word")], [(F.substring("word", 1, 3), False)], (), "id")
    near = Q.nearest(ids.select("id", "v"), 5)
    name = lambda c: ids.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"))
    return near.join(name("a"), "a").join(name("b"), "b").select(F.col("word_a").alias("word"), F.col("word_b").alias("related"), "rk")


@query("f1_multiset", f"""
WITH {CTOK}, x AS (SELECT conv_id, lower(w) AS w, count(*) AS x FROM ctok JOIN conversations USING (conv_id, turn) WHERE role = 'user' GROUP BY 1, 2), y AS (SELECT conv_id, lower(w) AS w, count(*) AS y FROM ctok JOIN conversations USING (conv_id, turn) WHERE role = 'assistant' GROUP BY 1, 2),
s AS (SELECT conv_id, sum(x)::DOUBLE AS n, sum(y)::DOUBLE AS m, sum(least(coalesce(x, 0), coalesce(y, 0)))::DOUBLE AS h FROM x FULL JOIN y USING (conv_id, w) GROUP BY conv_id)
SELECT conv_id, round(coalesce(h / nullif(m, 0), 0), 9) AS p, round(coalesce(h / nullif(n, 0), 0), 9) AS r, round(coalesce(2 * (h / m) * (h / n) / nullif(h / m + h / n, 0), 0), 9) AS f1 FROM s""")
def f1_multiset(spark, d):
    w = tokens(spark, d, "conversations", "conv_id", "role").withColumn("w", F.lower("w"))
    return ME.multiset_f1(w.where("role = 'user'"), w.where("role = 'assistant'"), "conv_id")


@query("fuzzy_f1", f"""
WITH {CTOK}, x AS (SELECT conv_id, lower(w) AS w, count(*) AS x FROM ctok JOIN conversations USING (conv_id, turn) WHERE role = 'user' GROUP BY 1, 2),
y AS (SELECT conv_id, lower(w) AS w, count(*) AS y FROM ctok JOIN conversations USING (conv_id, turn) WHERE role = 'assistant' GROUP BY 1, 2),
h AS (SELECT y.conv_id, sum(least(x, y)) AS h FROM y JOIN x ON x.conv_id = y.conv_id AND (x.w = y.w OR (abs(length(x.w) - length(y.w)) = 1 AND greatest(length(x.w), length(y.w)) > 3
 AND (starts_with(x.w, y.w) OR starts_with(y.w, x.w) OR ends_with(x.w, y.w) OR ends_with(y.w, x.w)) AND NOT EXISTS (SELECT 1 FROM x z WHERE z.conv_id = y.conv_id AND z.w = y.w))) GROUP BY 1),
s AS (SELECT conv_id, n, m, coalesce(h, 0)::DOUBLE AS h FROM (SELECT conv_id, sum(x)::DOUBLE AS n FROM x GROUP BY 1) FULL JOIN (SELECT conv_id, sum(y)::DOUBLE AS m FROM y GROUP BY 1) USING (conv_id) LEFT JOIN h USING (conv_id))
SELECT conv_id, round(coalesce(2 * coalesce(h / m, 0) * coalesce(h / n, 0) / nullif(coalesce(h / m, 0) + coalesce(h / n, 0), 0), 0), 9) AS f1 FROM s""")
def fuzzy_f1(spark, d):
    w = tokens(spark, d, "conversations", "conv_id", "role").withColumn("w", F.lower("w"))
    return ME.fuzzy_f1(w.where("role = 'user'"), w.where("role = 'assistant'"), "conv_id")


SIDES = """t AS (SELECT conv_id, list(lower(w) ORDER BY turn, pos) FILTER (role = 'user') AS a, list(lower(w) ORDER BY turn, pos) FILTER (role = 'assistant') AS b
 FROM ctok JOIN conversations USING (conv_id, turn) GROUP BY conv_id), u AS (SELECT conv_id, a[1:10] AS a, b[1:10] AS b FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT conv_id, a, list_transform(b, lambda p: CASE WHEN list_contains(a, p) THEN p ELSE coalesce(list_filter(a, lambda t: t[1] = p[1])[1], p) END) AS b FROM u),
c AS (SELECT conv_id, CASE WHEN a = b THEN len(a) ELSE len(list_intersect(list_distinct(a), list_distinct(b))) END AS tp,
 CASE WHEN a = b THEN 0 ELSE len(list_distinct(b)) - len(list_intersect(list_distinct(a), list_distinct(b))) END AS fp,
 CASE WHEN a = b THEN 0 ELSE len(list_distinct(a)) - len(list_intersect(list_distinct(a), list_distinct(b))) END AS fn FROM r)"""


def matched(spark, d):
    """conv_id, tp, fp, fn: the first ten words of the assistant as a guess of the user's, words of one first letter being
    a cluster."""
    w = read(spark, d, "conversations").select("conv_id", "role", "turn", F.posexplode(T.spaced_words(F.col("text"))).alias("pos", "w"))
    words = lambda r, c: w.where(F.col("role") == r).groupBy("conv_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("turn", "pos", F.lower("w").alias("w")))), lambda x: x["w"]), 1, 10).alias(c))
    both = words("user", "a").join(words("assistant", "b"), "conv_id")
    guess = ME.replaced(F.col("a"), F.col("b"), lambda x: F.array(F.substring(x, 1, 1)))
    return both.select("conv_id", ME.set_counts(F.col("a"), guess).alias("s")).select("conv_id", "s.*")


@query("cluster_match", f"WITH {CTOK}, {SIDES} SELECT conv_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM c")
def cluster_match(spark, d):
    return matched(spark, d)


@query("micro_prf", f"""
WITH {CTOK}, {SIDES}, s AS (SELECT conv_id % 5 AS opt, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY 1)
SELECT opt, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS p, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS r,
 round(coalesce(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / nullif(tp / (tp + fp) + tp / (tp + fn), 0), 0), 9) AS f1 FROM s""")
def micro_prf(spark, d):
    """A report for each of five groups."""
    return ME.micro(matched(spark, d).withColumn("opt", F.col("conv_id") % 5), "opt")


@query("masked_accuracy", """
SELECT round(avg((guess = label)::INT), 9) AS acc, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN -100 ELSE quality END AS label, (lang = 'en')::INT AS guess
 FROM labels JOIN documents USING (doc_id)) WHERE label <> -100""")
def masked_accuracy(spark, d):
    """Whether a document is good, guessed by its language; labels of toxic ones are masked."""
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ME.masked_accuracy(rows, (F.col("lang") == "en").cast("int"), F.when(F.col("toxic") == 1, -100).otherwise(F.col("quality")))


@query("compression", """
WITH t AS (SELECT lang, coalesce(text, '') AS text FROM documents), w AS (SELECT lang, unnest(string_split(text, ' ')) AS w FROM t), k AS (SELECT lang, w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2),
b AS (SELECT lang, sum(length(text) - length(replace(text, ' ', ''))) AS n, sum(length(text)) AS size FROM t GROUP BY 1)
SELECT lang, round(1 - (sum(length(w)) + sum(k.n) + any_value(b.n) + (any_value(b.n) > 0)::INT) / any_value(size), 9) AS ratio FROM k JOIN b USING (lang) GROUP BY lang""")
def compression(spark, d):
    t = read(spark, d, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    return ME.compression(t.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[^ ]+| "), 0)).alias("w")), t, "lang")


@query("entropy", """
WITH c AS (SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(cnt)::DOUBLE AS n, count(*) AS k FROM c GROUP BY 1),
h AS (SELECT user_id, k, -sum(cnt / n * log2(cnt / n)) AS h FROM c JOIN t USING (user_id) GROUP BY 1, 2), z AS (SELECT user_id, round(CASE WHEN k > 2 THEN h / log2(k) ELSE h END, 9) AS h FROM h)
SELECT user_id, h, round(1 - h, 9) AS anti FROM z""")
def entropy(spark, d):
    return ME.entropy(read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("cnt")), "user_id")


@query("pivot_matrix", "SELECT user_id % 10 AS g, " + ", ".join(f"coalesce(round(sum(CASE WHEN event_type = '{t}' THEN value END), 4), 0) AS {t}" for t in ("click", "error", "purchase", "view")) + " FROM events GROUP BY user_id % 10")
def pivot_matrix(spark, d):
    e = read(spark, d, "events").groupBy((F.col("user_id") % 10).alias("g")).pivot("event_type", ["click", "error", "purchase", "view"]).agg(F.round(F.sum("value"), 4))
    return e.fillna(0)


@query("running_mean", """
SELECT event_id, (sum(round(value * 100)::BIGINT) OVER w)::DOUBLE / count(*) OVER w AS mean_cents
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", (F.sum(F.round(F.col("value") * 100).cast("long")).over(w) / F.count("*").over(w)).alias("mean_cents"))


@query("vote_repeats", """
SELECT label, e AS item, count(*) AS n
FROM (SELECT label, vec_id % 50 AS e
FROM embeddings)
GROUP BY label, e
HAVING count(*) > 1""")
def vote_repeats(spark, d):
    return read(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 50).alias("item")).agg(F.count("*").alias("n")).where("n > 1")


@query("distinct_variants", """
SELECT l_partkey, h, min(l_linenumber)::BIGINT AS v
FROM (SELECT l_partkey, l_linenumber, md5(l_returnflag || ' ' || l_linestatus) AS h
FROM lineitem)
GROUP BY l_partkey, h""")
def distinct_variants(spark, d):
    h = F.md5(F.concat_ws(" ", "l_returnflag", "l_linestatus").cast("binary"))
    return read(spark, d, "lineitem").groupBy("l_partkey", h.alias("h")).agg(F.min("l_linenumber").cast("long").alias("v"))
