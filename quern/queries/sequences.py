"""Queries of sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import tables as O
from quern.plans import dataset as D
from quern.plans import pairs as P
from quern.queries.registry import query, read


@query("walk_pairs_cfg", """
WITH s AS (SELECT user_id, event_type AS l, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n, lead(event_type, 1) OVER w AS r1, lead(event_type, 2) OVER w AS r2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT l, r1 AS r, j FROM s WHERE n >= 4 UNION ALL SELECT l, r2, j FROM s WHERE n >= 4)
SELECT l AS "left", r AS "right", sum(CASE WHEN j = 0 THEN 1 ELSE 2 END)::BIGINT AS n FROM p WHERE r IS NOT NULL GROUP BY l, r""")
def walk_pairs_cfg(spark, d):
    return O.context_pairs(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("walk_pairs_dfg", """
SELECT l AS "left", r AS "right", (2 * count(*))::BIGINT AS n
FROM (SELECT event_type AS l, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r
FROM events)
WHERE r IS NOT NULL
GROUP BY l, r""")
def walk_pairs_dfg(spark, d):
    return O.next_pairs(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("align_corpora", """
WITH a AS (SELECT l_partkey, l_orderkey AS val, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS pos
FROM lineitem
WHERE l_returnflag = 'A'),
b AS (SELECT l_partkey, l_orderkey AS val, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS pos
FROM lineitem
WHERE l_returnflag = 'N')
SELECT l_partkey, pos, a.val AS a, b.val AS b
FROM a
JOIN b USING (l_partkey, pos)""")
def align_corpora(spark, d):
    li = read(spark, d, "lineitem")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    part = lambda f: li.where(F.col("l_returnflag") == f).select("l_partkey", F.row_number().over(w).cast("long").alias("pos"), F.col("l_orderkey").alias("val"))
    return O.align(part("A"), part("N"), "l_partkey")


@query("batch_chunks", """
WITH r AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS i, count(*) OVER (PARTITION BY role) AS total FROM conversations)
SELECT role, floor((i - 1) / 16)::BIGINT AS chunk, count(*) AS n, min(conv_id) AS first_conv FROM r WHERE (floor((i - 1) / 16) + 1) * 16 <= total GROUP BY role, chunk""")
def batch_chunks(spark, d):
    """Numbers within a role in two levels, so that no task holds a role."""
    c = read(spark, d, "conversations")
    r = O.ranked(c, [F.col("conv_id"), F.col("turn")], [(F.floor(F.col("conv_id") / 1024), False)], ("role",), "at")
    r = r.join(F.broadcast(c.groupBy("role").agg(F.count("*").alias("total"))), "role")
    return O.chunks(r, 16).groupBy("role", "chunk").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


@query("stream_chunks", """
WITH n AS (SELECT lang, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')))::BIGINT AS total FROM documents GROUP BY lang)
SELECT lang, total, CASE WHEN total >= 512 THEN total // 512 * 512 ELSE total END AS used, CASE WHEN total >= 512 THEN total // 512 ELSE 1 END AS chunks FROM n""")
def stream_chunks(spark, d):
    """Chunks of each language's words in a row: a partial last one goes, unless it is the only one."""
    n = read(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(T.spaced_words(F.col("text")))).alias("total"))
    whole = F.floor(F.col("total") / 512)
    return n.select("lang", "total", F.when(F.col("total") >= 512, whole * 512).otherwise(F.col("total")).alias("used"), F.when(F.col("total") >= 512, whole).otherwise(F.lit(1).cast("long")).alias("chunks"))


@query("def_use", """
SELECT event_id, def FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM events) WHERE event_type = 'click'""")
def def_use(spark, d):
    e = O.last_before(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "click", "event_id")
    return e.select("event_id", "def")


@query("align_records", """
WITH r AS (SELECT l_partkey, l_returnflag AS f, list(l_orderkey || ':' || l_linenumber ORDER BY l_orderkey, l_linenumber) AS l FROM lineitem GROUP BY 1, 2)
SELECT a.l_partkey, array_to_string(a.l[1:least(len(a.l), len(b.l))], ' ') AS cfg, array_to_string(b.l[1:least(len(a.l), len(b.l))], ' ') AS dfg
FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.f = 'A' AND b.f = 'R'""")
def align_records(spark, d):
    pair = F.struct("l_orderkey", "l_linenumber")
    r = read(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"))).alias("pairs"))
    side = lambda f: r.where(F.col("l_returnflag") == f).select("l_partkey", "pairs")
    out = P.aligned_records(side("A"), side("R"), ["l_partkey"])
    return out.select("l_partkey", F.array_join("cfg", " ").alias("cfg"), F.array_join("dfg", " ").alias("dfg"))


@query("first_seen", "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS id FROM events GROUP BY user_id")
def first_seen(spark, d):
    first = read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))
    return O.ranked(first, [F.col("first")], [(F.floor(F.col("first") / 1024), False)], (), "id").select("user_id", "id")


@query("sorted_pairs", """
SELECT user_id, string_agg(event_type || ':' || n, ' ' ORDER BY event_type) AS pairs FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def sorted_pairs(spark, d):
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))))
    return n.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), " ").alias("pairs"))


@query("beam_step", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM events QUALIFY rk <= 3")
def beam_step(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return read(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rk")).where("rk <= 3")


@query("argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS at FROM embeddings")
def argmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("long").alias("at"))


@query("variant_union", "SELECT l_partkey, " + ", ".join(f"min(CASE WHEN l_linenumber % 5 = {k} THEN l_orderkey END) AS o{k}" for k in range(5)) + " FROM lineitem GROUP BY l_partkey")
def variant_union(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.concat(F.lit("o"), (F.col("l_linenumber") % 5).cast("string")).alias("opt"), "l_orderkey")
    least = rows.groupBy("name", "opt").agg(F.min("l_orderkey").alias("v"))
    return D.by_build(least, [f"o{k}" for k in range(5)], "v").withColumnRenamed("name", "l_partkey")


@query("node_offsets", """
SELECT o_orderkey, n, coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n
FROM lineitem
GROUP BY l_orderkey)""")
def node_offsets(spark, d):
    """Running offsets in two levels: within ranges of keys, and of the ranges."""
    n = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).withColumn("blk", F.floor(F.col("o_orderkey") / 4096))
    blocks = n.groupBy("blk").agg(F.sum("n").alias("b"))
    base = blocks.select("blk", (F.sum("b").over(Window.orderBy("blk")) - F.col("b")).alias("base"))
    own = F.sum("n").over(Window.partitionBy("blk").orderBy("o_orderkey")) - F.col("n")
    return n.join(base, "blk").select("o_orderkey", "n", (own + F.col("base")).alias("before"))
