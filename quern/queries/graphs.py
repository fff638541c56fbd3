"""Queries of graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import graphs as G
from quern.operators import tables as O
from quern.queries.registry import query, read


@query("size_band", """
SELECT l_orderkey, count(*) AS nodes
FROM lineitem
GROUP BY l_orderkey
HAVING count(*) BETWEEN 3 AND 6""")
def size_band(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("nodes")).where("nodes BETWEEN 3 AND 6")


def edges(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))


@query("symmetrise", """
WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst
FROM lineitem)
SELECT src, dst
FROM e UNION
SELECT dst, src
FROM e""")
def symmetrise(spark, d):
    return O.undirected(edges(spark, d))


@query("indegree0", """
SELECT DISTINCT l_orderkey AS node
FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_partkey
FROM lineitem)""")
def indegree0(spark, d):
    return O.sources(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


EGO = """e0 AS (SELECT o_custkey AS a, o_orderkey + 1000000000 AS b FROM orders), e AS (SELECT a AS src, b AS dst FROM e0 UNION SELECT b, a FROM e0),
h1 AS (SELECT DISTINCT src AS root, dst AS node FROM e WHERE src <> dst),
h2 AS (SELECT DISTINCT h1.root, e.dst AS node FROM h1 JOIN e ON h1.node = e.src WHERE e.dst <> h1.root),
h AS (SELECT root, node, 1::BIGINT AS hop FROM h1 UNION ALL SELECT root, node, 2 FROM h2 ANTI JOIN h1 USING (root, node) UNION ALL SELECT DISTINCT src, src, 0 FROM e)"""


def customer_orders(spark, d):
    """Customers and their orders: a customer has some ten, so that neighbourhoods stay small."""
    return O.undirected(read(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst")))


@query("ego_2hop", f"WITH {EGO} SELECT root, node, hop FROM h")
def ego_2hop(spark, d):
    return O.ego(customer_orders(spark, d), 2).withColumn("hop", F.col("hop").cast("long"))


@query("ego_edges", f"""
WITH {EGO} SELECT a.root, a.hop AS hop_src, b.hop AS hop_dst, e.src, e.dst FROM h a JOIN e ON a.node = e.src JOIN h b ON b.root = a.root AND b.node = e.dst WHERE b.hop >= a.hop""")
def ego_edges(spark, d):
    edges = customer_orders(spark, d)
    return G.ego_edges(O.ego(edges, 2).withColumn("hop", F.col("hop").cast("long")), edges)


@query("hop_matrices", f"""
WITH {EGO}, i AS (SELECT root, node, hop, row_number() OVER (PARTITION BY hop ORDER BY root, node) - 1 AS i FROM h)
SELECT a.hop AS hop_src, b.hop AS hop_dst, a.i, b.i AS j FROM i a JOIN e ON a.node = e.src JOIN i b ON b.root = a.root AND b.node = e.dst WHERE b.hop >= a.hop""")
def hop_matrices(spark, d):
    edges = customer_orders(spark, d)
    return G.hop_matrices(O.ego(edges, 2).withColumn("hop", F.col("hop").cast("long")), edges)


@query("cfg_edges", """
WITH b AS (SELECT o_custkey AS f, o_orderkey AS src_block, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst_block FROM orders),
n AS (SELECT o_custkey AS f, l_orderkey AS block, l_orderkey * 8 + l_linenumber AS addr FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
i AS (SELECT f, addr AS src, lead(addr) OVER (PARTITION BY f, block ORDER BY addr) AS dst FROM n), x AS (SELECT f, block, min(addr) AS a, max(addr) AS z FROM n GROUP BY 1, 2)
SELECT f AS func, src, dst FROM i WHERE dst IS NOT NULL UNION SELECT b.f, s.z, t.a FROM b JOIN x s ON s.f = b.f AND s.block = src_block JOIN x t ON t.f = b.f AND t.block = dst_block""")
def cfg_edges(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("func"), F.col("o_orderkey").alias("block"))
    nodes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("addr")).join(o, "block")
    follows = o.select("func", F.col("block").alias("src_block"), F.lead("block").over(Window.partitionBy("func").orderBy("block")).alias("dst_block")).where("dst_block IS NOT NULL")
    return G.instruction_edges(nodes, follows)


@query("random_walk", """
WITH RECURSIVE t AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT DISTINCT user_id, src, dst FROM t WHERE dst IS NOT NULL),
s AS (SELECT user_id, src AS start FROM e UNION SELECT user_id, dst FROM e), k AS (SELECT unnest(range(1, 41)) AS step),
c AS (SELECT user_id, start, step, src, dst FROM s JOIN k ON true JOIN e USING (user_id)
 QUALIFY row_number() OVER (PARTITION BY user_id, start, step, src ORDER BY md5('w-' || start || '-' || step || '-' || dst), dst) = 1),
w AS (SELECT user_id, start, 0::BIGINT AS step, start AS node FROM s UNION ALL SELECT w.user_id, w.start, c.step, c.dst FROM w JOIN c ON c.user_id = w.user_id AND c.start = w.start AND c.step = w.step + 1 AND c.src = w.node)
SELECT user_id, start, string_agg(node, ' ' ORDER BY step) AS walk, count(*) AS n FROM w GROUP BY user_id, start""")
def random_walk(spark, d):
    """Walks over each user's transitions between types of events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = read(spark, d, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst IS NOT NULL").distinct()
    w = G.random_walks(edges, "user_id", "string", "w")
    return w.groupBy("user_id", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]), " ").alias("walk"), F.count("*").alias("n"))


@query("adjacency", """
WITH n AS (SELECT l_suppkey AS g, node, row_number() OVER (PARTITION BY l_suppkey ORDER BY node) - 1 AS i FROM (SELECT DISTINCT l_suppkey, l_partkey AS node FROM lineitem) QUALIFY i < 16),
e AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS dst FROM lineitem)
SELECT e.g, a.i, b.i AS j FROM e JOIN n a ON a.g = e.g AND a.node = src JOIN n b ON b.g = e.g AND b.node = dst""")
def adjacency(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_suppkey", "g")
    nodes = li.select("g", F.col("l_partkey").alias("node")).distinct()
    edges = li.select("g", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(Window.partitionBy("g").orderBy("l_orderkey", "l_linenumber", "l_partkey")).alias("dst")).distinct()
    return G.relabelled(nodes, edges, "g", 16)


@query("merged_blocks", """
WITH RECURSIVE b AS MATERIALIZED (SELECT o.o_orderkey AS block, CASE WHEN p.o_orderkey < o.o_orderkey THEN p.o_orderkey END AS parent, o.o_orderstatus = 'F' AS own
 FROM (SELECT *, o_orderkey // 2 AS h FROM orders) o ASOF LEFT JOIN (SELECT o_orderkey FROM orders) p ON o.h >= p.o_orderkey),
r AS (SELECT block, CASE WHEN own THEN block ELSE parent END AS owner, own AS done FROM b
 UNION ALL SELECT r.block, CASE WHEN b.own THEN b.block ELSE b.parent END, b.own FROM r JOIN b ON b.block = r.owner WHERE NOT r.done)
SELECT o_orderkey AS block, o.owner FROM orders LEFT JOIN (SELECT block, owner FROM r WHERE done) o ON o.block = o_orderkey""")
def merged_blocks(spark, d):
    """Each order and the nearest of it and its ancestors, halving its key, that is done."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("block"), "o_orderstatus")
    half = o.select("block", F.floor(F.col("block") / 2).alias("h"))
    # the parent is the greatest key up to the half: as-of by a running maximum over both kinds of keys
    marks = half.select(F.col("h").alias("at"), F.lit(1).alias("kind"), "block").unionByName(o.select(F.col("block").alias("at"), F.lit(0).alias("kind"), F.col("block")))
    marks = marks.withColumn("bucket", F.floor(F.col("at") / 4096))
    own = F.when(F.col("kind") == 0, F.col("block"))
    here = F.max(own).over(Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tops = marks.groupBy("bucket").agg(F.max(own).alias("top"))
    before = tops.select("bucket", F.max("top").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    parents = marks.withColumn("p", here).join(before, "bucket").where("kind = 1").select("block", F.coalesce("p", "before").alias("parent"))
    parents = parents.select("block", F.when(F.col("parent") < F.col("block"), F.col("parent")).alias("parent"))
    return G.merged_blocks(parents, o.where("o_orderstatus = 'F'").select("block"))


@query("data_flow")
def data_flow(spark, d):
    """Definitions and uses over blocks of each user's events: tested against a plain version."""
    e = read(spark, d, "events")
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    e = e.select(F.col("user_id").alias("func"), F.col("event_id").alias("addr"), F.floor(seq / 8).alias("block"), "event_type")
    text = F.expr("CASE event_type WHEN 'click' THEN 'rax = (rbx + rcx)' WHEN 'view' THEN '@64[rsp] = rax' WHEN 'purchase' THEN 'rbx = @64[rsp]' ELSE 'rcx = rbx' END")
    rows = e.select("func", "block", "addr", text.alias("assign"))
    blocks = e.select("func", "block").distinct()
    after = blocks.select("func", F.col("block").alias("src_block"), F.explode(F.array(F.col("block") + 1, F.greatest(F.col("block") - 2, F.lit(0)))).alias("dst_block"))
    return G.def_use(rows, after)
