"""Queries of splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import encode as E
from quern.operators import masking as M
from quern.operators import tables as O
from quern.queries.registry import DICE, query, read
from quern.queries.vocabularies import turn_ids


@query("split_801010", f"""
SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS part
FROM (SELECT doc_id, row_number() OVER (ORDER BY {DICE.format('s', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n
FROM documents)""")
def split_801010(spark, d):
    return O.split_exact(read(spark, d, "documents"), "doc_id", "s", {"train": 0.8, "valid": 0.1}, "test")


@query("split_95_5", f"""
SELECT doc_id, CASE WHEN r <= n - ceil(n * 0.05) THEN 'train' ELSE 'val' END AS part
FROM (SELECT doc_id, row_number() OVER (ORDER BY {DICE.format('v', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n
FROM documents)""")
def split_95_5(spark, d):
    return O.split_exact(read(spark, d, "documents"), "doc_id", "v", {"train": 0.95}, "val")


@query("variant_pairs", """
WITH v AS (SELECT DISTINCT l_partkey, l_linenumber % 5 AS v FROM lineitem), p AS (SELECT a.l_partkey, a.v AS v1, b.v AS v2 FROM v a JOIN v b ON a.l_partkey = b.l_partkey AND a.v < b.v UNION ALL SELECT l_partkey, min(v), min(v) FROM v GROUP BY l_partkey HAVING count(*) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY md5('p-' || l_partkey || '-' || v1 || '-' || v2), v1, v2) AS r, count(*) OVER (PARTITION BY l_partkey) AS m FROM p)
SELECT l_partkey, k, v1, v2 FROM r, (SELECT unnest(range(1, 6)) AS k) WHERE r <= 5 AND (k - 1) % least(m, 5) = r - 1""")
def variant_pairs(spark, d):
    v = read(spark, d, "lineitem").select("l_partkey", (F.col("l_linenumber") % 5).alias("v")).distinct()
    return O.variant_pairs(v, "l_partkey", "p")


@query("neg_sampling", """
WITH t AS (SELECT conv_id, turn, text, ('0x' || substr(md5('n-' || conv_id || '-' || turn), 1, 8))::BIGINT / 4294967296.0 AS u,
 ('0x' || substr(md5('m-' || conv_id || '-' || turn), 1, 8))::BIGINT / 4294967296.0 AS v, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
p AS (SELECT *, row_number() OVER (ORDER BY md5('r-' || conv_id || '-' || turn), conv_id, turn) - 1 AS r, count(*) OVER () AS n FROM t WHERE nxt IS NOT NULL)
SELECT a.conv_id, a.turn, CASE WHEN a.u > 0.25 THEN 1 ELSE 0 END AS label, md5(a.text) AS first, md5(CASE WHEN a.u > 0.25 THEN a.nxt ELSE b.nxt END) AS second,
 md5(CASE WHEN a.u > 0.25 THEN a.text ELSE a.nxt END) AS other_first, md5(CASE WHEN a.u > 0.25 THEN a.nxt ELSE a.text END) AS other_second
FROM p a JOIN p b ON b.r = floor(a.v * a.n)""")
def neg_sampling(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("left"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("right"))
    rows = O.negative_pairs(t.where("right IS NOT NULL"), ["conv_id", "turn"])
    h = lambda c: F.md5(F.col(c).cast("binary"))
    return rows.select("conv_id", "turn", "label", h("first").alias("first"), h("second").alias("second"), h("other_first").alias("other_first"), h("other_second").alias("other_second"))


@query("row_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('40-' || doc_id::VARCHAR), doc_id) AS place FROM documents")
def row_shuffle(spark, d):
    rows = read(spark, d, "documents").select("doc_id", O.dice("40", F.col("doc_id")).alias("dice"))
    return O.ranked(rows, [F.col("dice"), F.col("doc_id")], [(F.substring("dice", 1, 3), False)], (), "place").select("doc_id", "place")


@query("span_mask")
def span_mask(spark, d):
    """Masked turns in batches of one conversation: tested by its invariants, as lengths of spans come from a distribution."""
    ids = turn_ids(spark, d)
    n = 32
    rows = ids.select("conv_id", "turn", E.padded(F.slice(E.special(F.col("ids")), 1, n), F.lit(n)).alias("ids"))
    out = M.span_mask(rows, "conv_id", "turn", "mask")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return out.select("conv_id", "turn", text("ids"), text("labels"))


@query("sentence_permute", """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY md5('p-pick-' || doc_id || '-' || i), i) AS pick FROM s),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY pick) AS slot, row_number() OVER (PARTITION BY doc_id ORDER BY md5('p-place-' || doc_id || '-' || i), i) AS place
 FROM n WHERE pick <= ceil(n * 0.5)),
t AS (SELECT a.doc_id, a.i, b.i AS src FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.slot = b.place)
SELECT n.doc_id, md5(string_agg(x.s, chr(10) ORDER BY n.i)) AS h, count(*) AS sentences FROM n LEFT JOIN t ON t.doc_id = n.doc_id AND t.i = n.i
JOIN s x ON x.doc_id = n.doc_id AND x.i = coalesce(t.src, n.i) GROUP BY n.doc_id""")
def sentence_permute(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    rows = docs.select("doc_id", M.permuted(F.split("text", "\n"), F.col("doc_id"), "p", 0.5).alias("s"))
    return rows.select("doc_id", F.md5(F.array_join("s", "\n").cast("binary")).alias("h"), F.size("s").cast("long").alias("sentences"))


@query("systematic_sample", """
WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, replace(coalesce(text, ''), '_', ' ') AS t, count(*) OVER () AS n FROM documents),
ok AS (SELECT line FROM l WHERE NOT (length(t) = 0 OR (starts_with(t, 'A') OR starts_with(t, 'The')) AND line + 1 < n)),
s AS (SELECT unnest(range(20)) AS i), k AS (SELECT i, i * round_even((SELECT count(*) FROM documents) / 21.0, 0)::BIGINT AS wanted FROM s)
SELECT i::BIGINT AS i, (SELECT min(line) FROM ok WHERE line >= wanted) AS line FROM k""")
def systematic_sample(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("_"), F.lit(" ")).alias("text"))
    return O.systematic(rows, F.col("doc_id"), F.floor(F.col("doc_id") / 4096), F.col("text"), 20, ("A", "The")).select("i", "line")
