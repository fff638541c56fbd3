"""Queries of vocabularies and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import encode as E
from quern.operators import tables as O
from quern.queries.registry import CTOK, NAMES, TOK, VOC, ident, query, read, tokens




@query("instr_vocab", f"WITH {TOK}, {VOC} SELECT id, w, cnt FROM voc")
def instr_vocab(spark, d):
    return O.vocabulary(O.word_counts(tokens(spark, d)), 5, 13_000)


@query("vocab_extend", f"""
WITH {TOK}, {VOC}, {CTOK}, n AS (SELECT w, count(*) AS cnt
FROM ctok
WHERE w NOT IN (SELECT w
FROM voc)
GROUP BY w)
SELECT id, w, cnt
FROM voc
UNION ALL
SELECT (SELECT max(id)
FROM voc) + row_number() OVER (ORDER BY cnt DESC, w), w, cnt
FROM n""")
def vocab_extend(spark, d):
    return O.extend(instr_vocab(spark, d), O.word_counts(tokens(spark, d, "conversations", "conv_id", "turn")))


@query("encode_seq", f"""
WITH {TOK}, {VOC}, {CTOK}, e AS (SELECT conv_id, turn, list(coalesce(id, 1) ORDER BY pos) AS l FROM ctok LEFT JOIN voc USING (w) GROUP BY conv_id, turn)
SELECT conv_id, turn, array_to_string((list_concat([3], l, [2], list_transform(range(16), lambda x: 0)))[1:16], ' ') AS ids FROM e""")
def encode_seq(spark, d):
    words = tokens(spark, d, "conversations", "conv_id", "turn")
    return O.encode(words, instr_vocab(spark, d), ["conv_id", "turn"], 16, 3, 2).select("conv_id", "turn", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("pair_truncate", f"""
WITH {CTOK}, n AS (SELECT conv_id, turn, count(*) AS n FROM ctok GROUP BY conv_id, turn), p AS (SELECT a.conv_id, a.turn, a.n AS a, b.n AS b, greatest(a.n + b.n - 29, 0) AS r FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT *, least(r, abs(a - b)) AS m FROM p)
SELECT conv_id, turn, (a - CASE WHEN a > b THEN m ELSE 0 END - floor((r - m) / 2))::BIGINT AS keep_a, (b - CASE WHEN b > a THEN m ELSE 0 END - ceil((r - m) / 2))::BIGINT AS keep_b FROM m""")
def pair_truncate(spark, d):
    n = tokens(spark, d, "conversations", "conv_id", "turn").groupBy("conv_id", "turn").agg(F.count("*").alias("a"))
    p = n.join(n.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    a, b = E.truncated(F.col("a"), F.col("b"), F.lit(29))
    return p.select("conv_id", "turn", a.cast("long").alias("keep_a"), b.cast("long").alias("keep_b"))


TURN_IDS = "ti AS (SELECT conv_id, turn, list(coalesce(id, 1) ORDER BY pos) AS l FROM ctok LEFT JOIN voc USING (w) GROUP BY conv_id, turn)"
_TEXT = "array_to_string({}, ' ')"


def turn_ids(spark, d):
    """conv_id, turn, ids of each turn with a word."""
    return E.ids_of(tokens(spark, d, "conversations", "conv_id", "turn"), instr_vocab(spark, d), ["conv_id", "turn"])


def joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


@query("pair_encode", f"""
WITH {TOK}, {VOC}, {CTOK}, {TURN_IDS}, p AS (SELECT a.conv_id, a.turn, a.l AS a, b.l AS b, len(a.l) AS n, len(b.l) AS m, greatest(len(a.l) + len(b.l) + 3 - 32, 0) AS r
 FROM ti a JOIN ti b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
c AS (SELECT *, least(r, abs(n - m)) AS k FROM p),
e AS (SELECT *, a[1:(n - CASE WHEN n > m THEN k ELSE 0 END - floor((r - k) / 2))::BIGINT] AS x, b[1:(m - CASE WHEN m > n THEN k ELSE 0 END - ceil((r - k) / 2))::BIGINT] AS y FROM c),
f AS (SELECT conv_id, turn, n + m + 3 - 32 AS over, list_concat(list_concat([3], x, [2]), y, [2]) AS ids,
 list_concat(list_transform(range(len(x) + 2), lambda i: 0), list_transform(range(len(y) + 1), lambda i: 1)) AS kinds,
 list_concat([1], list_transform(x, lambda i: 0), [1, 1], list_transform(y, lambda i: 0), [1]) AS marks FROM e),
g AS (SELECT *, list_transform(range(32 - len(ids)), lambda i: 0) AS more FROM f)
SELECT conv_id, turn, {_TEXT.format('list_concat(ids, more)')} AS ids, {_TEXT.format('list_concat(kinds, more)')} AS kinds,
 {_TEXT.format('list_concat(list_transform(ids, lambda i: 1), more)')} AS attention, {_TEXT.format('list_concat(marks, list_transform(more, lambda i: 1))')} AS marks, over::BIGINT AS over FROM g""")
def pair_encode(spark, d):
    a = turn_ids(spark, d)
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("next"))
    how = E.strategy("max_length", True, 32)
    e = a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", E.prepare(F.col("ids"), F.col("next"), how).alias("e"))
    return e.select("conv_id", "turn", joined("e.input_ids").alias("ids"), joined("e.token_type_ids").alias("kinds"), joined("e.attention_mask").alias("attention"), joined("e.special_tokens_mask").alias("marks"), F.col("e.num_truncated_tokens").alias("over"))


@query("pad_mask", f"""
WITH {TOK}, {VOC}, {CTOK}, {TURN_IDS}, m AS (SELECT *, max(len(l)) OVER (PARTITION BY conv_id) AS n FROM ti)
SELECT conv_id, turn, {_TEXT.format('list_concat(list_transform(range(n - len(l)), lambda i: 0), l)')} AS ids,
 {_TEXT.format('list_concat(list_transform(range(n - len(l)), lambda i: 0), list_transform(l, lambda i: 1))')} AS mask FROM m""")
def pad_mask(spark, d):
    rows = E.batch_longest(turn_ids(spark, d), F.col("ids"), ["conv_id"])
    ids = E.padded(F.col("ids"), F.col("longest"), side="left")
    return rows.select("conv_id", "turn", joined(ids).alias("ids"), joined(E.segment_mask(ids)).alias("mask"))


@query("only_second", f"""
WITH {TOK}, {VOC}, {CTOK}, {TURN_IDS}, p AS (SELECT a.conv_id, a.turn, a.l AS a, b.l AS b, greatest(len(a.l) + len(b.l) - 24, 0) AS r
 FROM ti a JOIN ti b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, {_TEXT.format('CASE WHEN len(b) > r THEN b[1:len(b) - r] ELSE b END')} AS second,
 {_TEXT.format('CASE WHEN r > 0 AND len(b) > r THEN b[len(b) - least(len(b), 2 + r) + 1:] ELSE [] END')} AS lost FROM p""")
def only_second(spark, d):
    a = turn_ids(spark, d)
    rows = a.join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("b")), ["conv_id", "turn"])
    _, b, lost = E.cut_pair(F.col("ids"), F.col("b"), F.size("ids") + F.size("b") - 24, "only_second", stride=2)
    return rows.select("conv_id", "turn", joined(b).alias("second"), joined(lost).alias("lost"))


@query("label_encode", f"""
WITH w AS (SELECT p_partkey, unnest(string_split(replace({NAMES}[1] || ' ' || p_name || '__x', ' ', '_'), '_')) AS w,
 generate_subscripts(string_split(replace({NAMES}[1] || ' ' || p_name || '__x', ' ', '_'), '_'), 1) AS pos FROM part),
v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) + 3 AS id FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w),
e AS (SELECT p_partkey, list(coalesce(id, 1) ORDER BY pos) AS l FROM w LEFT JOIN v USING (w) GROUP BY p_partkey)
SELECT p_partkey, {_TEXT.format('(list_concat(list_concat([3], l, [2]), list_transform(range(10), lambda i: 0)))[1:10]')} AS ids FROM e""")
def label_encode(spark, d):
    part = read(spark, d, "part")
    vocab = O.vocabulary(O.word_counts(part.select(F.explode(F.split("p_name", " ")).alias("w"))), 4)
    name = F.concat(F.get(T.camel_words(ident()), 0), F.lit(" "), "p_name", F.lit("__x"))
    words = part.select("p_partkey", F.posexplode(E.label_words(name)).alias("pos", "w"))
    return O.encode(words, vocab, ["p_partkey"], 10, E.START, E.END).select("p_partkey", joined("ids").alias("ids"))


@query("decode_seq", f"""
WITH {TOK}, {VOC}, {CTOK}, {TURN_IDS}, x AS (SELECT conv_id, turn, unnest(list_concat(l, [0, 99999])) AS id, generate_subscripts(list_concat(l, [0, 99999]), 1) AS pos FROM ti)
SELECT conv_id, turn, string_agg(coalesce(w, '<' || id || '>'), ' ' ORDER BY pos) AS words FROM x LEFT JOIN voc USING (id) WHERE id <> 0 GROUP BY conv_id, turn""")
def decode_seq(spark, d):
    ids = turn_ids(spark, d).withColumn("ids", F.concat("ids", F.array(F.lit(0).cast("long"), F.lit(99999).cast("long"))))
    return E.tokens_of(ids, instr_vocab(spark, d), ["conv_id", "turn"], True).select("conv_id", "turn", F.array_join("words", " ").alias("words"))


@query("special_marks", f"""
WITH {TOK}, {VOC}, {CTOK}, {TURN_IDS}
SELECT conv_id, turn, {_TEXT.format('list_transform(list_concat(list_concat([3], l, [2]), [0]), lambda i: (i IN (0, 1, 2, 3, 4))::INT)')} AS marks, md5({_TEXT.format('l')}) AS h FROM ti""")
def special_marks(spark, d):
    ids = F.concat(E.special(F.col("ids")), F.array(F.lit(0).cast("long")))
    return turn_ids(spark, d).select("conv_id", "turn", joined(E.special_mask_of(ids)).alias("marks"), F.md5(E.flattened(F.array("ids")).cast("binary")).alias("h"))
