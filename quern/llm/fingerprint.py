"""Document fingerprints by consistent weighted sampling (Ioffe, 2010), in SQL functions.

A document is a weighted set: each word weighs its count times its length, so that likeness goes by the text the
documents share rather than by small common words. For a term k and a sample i, r and c are Gamma(2, 1) and b is
uniform on [0, 1), all drawn from hashes of (k, i). With t = floor(ln w / r + b) the term bids
ln a = ln c - r (t - b + 1), and the sample is the term with the least bid, at level t. Two documents draw the same
sample with a probability equal to the generalised Jaccard similarity of their weights. A bid depends on k and t alone,
so that the least bid itself names the sample: one minimum per sample is all that is aggregated.

A text and its edited text share most terms, so that terms are laid side by side and each draw serves both. Rows of a
document never leave the partition that its text is in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACE_CLASS, checkpoint, hot_keys, salted, spread

SAMPLES = 64
#: Samples that a row of generated code draws; SAMPLES must be a multiple. With 16 the JVM no longer compiles the loop.
GROUP = 4
SMALLEST = -(2**63)
_LENGTH_BITS = 12


def _halvings(h: Column) -> Column:
    """How often the two uniform numbers of a Gamma(2, 1) are halved: the zeros before the second one of a hash's bits."""
    bits = F.shiftrightunsigned(h, 1)
    rest = bits.bitwiseAND(bits - 1)
    return F.bit_count(rest.bitwiseAND(-rest) - 1) - 1


def _turned(h: Column) -> Column:
    """z of u v, where u and v are uniform on (1/2, 1), each of 32 bits of hash: s = sqrt(u v), z = (s - c) / (s + c) with
    c = sqrt(1/2), at most 0.172 from 0."""
    m = lambda x: x * F.lit(2.0**-33) + F.lit(0.5 + 2.0**-34)
    s = F.sqrt(m(F.shiftrightunsigned(h, 32)) * m(h.bitwiseAND(F.lit(2**32 - 1))))
    return F.lit(1.0) - F.lit(math.sqrt(2)) / (s + F.lit(math.sqrt(0.5)))


def _exponentials(z: Column, halvings: Column) -> Column:
    """Gamma(2, 1): the sum of two exponentials, -ln(u v) with u and v halved so often. Of u v it is ln 2 - 4 artanh z;
    the series stops where the rest is below 4e-11."""
    w, series = z * z, F.lit(1 / 11)
    for k in range(9, 0, -2):
        series = series * w + F.lit(1 / k)
    return (halvings + 1) * F.lit(math.log(2)) - series * z * F.lit(4.0)


def _plain_exponentials(h: Column) -> Column:
    """The same by a logarithm, from numbers of 32 bits."""
    u = F.shiftrightunsigned(h, 32) + F.lit(0.5)
    v = h.bitwiseAND(F.lit(2**32 - 1)) + F.lit(0.5)
    return -F.ln(u * v * F.lit(2.0**-64))


def _drawn(rows: DataFrame, keep: list[str], group: int = GROUP) -> DataFrame:
    """keep, and r0, c0, b0, r1, ...: r, ln c and b of the row's term for samples g, g + 1, ... . Each draw has 64 bits of
    hash of its own, r 128; a step is a projection, so that no hash is computed twice."""
    n = range(group)
    rows = rows.select(*keep, *(F.xxhash64("term", F.col("g") + i).alias(f"h{i}") for i in n))
    rows = rows.select(*keep, *(f"h{i}" for i in n), *(F.xxhash64(f"h{i}").alias(f"i{i}") for i in n))
    uniform = lambda h: F.shiftrightunsigned(F.xxhash64(h), 12) * F.lit(2.0**-52)
    parts = ((_turned(F.col(f"h{i}")), _halvings(F.xxhash64(f"h{i}", F.lit(1))), F.ln(_plain_exponentials(F.col(f"i{i}"))), uniform(F.col(f"i{i}"))) for i in n)
    rows = rows.select(*keep, *(x.alias(f"{name}{i}") for i, d in enumerate(parts) for name, x in zip("zncb", d, strict=True)))
    return rows.select(*keep, *(x for i in n for x in (_exponentials(F.col(f"z{i}"), F.col(f"n{i}")).alias(f"r{i}"), f"c{i}", f"b{i}")))


def _bid(lw: Column, r: Column, lc: Column, b: Column) -> Column:
    return lc - r * (F.floor(lw / r + b) - b + 1)


def weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, n, m: each term of either text with its count in the text and in the edited text.

    A term is 51 bits of a word's hash and 12 of its length. A row without words has one null term.
    """
    both = rows.select(*keys, F.explode(F.array(F.struct(F.col("text").alias("t"), F.lit(0).alias("mark")), F.struct(F.col("edited").alias("t"), F.lit(1).alias("mark")))).alias("v"))
    each = both.select(*keys, F.col("v.mark").alias("mark"), F.explode(F.split(F.coalesce("v.t", F.lit("")), SPACE_CLASS)).alias("w"))
    length = F.least(F.length("w"), F.lit(2**_LENGTH_BITS - 1)).cast("long")
    term = F.shiftleft(F.xxhash64("w"), _LENGTH_BITS).bitwiseAND(F.lit(2**63 - 1)).bitwiseOR(length)
    # an empty piece at a text's edge, or of a text without words, is the null term: it keeps its row, and bids nothing
    each = each.select(*keys, F.when(F.col("w") != "", term).alias("term"), F.col("mark").cast("long").alias("mark"))
    return each.groupBy(*keys, "term").agg(F.sum(1 - F.col("mark")).alias("n"), F.sum("mark").alias("m"))


def signatures(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, sig and edited_sig: arrays of `samples` ints. rows: keys, text and edited; keys tell rows apart.

    Partitioned by the first keys, rows need no exchange. A text without words has samples of 0.
    """
    group = GROUP if samples % GROUP == 0 else 1
    length = F.col("term").bitwiseAND(F.lit(2**_LENGTH_BITS - 1))
    lw = lambda n: F.when(F.col(n) > 0, F.ln((F.col(n) * length).cast("double")))
    each = weights(rows, keys).select(*keys, "term", lw("n").alias("lw"), lw("m").alias("lm"))
    each = each.withColumn("g", F.explode(F.array(*map(F.lit, range(0, samples, group)))))
    drawn = _drawn(each, [*keys, "g", "lw", "lm"], group)
    bid = lambda w, i: _bid(F.col(w), *(F.col(f"{n}{i}") for n in "rcb"))
    drawn = drawn.select(*keys, "g", "lw", "lm", *(f"{n}{i}" for i in range(group) for n in "rcb"), *(bid("lw", i).alias(f"lw{i}") for i in range(group)))
    # most terms have one weight in both texts
    edited = [F.when(F.col("lm") == F.col("lw"), F.col(f"lw{i}")).otherwise(bid("lm", i)) for i in range(group)]
    least = [F.min(x).alias(f"{w}{i}") for w, own in (("lw", [F.col(f"lw{i}") for i in range(group)]), ("lm", edited)) for i, x in enumerate(own)]
    sample = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.hash(F.col(c))), F.lit(0))
    groups = drawn.groupBy(*keys, "g").agg(*least)
    groups = groups.select(*keys, F.struct("g", *(F.array(*(sample(f"{w}{i}") for i in range(group))).alias(w) for w in ("lw", "lm"))).alias("v"))
    out = groups.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("v"))  # samples / group entries
    return out.select(*keys, F.flatten(F.transform("v", lambda x: x["lw"])).alias("sig"), F.flatten(F.transform("v", lambda x: x["lm"])).alias("edited_sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda n, x: n + x) / F.size(a)


def text_of(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.substring(F.hex(x.cast("long").bitwiseOR(F.lit(1 << 40))), -8, 8)), "")


def following(ids: DataFrame) -> DataFrame:
    """key, next: each distinct key and the next greater one, after the last the first. ids: key, not null.

    Keys are range-sorted; only each partition's first key goes to one place.
    """
    ranged = checkpoint(ids.distinct().repartitionByRange("key").select("key", F.spark_partition_id().alias("pid")))
    firsts = ranged.groupBy("pid").agg(F.min("key").alias("first"))
    after = firsts.select("pid", F.coalesce(F.lead("first").over(Window.orderBy("pid")), F.min("first").over(Window.partitionBy())).alias("after"))
    lead = F.lead("key").over(Window.partitionBy("pid").orderBy("key"))
    return ranged.withColumn("lead", lead).join(after, "pid").select("key", F.coalesce("lead", "after").alias("next"))


def query(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row of docs.

    A null text is empty; an empty text's fingerprint is all zeros and like another empty one. Very long texts are taken
    whole; words beyond 4,095 characters weigh as that many. Documents follow each other by doc_id, a null id first; a
    single document follows itself. Repeated rows stay; where several rows share an id, the document that follows another
    is the one whose start sorts first, and its fingerprint the least. An empty table gives no rows. Other columns, of
    whatever name, are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), text.alias("text"))
    by_key = docs.select(key.alias("key"), (F.length(text) / 4).cast("long").alias("k")).groupBy("key").agg(F.max("k").alias("k"), F.count("*").alias("n"))
    by_key = checkpoint(following(by_key.select("key")).join(by_key, "key"))
    hot = hot_keys(by_key, ["key"])
    wanted = by_key.select(F.col("next").alias("key"), F.col("key").alias("owner"), "k")
    # of a document that many rows share, each part sends the start that sorts first
    heads = salted(rows, hot, ["key"], F.col("text")).join(spread(wanted, hot, ["key"]), ["key", "salt"])
    heads = heads.select(F.col("owner").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("k").cast("int")).alias("head"), F.col("key").alias("next")).groupBy("key").agg(F.min("head").alias("head"), F.first("next").alias("next"))
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    full = salted(rows, hot, ["key"], F.col("text")).join(spread(heads, hot, ["key"]), ["key", "salt"])
    full = full.withColumn("rid", F.monotonically_increasing_id()).withColumn("n_chars", n)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - cut), F.substring(F.col("head"), F.lit(1), cut))
    full = full.withColumn("edited", edited).withColumn("sha", F.sha2(edited.cast("binary"), 256))
    # numbers are quicker to group by than strings
    quarters = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    keys = ["key", "salt", "rid", "next", "n_chars", *(f"sha{i}" for i in range(4))]
    full = full.select(*keys[:5], *quarters, "text", "edited")
    signed = checkpoint(signatures(full, keys, samples))
    other = signed.groupBy("key").agg(F.min("sig").alias("next_sig")).withColumnRenamed("key", "next")
    # rows that share an id share the document that follows them
    hot_next = hot if hot is None else hot.join(by_key, "key").select("next", "salts")
    out = signed.join(spread(other, hot_next, ["next"]), ["next", "salt"])
    return out.select(
        F.when(F.col("key") != SMALLEST, F.col("key")).alias("doc_id"),
        "n_chars",
        F.lower(F.concat(*(F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)))).alias("edited_sha256"),
        text_of(F.col("sig")).alias("fingerprint"),
        text_of(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
