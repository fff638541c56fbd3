"""Relational operators over words, sequences, graphs and vectors.

Everything is a declarative plan: aggregations combine before they are sent, windows are per key, and nothing is
collected. Random choices are orders by md5(seed-id), so that they repeat anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.encode import truncated  # noqa: F401  kept here for callers
from quern.operators.metrics import entropy, multiset_f1  # noqa: F401
from quern.operators.ranks import ranked
from quern.operators.similarity import nearest  # noqa: F401


def dice(seed: str, *keys: Column) -> Column:
    """A reproducible order: md5 of seed and keys."""
    return F.md5(F.concat_ws("-", F.lit(seed), *(k.cast("string") for k in keys)).cast("binary"))


def uniform(seed: str, *keys: Column) -> Column:
    """A reproducible number in [0, 1): the first 32 bits of the dice."""
    return F.conv(F.substring(dice(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# counts -------------------------------------------------------------------------------------------------------------


def word_counts(words: DataFrame, *by: str) -> DataFrame:
    """words: w. w, cnt."""
    return words.groupBy(*by, "w").agg(F.count("*").alias("cnt"))


def witten_bell(counts: DataFrame) -> DataFrame:
    """p = c / (N + T), and T / ((N + T) Z) for each of the Z words with no count. The totals are one row."""
    t = counts.agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("cnt") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("cnt") == 0, 1).otherwise(0)).alias("z"))
    seen = F.col("cnt") / (F.col("n") + F.col("t"))
    unseen = F.col("t") / ((F.col("n") + F.col("t")) * F.col("z"))
    return counts.crossJoin(F.broadcast(t)).select("w", "cnt", F.when(F.col("cnt") > 0, seen).otherwise(unseen).alias("p"))


def seed_unseen(counts: DataFrame, others: DataFrame) -> DataFrame:
    """Adds words of others that have no count, with 0."""
    return counts.select("w", "cnt").unionByName(others.select("w").distinct().join(counts, "w", "left_anti").withColumn("cnt", F.lit(0).cast("long")))


def char_grams(names: DataFrame, name: str, most: int) -> DataFrame:
    """name, n, pos (from 0), gram, nxt, prv: every gram of 1 to most characters; names are distinct first."""
    c = F.col(name)
    grams = names.select(name).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(F.length(c) >= F.col("n"))
    grams = grams.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length(c) - F.col("n"))))
    at = lambda start, n: F.substring(c, start, n)
    return grams.select(name, "n", "pos", at(F.col("pos") + 1, F.col("n")).alias("gram"), F.nullif(at(F.col("pos") + F.col("n") + 1, F.lit(1)), F.lit("")).alias("nxt"), F.when(F.col("pos") > 0, at(F.col("pos"), F.lit(1))).alias("prv"))


def freedoms(grams: DataFrame) -> DataFrame:
    """gram, cnt, f_next, f_prev: how many different characters follow and precede a gram."""
    return grams.groupBy("gram").agg(F.count("*").alias("cnt"), F.countDistinct("nxt").alias("f_next"), F.countDistinct("prv").alias("f_prev"))


def mutual_information(grams: DataFrame) -> DataFrame:
    """gram, cnt, mi = n_xy n / (n_x n_y) of character pairs, all counted over pairs."""
    two = grams.where("n = 2").groupBy("gram").agg(F.count("*").alias("cnt")).withColumn("x", F.substring("gram", 1, 1)).withColumn("y", F.substring("gram", 2, 1))
    total = two.agg(F.sum("cnt").alias("n_all"))
    x, y = two.groupBy("x").agg(F.sum("cnt").alias("cx")), two.groupBy("y").agg(F.sum("cnt").alias("cy"))
    # the total is one row, and there are as many x and y as characters
    return two.join(x, "x").join(y, "y").crossJoin(F.broadcast(total)).select("gram", "cnt", (F.col("cnt") * F.col("n_all") / (F.col("cx") * F.col("cy"))).alias("mi"))


def conditional(grams: DataFrame) -> DataFrame:
    """gram, p_next, p_prev of pairs: the second character after the first, the first before the second."""
    one = grams.where("n = 1").groupBy("gram").agg(F.count("*").alias("c"))
    two = grams.where("n = 2").groupBy("gram").agg(F.count("*").alias("cnt")).withColumn("x", F.substring("gram", 1, 1)).withColumn("y", F.substring("gram", 2, 1))
    x, y = one.select(F.col("gram").alias("x"), F.col("c").alias("cx")), one.select(F.col("gram").alias("y"), F.col("c").alias("cy"))
    return two.join(x, "x", "left").join(y, "y", "left").select("gram", (F.col("cnt") / F.col("cx")).alias("p_next"), (F.col("cnt") / F.col("cy")).alias("p_prev"))


def probability_profile(grams: DataFrame, name: str, n: int) -> DataFrame:
    """name, pos, p_p, p_m: of a character after those before it, and before those after it, up to n in all; 0 at the ends
    and for an unknown whole, and an unknown part counts as 1. For n = 1, over the greatest of a name's."""
    counts = grams.groupBy("gram").agg(F.count("*").cast("double").alias("c"))
    c = F.col(name)
    start = F.greatest(F.col("pos") - n + 1, F.lit(0))
    stop = F.least(F.col("pos") + n, F.length(c))
    own = grams.where("n = 1").select(name, "pos")
    at = lambda a, b: F.substring(c, a + 1, b - a)
    own = own.withColumn("w_p", at(start, F.col("pos") + 1)).withColumn("u_p", at(start, F.col("pos"))).withColumn("w_m", at(F.col("pos"), stop)).withColumn("u_m", at(F.col("pos") + 1, stop))
    for g in ("w_p", "u_p", "w_m", "u_m"):
        own = own.join(counts.select(F.col("gram").alias(g), F.col("c").alias(f"c_{g}")), g, "left")
    ratio = lambda s: F.coalesce(F.col(f"c_w_{s}"), F.lit(0.0)) / F.coalesce(F.col(f"c_u_{s}"), F.lit(1.0))
    p = F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(ratio("p"))
    m = F.when(F.col("pos") == F.length(c) - 1, F.lit(0.0)).otherwise(ratio("m"))
    out = own.select(name, "pos", p.alias("p_p"), m.alias("p_m"))
    if n == 1:
        top = F.greatest(F.max("p_p").over(Window.partitionBy(name)), F.max("p_m").over(Window.partitionBy(name)))
        out = out.select(name, "pos", F.try_divide("p_p", top).alias("p_p"), F.try_divide("p_m", top).alias("p_m"))
    return out


def gram_freedoms(grams: DataFrame, name: str) -> DataFrame:
    """gram, n, cnt, f_next, f_prev: of each gram, and how many different grams of up to its length follow and precede it."""
    c, end = F.col(name), F.col("pos") + F.col("n")
    start = F.greatest(F.col("pos") - F.col("n"), F.lit(0))
    nxt = F.nullif(F.substring(c, end + 1, F.col("n")), F.lit(""))
    prv = F.when(F.col("pos") > 0, F.substring(c, start + 1, F.col("pos") - start))
    each = grams.select("gram", "n", nxt.alias("nxt"), prv.alias("prv"))
    return each.groupBy("gram", "n").agg(F.count("*").alias("cnt"), F.countDistinct("nxt").alias("f_next"), F.countDistinct("prv").alias("f_prev"))


def freedom_model(grams: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The counts of grams (gram, cnt), and of the characters after (gram, nxt, cnt) and before them (gram, prv, cnt)."""
    return (
        grams.groupBy("gram").agg(F.count("*").alias("cnt")),
        grams.where("nxt IS NOT NULL").groupBy("gram", "nxt").agg(F.count("*").alias("cnt")),
        grams.where("prv IS NOT NULL").groupBy("gram", "prv").agg(F.count("*").alias("cnt")),
    )


def leaves(*tables: DataFrame) -> int:
    """How many entries tables of counts have."""
    return sum(t.count() for t in tables)


def last_wins(pairs: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, value: of pairs that share a key, the one that comes last."""
    return pairs.groupBy(key).agg(F.max_by(value, order).alias(value))


def deviations(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """rows with dv_ columns: how far each column lies above its mean in its name, 0 below; and their sums and products of
    the first with the second one place on."""
    w = Window.partitionBy(name)
    out = rows.withColumns({f"dv_{c}": F.greatest(F.col(c) - F.avg(c).over(w), F.lit(0.0)) for c in columns})
    if len(columns) == 2:
        a, b = F.col(f"dv_{columns[0]}"), F.lead(f"dv_{columns[1]}").over(w.orderBy("pos"))
        out = out.withColumn("dv_sum", a + b).withColumn("dv_product", a * b)
    return out


def summed_over(rows: DataFrame, name: str, value: str, lengths: int) -> DataFrame:
    """name, pos, value: sums over `lengths` values of n, null where one is missing, over the greatest of a name."""
    s = rows.groupBy(name, "pos").agg(F.when(F.count(value) == lengths, F.sum(value)).alias(value))
    return s.select(name, "pos", F.try_divide(value, F.max(value).over(Window.partitionBy(name))).alias(value))


def profile(grams: DataFrame, name: str, n: int) -> DataFrame:
    """Freedom of the gram that ends (f_p) and begins (f_m) at each position, and their steps and peaks."""
    free = freedoms(grams.where(F.col("n") <= n))
    own = grams.where("n = 1").select(name, "pos")
    c = F.col(name)
    back = F.greatest(F.col("pos") - n + 1, F.lit(0))
    own = own.withColumn("g_p", F.substring(c, back + 1, F.col("pos") - back + 1)).withColumn("g_m", F.substring(c, F.col("pos") + 1, F.least(F.lit(n), F.length(c) - F.col("pos"))))
    fp, fm = free.select(F.col("gram").alias("g_p"), F.col("f_next").alias("f_p")), free.select(F.col("gram").alias("g_m"), F.col("f_prev").alias("f_m"))
    out = own.join(fp, "g_p", "left").join(fm, "g_m", "left").select(name, "pos", F.coalesce("f_p", F.lit(0)).alias("f_p"), F.coalesce("f_m", F.lit(0)).alias("f_m"))
    w = Window.partitionBy(name).orderBy("pos")
    out = out.withColumn("d_p", F.col("f_p") - F.lag("f_p").over(w)).withColumn("d_m", F.col("f_m") - F.lead("f_m").over(w))
    return out.withColumn("peak_p", F.col("d_p") - F.lead("d_p").over(w)).withColumn("peak_m", F.col("d_m") - F.lag("d_m").over(w))


def compress(counts: DataFrame, t: float, *by: str) -> DataFrame:
    """Drops entries below t times the largest of their group."""
    top = counts.groupBy(*by).agg(F.max("cnt").alias("top"))
    out = counts.join(top, list(by)) if by else counts.crossJoin(F.broadcast(top))
    return out.where(F.col("cnt") >= t * F.col("top")).drop("top")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """w, diff: counts of a less those of b; equal counts of words that both have go."""
    j = a.select("w", F.col("cnt").alias("x")).join(b.select("w", F.col("cnt").alias("y")), "w", "full")
    return j.where("x IS NULL OR y IS NULL OR x <> y").select("w", (F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).alias("diff"))


def merge(*counts: DataFrame) -> DataFrame:
    out = counts[0].select("w", "cnt")
    for c in counts[1:]:
        out = out.unionByName(c.select("w", "cnt"))
    return out.groupBy("w").agg(F.sum("cnt").alias("cnt"))


# vocabularies and encoding ------------------------------------------------------------------------------------------


def vocabulary(counts: DataFrame, specials: int, most: int | None = None, least: int = 1) -> DataFrame:
    """id, w, cnt: by falling count, then by word; ids follow the specials. Ranked by count and the word's beginning, so
    that no task holds the whole vocabulary; a bounded one is cut first."""
    kept = counts.where(F.col("cnt") >= least)
    if most is not None:
        kept = kept.orderBy(F.desc("cnt"), "w").limit(most)
    return _by_count(kept).select((F.col("r") + specials - 1).cast("long").alias("id"), "w", "cnt")


def _by_count(counts: DataFrame) -> DataFrame:
    return ranked(counts, [F.desc("cnt"), F.col("w")], [(F.col("cnt"), True), (F.substring("w", 1, 2), False)])


def extend(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """vocab with the words of counts that it lacks, ranked after its own."""
    new = counts.join(vocab, "w", "left_anti")
    last = vocab.agg(F.max("id").alias("last"))
    new = _by_count(new).crossJoin(F.broadcast(last)).select((F.col("last") + F.col("r")).alias("id"), "w", "cnt")
    return vocab.select("id", "w", "cnt").unionByName(new)


def encode(words: DataFrame, vocab: DataFrame, keys: list[str], length: int, sos: int | None, eos: int | None, pad: int = 0, unk: int = 1) -> DataFrame:
    """keys, ids: words (keys, pos, w) as `length` ids, cut or padded; the end mark may be cut off."""
    known = words.join(vocab.select("w", "id"), "w", "left").select(*keys, "pos", F.coalesce("id", F.lit(unk)).alias("id"))
    # only what can stay is collected
    seq = known.where(F.col("pos") < length).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    n = words.groupBy(*keys).agg(F.count("*").alias("n"))
    ids = F.col("ids")
    if sos is not None:
        ids = F.concat(F.array(F.lit(sos).cast("long")), ids)
    if eos is not None:
        ids = F.concat(ids, F.array(F.lit(eos).cast("long")))
    fill = F.array_repeat(F.lit(pad).cast("long"), length)
    return seq.join(n, keys).select(*keys, F.slice(F.concat(ids, fill), 1, length).alias("ids"))


# sequences ----------------------------------------------------------------------------------------------------------


def context_pairs(seq: DataFrame, key: str, order: list[str], token: str, reach: int = 2, least: int = 4) -> DataFrame:
    """left, right, n: pairs up to `reach` apart in sequences of `least` or more, each counted again from its second
    end unless it starts the sequence."""
    w = Window.partitionBy(key).orderBy(*order)
    s = seq.select(key, F.col(token).alias("left"), (F.row_number().over(w) - 1).alias("j"), F.count("*").over(Window.partitionBy(key)).alias("len"), *(F.lead(token, i).over(w).alias(f"r{i}") for i in range(1, reach + 1)))
    s = s.where(F.col("len") >= least).withColumn("right", F.explode(F.array(*(F.col(f"r{i}") for i in range(1, reach + 1))))).where("right IS NOT NULL")
    return s.groupBy("left", "right").agg(F.sum(F.when(F.col("j") == 0, 1).otherwise(2)).alias("n"))


def next_pairs(seq: DataFrame, key: str, order: list[str], token: str, times: int = 2) -> DataFrame:
    """left, right, n: each word with the next one; a pair is written `times` times."""
    w = Window.partitionBy(key).orderBy(*order)
    return seq.select(F.col(token).alias("left"), F.lead(token).over(w).alias("right")).where("right IS NOT NULL").groupBy("left", "right").agg((F.count("*") * times).alias("n"))


def align(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two numbered lists (key, pos, val) of the same keys, side by side up to the shorter."""
    return a.select(key, "pos", F.col("val").alias("a")).join(b.select(key, "pos", F.col("val").alias("b")), [key, "pos"])


def chunks(seq: DataFrame, size: int) -> DataFrame:
    """seq: g, len, in order. Adds chunk: rows of one concatenated stream in chunks of size; a partial last one goes."""
    return seq.withColumn("chunk", F.floor((F.col("at") - 1) / size)).where((F.col("chunk") + 1) * size <= F.col("total"))


def split_exact(rows: DataFrame, key: str, seed: str, parts: dict[str, float], rest: str) -> DataFrame:
    """key, part: shares of the rows in the order of the dice, floors of n * share; what is left goes to rest."""
    n = rows.select(key).distinct()
    # the dice are uniform, so that their first digits make equal buckets
    order = ranked(n.withColumn("_dice", dice(seed, F.col(key))), [F.col("_dice"), F.col(key)], [(F.substring("_dice", 1, 3), False)])
    dealt = order.select(key, "r").crossJoin(F.broadcast(n.agg(F.count("*").alias("n"))))
    out, at = F.lit(None), F.lit(0)
    whens = []
    for name, share in parts.items():
        at = at + F.floor(F.col("n") * share)
        whens.append((name, at))
    for name, upto in reversed(whens):
        out = F.when(F.col("r") <= upto, name).otherwise(F.lit(rest) if name == whens[-1][0] else out)
    return dealt.select(key, out.alias("part"))


def variant_pairs(variants: DataFrame, key: str, seed: str, times: int = 5) -> DataFrame:
    """key, k, v1, v2: exactly `times` pairs of each key's distinct variants (key, v). Four or more variants: pairs by
    dice; three: all three and two again; two: the one pair; one: the variant with itself."""
    a, b = variants.select(key, F.col("v").alias("v1")), variants.select(key, F.col("v").alias("v2"))
    pairs = a.join(b, key).where("v1 < v2")
    lone = variants.groupBy(key).agg(F.count("*").alias("c"), F.min("v").alias("v1"), F.min("v").alias("v2")).where("c = 1").drop("c")
    pairs = pairs.unionByName(lone)
    w = Window.partitionBy(key).orderBy(dice(seed, F.col(key), F.col("v1"), F.col("v2")), "v1", "v2")
    ranked = pairs.withColumn("r", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy(key)))
    return ranked.where(F.col("r") <= times).withColumn("k", F.explode(F.filter(F.sequence(F.col("r"), F.lit(times), F.least(F.col("m"), F.lit(times)).cast("int")), lambda x: x <= times))).select(key, F.col("k").cast("long").alias("k"), "v1", "v2")


def negative_pairs(rows: DataFrame, keys: list[str], seeds: tuple[str, str, str] = ("n", "m", "r"), share: float = 0.25) -> DataFrame:
    """keys, label, first, second, other_first, other_second: of pairs (keys, left, right), a share are made negative: the
    second of one comes from another pair, whose number in the order of a dice another dice chooses, and the other's sides
    change places."""
    order = [dice(seeds[2], *map(F.col, keys)), *map(F.col, keys)]
    d = rows.withColumn("_dice", dice(seeds[2], *map(F.col, keys)))
    at = ranked(d, [F.col("_dice"), *order[1:]], [(F.substring("_dice", 1, 3), False)], (), "_r").withColumn("_r", F.col("_r") - 1)
    n = rows.agg(F.count("*").alias("_n"))
    drawn = at.crossJoin(F.broadcast(n)).withColumn("_pick", F.floor(uniform(seeds[1], *map(F.col, keys)) * F.col("_n")))
    both = drawn.join(at.select(F.col("_r").alias("_pick"), F.col("right").alias("_other")), "_pick")
    good = uniform(seeds[0], *map(F.col, keys)) > share
    swap = lambda a, b: F.when(good, F.col(a)).otherwise(F.col(b))
    return both.select(*keys, F.when(good, 1).otherwise(0).alias("label"), F.col("left").alias("first"), swap("right", "_other").alias("second"), swap("left", "right").alias("other_first"), swap("right", "left").alias("other_second"))


def systematic(rows: DataFrame, order: Column, bucket: Column, text: Column, wanted: int, excluded: tuple[str, ...]) -> DataFrame:
    """i, line, text: lines at equal steps through rows in an order, each the first from there on that is neither empty nor,
    but for the last line, begins with an excluded word. Lines are numbered from 0."""
    at = ranked(rows.withColumn("_text", text), [order], [(bucket, False)], (), "line").withColumn("line", F.col("line") - 1)
    n = rows.agg(F.count("*").alias("_n"))
    left_out = F.lit(False)
    for x in excluded:
        left_out = left_out | F.col("_text").startswith(x)
    usable = at.crossJoin(F.broadcast(n)).where(~((F.length("_text") == 0) | (left_out & (F.col("line") + 1 < F.col("_n")))))
    steps = n.select(F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))).alias("i"), (F.bround(F.col("_n") / F.lit(float(wanted + 1)), 0)).alias("_step"))
    steps = steps.select(F.col("i").cast("long").alias("i"), (F.col("i") * F.col("_step")).cast("long").alias("_from"))
    # few wanted lines meet all lines, of which a task keeps the least for each
    near = usable.select("line", "_text").join(F.broadcast(steps), F.col("line") >= F.col("_from"))
    return near.groupBy("i").agg(F.min("line").alias("line"), F.min_by("_text", "line").alias("text"))


# graphs -------------------------------------------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def sources(edges: DataFrame) -> DataFrame:
    """node: sources that nothing leads to."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def ego(edges: DataFrame, radius: int) -> DataFrame:
    """root, node, hop: nodes within `radius` of each root; edges are undirected and distinct."""
    seen = edges.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    last = seen
    for hop in range(1, radius + 1):
        step = last.join(edges, last["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        last = step.join(seen, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(last)
    return seen


def last_before(rows: DataFrame, key: str, order: list[str], is_def: Column, is_use: Column, name: str) -> DataFrame:
    """Uses with the latest definition before them in their key, null if there is none."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("def", F.last(F.when(is_def, F.col(name)), ignorenulls=True).over(w)).where(is_use)
