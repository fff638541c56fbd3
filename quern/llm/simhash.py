"""SimHash near-dedup: 64-bit fingerprints, linked by a binary trie self-join, grouped into components.

A pair within 3 bits agrees exactly on one of four 16-bit blocks. Each distinct fingerprint is dealt once per block,
rotated so that the block leads; the rotated fingerprints of a block value form a binary trie. The trie is joined with
itself: node pairs descend together, the bits they differ in add up, and a pair is dropped once it exceeds the budget.
Only distinct fingerprints take part; copies hang on their fingerprint.

A block value with more than CHUNK fingerprints is dealt again by the bits that it leaves open: a pair within the budget
agrees on one of four parts of them, too. Each round makes four copies of the hot fingerprints and lengthens their common
prefix, from 16 bits to 28, 37 and 43, so that a task's trie is bounded whatever the number of documents. Tasks send stars
(member, smallest member), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, checkpoint, hot_keys, lower_words, salted, spread
from quern.llm.components import connected

WIDTH = 3
SEED = 42
BUDGET = 3
BLOCKS = 4
#: Fingerprints of a block value that are joined in one piece.
CHUNK = 4096
#: Rounds in which larger ones are dealt again, at most. After them a prefix leaves 21 bits open.
ROUNDS = 3


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    w = lower_words(text)
    if not w:
        return []
    if len(w) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    h = xxhash.xxh64_intdigest
    return [h(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(width)), strict=False)]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if set in over half the hashes; no words: 0."""
    return _fold(np.array(shingle_hashes(text, width), "<u8"))


def _fold(h: np.ndarray) -> int:
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp long (the fingerprint's 64 bits)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: int) -> np.ndarray:
    """Where the one-child of each node [lo, hi) starts; the nodes' keys agree above the bit at shift."""
    s = np.uint64(shift)
    return np.clip(np.searchsorted(keys, ((keys[lo] >> s) | np.uint64(1)) << s), lo, hi)


def trie_join(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int = BUDGET, most: int = 1 << 17, visits: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of the sorted keys that differ in at most budget bits.

    lo, hi: nodes to start from, [lo, hi) of keys that agree in the first depth bits; each is joined with itself. Node
    pairs descend to pairs of single keys. At most about `most` node pairs are held per level; more are worked off depth
    first. visits: takes the numbers of node pairs that are looked at.
    """
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, al, ah, bl, bh, diff = stack.pop()
        if visits is not None:
            visits.append(len(al))
        # two single keys: what they differ in below is counted at once
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            ok = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i != j)
            if ok.any():
                yield np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
        deep = ~leaf
        if not deep.any():
            continue
        al, ah, bl, bh, diff = al[deep], ah[deep], bl[deep], bh[deep], diff[deep]
        am, bm = _split(keys, al, ah, 63 - d), _split(keys, bl, bh, 63 - d)
        twin = al == bl
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        parts = [*parts, tuple(x[~twin] for x in (am, ah, bl, bm, diff + 1))]
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        # a node of one key has no pair with itself
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget) & ((nxt[0] != nxt[2]) | (nxt[1] - nxt[0] > 1))
        nxt = [x[keep] for x in nxt]
        for i in range(0, len(nxt[0]), most):
            stack.append((d + 1, *(x[i : i + most] for x in nxt)))


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; label[x] <= x leads to the class's smallest index."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, hi, lo)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _stars(node: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    label = np.arange(len(node))
    for i, j in found:
        _union(label, i, j)
    m = label != np.arange(len(node))
    return [node[m], node[label[m]]]


def _link(path: np.ndarray, depth: np.ndarray, key: np.ndarray, node: np.ndarray, budget: int) -> Iterator[list[np.ndarray]]:
    """Stars of whole groups: rows of one path that agree in their first depth bits."""
    for p in np.unique(path):
        m = np.flatnonzero(path == p)
        m = m[np.argsort(key[m], kind="stable")]
        k, d = key[m], int(depth[m[0]])
        prefix = k >> np.uint64(64 - d)
        lo = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        hi = np.append(lo[1:], len(k))
        many = hi - lo > 1
        yield _stars(node[m], trie_join(k, lo[many], hi[many], d, budget))


def _dealt(rows: DataFrame, agreed: int, blocks: int) -> tuple[DataFrame, int]:
    """path, key, val, node: each row of path, key and node once for each part of the bits that the first `agreed` leave
    open, with that part moved next to those; val: all bits that a group then agrees in. Returns their number, too."""
    rest = 64 - agreed
    width = rest // blocks
    key = F.col("key")
    if agreed:
        tail = key.bitwiseAND(F.lit(2**rest - 1))
        head = F.shiftleft(F.shiftrightunsigned(key, rest), rest)
        turn = lambda n: F.shiftleft(tail, n).bitwiseOR(F.shiftrightunsigned(tail, rest - n)).bitwiseAND(F.lit(2**rest - 1)).bitwiseOR(head)
    else:
        turn = lambda n: F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned(key, 64 - n))
    keys: list[Column] = [key if not n else turn(width * n) for n in range(blocks)]
    out = rows.select("path", "node", F.posexplode(F.array(*keys)).alias("p", "key"))
    agreed += width
    return out.select((F.col("path") * (blocks + 1) + F.col("p") + 1).alias("path"), "key", F.shiftrightunsigned("key", 64 - agreed).alias("val"), "node"), agreed


def links(reps: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Stars (a, b): within each group, members and the smallest member they reach. reps: fp, node; fp distinct.

    blocks must exceed budget, so that a pair within the budget agrees on one block.
    """
    if blocks <= budget or 64 % blocks:
        raise ValueError("blocks must divide 64 and exceed the budget")
    rows, agreed, pieces = reps.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("key"), "node"), 0, None
    for k in range(ROUNDS + 1):
        dealt, agreed = _dealt(rows, agreed, blocks)
        dealt = dealt.withColumn("depth", F.lit(agreed))
        hot = None
        if k < ROUNDS and (64 - agreed) // blocks:
            hot = checkpoint(dealt.groupBy("path", "val").count().where(F.col("count") > chunk).select("path", "val"))
            hot = hot if hot.limit(1).count() else None
        cold = dealt if hot is None else dealt.join(hot, ["path", "val"], "left_anti")
        cold = cold.select("path", "val", "depth", "key", "node")
        pieces = cold if pieces is None else pieces.unionByName(cold)
        if hot is None:
            break
        rows = checkpoint(dealt.join(hot, ["path", "val"], "left_semi").select("path", "key", "node"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {n: t.column(n).to_numpy() for n in ("path", "depth", "key", "node")}
            for x, y in _link(c["path"], c["depth"], c["key"].view(np.uint64), c["node"], budget):
                if len(x):
                    lo, hi = np.minimum(x, y), np.maximum(x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in it:
            held.append(batch)
            if sum(x.num_rows for x in held) < 400_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            g = np.stack([t.column(n).to_numpy() for n in ("path", "val")])
            last = t.num_rows - int(np.argmax((g[:, ::-1] != g[:, -1:]).any(axis=0)))  # the last group may go on
            if (g[:, :1] == g[:, -1:]).all():
                continue
            yield from flush(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    return pieces.repartition("path", "val").sortWithinPartitions("path", "val").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp long, component_id (smallest doc_id reachable over links of at most budget bits)."""
    fps = checkpoint(fingerprints(docs, width))
    reps = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    comp = connected(links(reps.where("node IS NOT NULL").select("fp", "node"), budget))
    by_fp = reps.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hot = hot_keys(reps, ["fp"])
    rows = salted(fps, hot, ["fp"], F.struct("doc_id", F.monotonically_increasing_id()))
    out = rows.join(spread(by_fp, hot, ["fp"]), ["fp", "salt"])
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, one row per row of docs.

    Null and blank texts have fingerprint zero, linked like any other. Repeated rows stay, one result row each; rows
    without a doc_id have a fingerprint and no component. Very long texts are taken whole. An empty table gives no rows.
    Other columns, of whatever name, are ignored.
    """
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# documents alike by their shingles ----------------------------------------------------------------------------------

#: What stages that remove near copies go by: words of a shingle, and the least Jaccard similarity of two sets of them.
STAGE_WIDTH = 5
SIMILARITY = 0.8
#: Slots that shingles are counted in, by hash, and blocks of slots that tasks add up.
SLOTS, SLOT_BLOCKS = 1 << 20, 16
_U = np.uint64


def _slot_counts(docs: DataFrame, width: int) -> np.ndarray:
    """Of each slot, how many shingles of all texts fall into it."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for big in it:
            for b in batches(big, 1024, 1 << 20):
                h = np.array([x for t in b.column("text").to_pylist() for x in shingle_hashes(t, width)], _U)
                total += np.bincount((h & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if total.any():
            raw = [zstandard.compress(x.astype("<i8").tobytes(), 1) for x in total.reshape(SLOT_BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_BLOCKS), pa.int32()), pa.array(raw, pa.binary())], ["block", "n"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for k, raw in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zstandard.decompress(raw), "<i8")
        if sums:
            raw = [zstandard.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(raw, pa.binary())], ["block", "n"])

    out = np.zeros((SLOT_BLOCKS, SLOTS // SLOT_BLOCKS), np.int64)
    schema = "block int, n binary"
    for r in docs.select("text").mapInArrow(count, schema).repartition(SLOT_BLOCKS, "block").mapInArrow(add, schema).collect():  # SLOTS numbers
        out[r["block"]] += np.frombuffer(zstandard.decompress(bytes(r["n"])), "<i8")
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def _least_shared(n: np.ndarray | int, similarity: float) -> np.ndarray | int:
    """The least number of shingles that a set of n shares with one like it; rounding errs to the smaller side."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def _sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, fp, same binary (128 bits of the words), size (of the set of shingles), rarest: its first shingles in an
    order of all shingles, rare slots first. Sets that are alike have one of these in common."""
    slots = docs.sparkSession.sparkContext.broadcast(_slot_counts(docs, width))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = slots.value
        for big in it:
            for b in batches(big):
                fps, same, size, rarest = [], [], [], []
                for text in b.column("text").to_pylist():
                    h = np.array(shingle_hashes(text, width), _U)
                    fps.append(_fold(h))
                    same.append(xxhash.xxh3_128_digest(b" ".join(lower_words(text))))
                    h = np.unique(h)
                    size.append(len(h))
                    most = len(h) - int(_least_shared(len(h), similarity)) + 1 if len(h) else 0
                    # equal counts stay in the order of hashes
                    first = np.argsort(count[(h & _U(SLOTS - 1)).astype(np.int64)], kind="stable")[:most]
                    rarest.append(h[first].view(np.int64))
                ends = np.cumsum([0, *map(len, rarest)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rarest])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, _U).view(np.int64)), pa.array(same, pa.binary()), pa.array(size, pa.int32()), lists], ["doc_id", "fp", "same", "size", "rarest"])

    return docs.mapInArrow(run, "doc_id long, fp long, same binary, size int, rarest array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows (h, node, size, pos), those whose h another row has, too, with the first row of that h: rep, rep_size and
    rep_pos."""
    names = ["h", "node", "size", "pos"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] | None = None  # of the h that the last batch ended with
        alone = False  # whether that row has not been given out
        for b in it:
            if not b.num_rows:
                continue
            c = [b.column(x).to_numpy().astype(np.int64) for x in names]
            if first is not None:
                c = [np.concatenate([[v], x]) for v, x in zip(first, c, strict=True)]
            start = np.flatnonzero(np.concatenate([[True], c[0][1:] != c[0][:-1]]))
            number = np.diff(np.append(start, len(c[0])))
            rep = np.repeat(start, number)
            many = np.repeat(number > 1, number)
            if first is not None and not alone:
                many[0] = False  # given out before
            last = int(start[-1])
            alone = bool(number[-1] == 1) and (first is None or last > 0 or alone)
            first = [int(x[last]) for x in c]
            k = np.flatnonzero(many)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in c] + [pa.array(x[rep[k]]) for x in c[1:]], [*names, "rep", "rep_size", "rep_pos"])

    rows = rows.select("h", "node", F.col("size").cast("long").alias("size"), F.col("pos").cast("long").alias("pos"))
    rows = rows.repartition("h").sortWithinPartitions("h", "node", "size", "pos")
    return rows.mapInArrow(run, "h long, node long, size long, pos long, rep long, rep_size long, rep_pos long")


def _may_be_alike(similarity: float, a: str = "", b: str = "rep_") -> Column:
    """Whether two sets may be alike whose first shingle in common, in the order, is in places a.pos and b.pos."""
    least = F.ceil((F.col(f"{a}size") + F.col(f"{b}size")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
    return (F.least(F.col(f"{a}size") - F.col(f"{a}pos"), F.col(f"{b}size") - F.col(f"{b}pos"))) >= least


def _alike(docs: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b and whether they are alike: the Jaccard similarity of two documents' sets of shingles, by 64 bits of hash."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                out = [np.unique(np.array(shingle_hashes(t, width), "<u8")).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "set"])

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = (b.column(c).to_pylist() for c in ("x", "y"))
            ok = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * max(1, len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "alike"])

    # rows that share an id are one document: the one whose set sorts first
    found = checkpoint(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id long, set binary").groupBy("doc_id").agg(F.min("set").alias("set")))
    hot = hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), ["b"])
    met = salted(pairs, hot, ["b"], F.col("a")).join(spread(found.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), hot, ["b"]), ["b", "salt"])
    met = met.join(found.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y")
    return checkpoint(met.mapInArrow(judge, "a long, b long, alike boolean"))


def groups(docs: DataFrame, width: int = STAGE_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component: every document that is not the smallest of its group, and the smallest. docs: doc_id, text, no
    null ids.

    Exact: two sets that are alike have one of their rarest shingles in common (prefix filter). Candidates that are met
    first are texts of equal words, SimHash neighbours, and documents with the smallest one of a shingle. Of what these
    leave apart, all pairs of a shingle that their sizes and its places don't rule out are compared.
    """
    sketches = checkpoint(_sketches(docs, width, similarity))
    reps = checkpoint(sketches.groupBy("same").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("fp").alias("fp")))
    hot = hot_keys(reps, ["same"])
    equal = salted(sketches.select("same", "doc_id"), hot, ["same"], F.col("doc_id")).join(spread(reps.select("same", "node"), hot, ["same"]), ["same", "salt"])
    edges = equal.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    rows = sketches.join(reps.select("same", F.col("node").alias("doc_id")), ["same", "doc_id"], "left_semi")
    met = checkpoint(_shared(rows.select(F.col("doc_id").alias("node"), "size", F.posexplode("rarest").alias("pos", "h"))))
    near = links(reps.groupBy("fp").agg(F.min("node").alias("node"))).select("a", "b")
    stars = met.where((F.col("node") != F.col("rep")) & _may_be_alike(similarity)).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    pairs = checkpoint(stars.unionByName(near).where("a <> b").distinct())
    judged = _alike(docs, pairs, width, similarity)
    found = judged.where("alike").select("a", "b")
    comp = checkpoint(connected(edges.unionByName(found)))
    # shingles whose documents are still of several components, and those that are not of the largest
    here = met.select("h", "node", "size", "pos").join(comp, "node", "left")
    here = here.select("h", "node", "size", "pos", F.coalesce("component", "node").alias("component"))
    parts = here.groupBy("h", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = checkpoint(here.join(main, "h"))
    side = lambda df, p: df.select("h", *(F.col(c).alias(p + c) for c in ("node", "size", "pos", "component", "main")))
    more = side(mixed.where("component <> main"), "x_").join(side(mixed, "y_"), "h")
    apart = (F.col("x_component") != F.col("y_component")) & ((F.col("y_component") == F.col("y_main")) | (F.col("x_node") > F.col("y_node")))
    more = more.where(apart & _may_be_alike(similarity, "x_", "y_")).select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b"))
    more = checkpoint(more.distinct().join(judged.select("a", "b"), ["a", "b"], "left_anti"))
    out = comp.select(F.col("node").alias("doc_id"), "component")
    late = _alike(docs, more, width, similarity).where("alike") if more.limit(1).count() else more.limit(0)
    if not late.limit(1).count():
        return out
    # components that these pairs join, and what becomes of their documents
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    late = late.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = checkpoint(connected(late.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))))
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    hot = hot_keys(out.groupBy("component").agg(F.count("*").alias("n")), ["component"])
    # components of no smaller one are in `joined` alone
    moved = salted(out, hot, ["component"], F.col("doc_id")).join(spread(to, hot, ["component"]), ["component", "salt"], "left")
    return moved.select("doc_id", F.coalesce("to", "component").alias("component")).unionByName(joined.select(F.col("node").alias("doc_id"), "component"))


def keep_one(docs: DataFrame, width: int = STAGE_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Pipeline stage: of each group of documents alike, the one with the smallest doc_id stays, once if its row is
    repeated. All columns stay, whatever their names.

    Two documents are alike if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; a text of fewer
    words has one shingle, and texts without words are alike. Rows without a doc_id can't be told apart and stay.
    """
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = groups(known, width, similarity).select(F.col("doc_id").alias("_gone"))
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(docs.columns)
    if known.groupBy("doc_id").count().where("count > 1").limit(1).collect():
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return kept
