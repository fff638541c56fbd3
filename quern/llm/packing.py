"""Best-fit packing by patterns: non-negative least squares over a histogram of lengths.

Krell et al., "Efficient sequence packing without cross-contamination" (2021). Patterns of up to three lengths that fill
a sequence are enumerated over bins of lengths; non-negative least squares fits their repeat counts to the histogram;
counts are rounded down to what the histogram holds; each repeat takes exact lengths from its bins, the best fit first.
What is left is packed longest first into the tightest open room. All planning works on the histogram, which has at
most `capacity` entries; documents meet the plan by their rank among those of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import TOKENIZER, Encoder, batches, checkpoint

CAPACITY = 2048
END_ID = 0
BIN = 8
#: Each length's pieces are ranked in so many parts, so that no task holds all pieces of one length.
RANK_PARTS = 64


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, carried: tuple[str, ...] = (), room: int = 4 << 20, keep: bool = True) -> DataFrame:
    """doc_id, carried, piece, start, length, ids_crc32. Documents over the capacity are cut; the first piece may be
    shorter. carried: columns of docs that their pieces keep. room: bytes of text that are encoded at once; keep: whether
    the ids of words stay with a worker after a task, for the next one.

    A null text is empty and has the end id alone. Repeated rows are documents of their own.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(tokenizer)
        names = ["doc_id", *carried, "piece", "start", "length", "ids_crc32"]
        for big in it:
            for b in batches(big, 4096, room):
                ids, at = encoder.flat(b.column("text"), end_id)
                size = np.diff(at)
                n = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # the first piece is the shorter one
                end = size[owner] - (n[owner] - 1 - piece) * capacity
                start = np.maximum(0, end - capacity)
                crc = [zlib.crc32(ids[x:y]) for x, y in zip((at[owner] + start).tolist(), (at[owner] + end).tolist(), strict=True)]
                own = [b.column(c).take(pa.array(owner)) for c in ("doc_id", *carried)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64())], names)
        if not keep:
            Encoder.drop(tokenizer)

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in carried), "piece int, start long, length long, ids_crc32 long"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried).mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson and Hanson's active sets: x >= 0 with the least |ax - b|."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, np.abs(b).max())
    for _ in range(rounds or 3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= tol:
            break
        passive[k] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= 0)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            passive &= x > tol * 1e-3
            x[~passive] = 0
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Ways to fill a sequence of `bins` units with one, two or three lengths, longest first."""
    out: list[tuple[int, ...]] = [(bins,)]
    out += [(i, bins - i) for i in range(bins - 1, (bins - 1) // 2, -1) if bins - i >= 1]
    out += [(i, j, bins - i - j) for i in range(bins - 2, 0, -1) for j in range(min(i, bins - i - 1), 0, -1) if 1 <= bins - i - j <= j]
    return out


class _Left:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.count)

    def at_most(self, n: int) -> int | None:
        k = bisect.bisect_right(self.order, n)
        return self.order[k - 1] if k else None

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect.bisect_left(self.order, length))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = BIN) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, sequence of the first rank, offset) that place every piece once.

    Ranks follow each other in sequences. There are no more rows than steps that use up a length or a class of rooms.
    """
    left = _Left(histogram)
    used: dict[int, int] = {}
    out: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[list[int]]] = {}  # room: runs [first sequence, number, offset]
    open_rooms: list[int] = []
    n_seq = 0

    def place(length: int, n: int, seq: int, offset: int) -> None:
        first = used.get(length, 0)
        out.append((length, first, first + n, seq, offset))
        used[length] = first + n
        left.take(length, n)

    def open_room(room: int, seq: int, n: int) -> None:
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(open_rooms, room)
            rooms[room].append([seq, n, capacity - room])

    bins = -(-capacity // width)
    h = np.zeros(bins + 1)
    for length, n in histogram.items():
        h[-(-length // width)] += n
    known = [p for p in patterns(bins) if all(h[k] for k in p)]
    if known:
        a = np.zeros((bins, len(known)))
        for c, p in enumerate(known):
            for k in p:
                a[k - 1, c] += 1
        fitted = np.floor(nnls(a, h[1:]) + 1e-6).astype(int)
        for c in np.argsort(-fitted, kind="stable"):
            times = int(fitted[c])
            while times > 0:
                taken: list[int] = []
                need: dict[int, int] = {}
                for k in known[c]:
                    # the first from its own bin; the last may be any that fits best in what is left
                    top = capacity - sum(taken) if taken and len(taken) == len(known[c]) - 1 else k * width
                    got = left.at_most(min(top, capacity - sum(taken)))
                    while got is not None and need.get(got, 0) >= left.count[got]:
                        got = left.at_most(got - 1)
                    if got is None or got <= (k - 2) * width:
                        break
                    taken.append(got)
                    need[got] = need.get(got, 0) + 1
                if len(taken) < len(known[c]):
                    break
                n = min(times, *(left.count[x] // m for x, m in need.items()))
                offset = 0
                for x in taken:
                    place(x, n, n_seq, offset)
                    offset += x
                open_room(capacity - offset, n_seq, n)
                n_seq, times = n_seq + n, times - n
    while left.order:  # residuals: longest first, into the tightest room
        length = left.order[-1]
        n = left.count[length]
        k = bisect.bisect_left(open_rooms, length)
        if k < len(open_rooms):
            room = open_rooms[k]
            run = rooms[room][-1]
            m = min(n, run[1])
            place(length, m, run[0], run[2])
            open_room(room - length, run[0], m)
            run[0], run[1] = run[0] + m, run[1] - m
            if not run[1]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    open_rooms.remove(room)
        else:
            each = capacity // length
            if n >= each:
                m = n // each
                for s in range(each):
                    place(length, m, n_seq, s * length)
                open_room(capacity - each * length, n_seq, m)
                n_seq += m
            else:
                for s in range(n):
                    place(length, 1, n_seq, s * length)
                open_room(capacity - n * length, n_seq, 1)
                n_seq += 1
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, width: int = BIN, parts: int = RANK_PARTS, by: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces. found must not change when it is computed again (a checkpoint or table).

    by: a column of few values that are packed apart, in their order: sequences of a smaller value have smaller numbers.
    """
    spark, carried = found.sparkSession, [by] if by else []
    found = found.withColumn("_by", F.col(by) if by else F.lit(0))
    histograms: dict[int, dict[int, int]] = {}
    for r in found.groupBy("_by", "length").count().collect():  # at most `capacity` rows for each value of by
        histograms.setdefault(r[0], {})[r[1]] = r[2]
    rows, first = [], 0
    for value in sorted(histograms):
        placed = plan(histograms[value], capacity, width)
        rows += [(value, length, r0, r1, seq0 + first, offset) for length, r0, r1, seq0, offset in placed]
        first += 1 + max(seq0 + r1 - r0 - 1 for _, r0, r1, seq0, _ in placed)
    placed = spark.createDataFrame(rows, "_by int, length long, r0 long, r1 long, seq0 long, offset long")
    # rows without a doc_id may be copies of each other, which nothing but their place parts
    spot = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", spot), F.lit(parts)).cast("int"))
    keys = ["_by", "length"]
    sizes = dealt.groupBy(*keys, "part").count()
    before = sizes.select(*keys, "part", (F.sum("count").over(Window.partitionBy(*keys).orderBy("part")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("rank", rank).join(before, [*keys, "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan's size is bounded by the histograms', not by the documents
    p = F.broadcast(placed)
    on = [ranked[k] == p[k] for k in keys] + [ranked["rank"] >= p["r0"], ranked["rank"] < p["r1"]]
    return ranked.join(p, on).select("doc_id", *carried, "piece", "start", ranked["length"], "ids_crc32", (F.col("seq0") + F.col("rank") - F.col("r0")).alias("sequence_id"), "offset")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of docs.

    A null text is empty and has the end id alone. Repeated rows, and rows without a doc_id, are documents of their own.
    Very long texts are encoded whole and cut. An empty table gives no rows. Other columns, of whatever name, are ignored.
    """
    return pack(checkpoint(pieces(docs)))
