"""Substring dedup: seed and extend on winnowed anchors.

Seeds: of the word 8-grams in each window of 35 words, the one with the least hash is the window's anchor. Equal
windows have equal anchors, so that any repeat of 35 words is found among documents joined on anchors, with a
fourteenth of all positions as seeds. Extension: the windows that share an anchor form its reach, up to 27 words to
either side. A reach that another occurrence has too is a repeat as a whole. Occurrences whose reach differs from every
other are narrowed window by window, against each other and one representative of each repeated reach. Overlapping
repeats merge into maximal ones by covering words.

Nothing is done pair by pair: occurrences meet as counts by (anchor, reach) and (anchor, window), 128 bits of hash in
all, and counts are combined before they are sent. Where occurrences are joined with what was found of their anchor,
reach or window, frequent ones are dealt over many tasks by a salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, checkpoint, hot_keys, materialise, plain_words, salted, spread

LENGTH = 35
GRAM = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 1 << 12)
        for k, b in enumerate((BASE, _U(pow(int(BASE), -1, 2**64)))):
            f = np.full(m, b, _U)
            f[0] = 1
            _powers[k] = np.cumprod(f, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hashes of any run of a document's words, from sums over its words."""

    def __init__(self, words: list[bytes]):
        h = xxhash.xxh64_intdigest
        x = np.array([h(w) for w in words], _U)
        p, self.inverse = _power(len(x) + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(x * p[: len(x)], dtype=_U)])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U))


def anchors(rolling: Rolling, n: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window) of each anchor; windows start at words 0 to n - length."""
    i = np.arange(n - gram + 1)
    g = rolling.runs(i, i + gram)
    at = np.lib.stride_tricks.sliding_window_view(g, length - gram + 1).argmin(axis=1) + np.arange(n - length + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]], first, np.append(first[1:], len(at)) - 1


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, reach, key, lo, hi: each anchor with the hash of its reach and the windows lo to hi it stands for."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                    w = plain_words(text)
                    if len(w) < length:
                        continue
                    r = Rolling(w)
                    a, lo, hi = anchors(r, len(w), length, gram)
                    for c, x in zip(out, (a, r.runs(lo, hi + length), np.full(len(a), key), lo, hi), strict=True):
                        c.append(x)
                if out[0]:
                    a, s, k, lo, hi = (np.concatenate(c) for c in out)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(k), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["anchor", "reach", "key", "lo", "hi"])

    return docs.select("key", "text").mapInArrow(run, "anchor long, reach long, key long, lo int, hi int")


def _windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, window, key, at, known: each window of the wanted occurrences. wanted: key, spots."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for key, text, spots in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("spots"), strict=True):
                    r = Rolling(plain_words(text))
                    s = spots.values
                    a, lo, hi, known = (s.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "lo", "hi", "known"))
                    m = hi - lo + 1
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                    for c, x in zip(out, (np.repeat(a, m), r.runs(at, at + length), np.full(len(at), key), at, np.repeat(known, m)), strict=True):
                        c.append(x)
                if out[0]:
                    a, w, k, at, known = (np.concatenate(c) for c in out)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(w.view(np.int64)), pa.array(k), pa.array(at.astype(np.int32)), pa.array(known.astype(bool))], ["anchor", "window", "key", "at", "known"])

    return docs.join(wanted, "key").select("key", "text", "spots").mapInArrow(run, "anchor long, window long, key long, at int, known boolean")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, spans: for each document with repeats, the runs (lo, hi) of window starts whose words start elsewhere too.

    docs: key long, unique, and text.
    """
    found = materialise(_occurrences(docs, length, gram), "anchors")
    own = F.struct("key", "lo")
    # documents are joined on anchors: those that are found once go
    shared = checkpoint(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(shared, ["anchor"])
    joined = salted(found, hot, ["anchor"], own).join(spread(shared.select("anchor"), hot, ["anchor"]), ["anchor", "salt"])
    found = materialise(joined.select("anchor", "reach", "key", "lo", "hi"), "shared")
    # matches are extended both ways as far as an anchor reaches
    reach = checkpoint(found.groupBy("anchor", "reach").agg(F.count("*").alias("n"), F.min("key").alias("first")))
    forms = reach.groupBy("anchor").agg(F.count("*").alias("forms"))
    state = salted(reach, hot, ["anchor"], F.col("reach")).join(spread(forms, hot, ["anchor"]), ["anchor", "salt"]).drop("salt")
    state = checkpoint(state.where("n > 1 OR forms > 1"))
    hot = hot_keys(state, ["anchor", "reach"])
    spots = salted(found, hot, ["anchor", "reach"], own).join(spread(state, hot, ["anchor", "reach"]), ["anchor", "reach", "salt"])
    narrow = (F.col("forms") > 1) & ((F.col("n") == 1) | (F.col("key") == F.col("first")))
    spots = materialise(spots.select("anchor", "key", "lo", "hi", (F.col("n") > 1).alias("whole"), narrow.alias("narrow")), "spots")
    whole = spots.where("whole").select("key", "lo", "hi")
    # where that differs, each step of the extension meets the same step elsewhere
    wanted = spots.where("narrow").groupBy("key").agg(F.collect_list(F.struct("anchor", "lo", "hi", F.col("whole").alias("known"))).alias("spots"))
    windows = materialise(_windows(docs, wanted, length), "windows")
    twice = checkpoint(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(twice, ["anchor", "window"])
    single = salted(windows.where("NOT known"), hot, ["anchor", "window"], F.struct("key", "at")).join(spread(twice, hot, ["anchor", "window"]), ["anchor", "window", "salt"])
    single = single.select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))
    # overlapping repeats are merged where words are taken out; a document's spans are no more than its windows
    return whole.union(single).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _kept(text: str | None, spans, length: int) -> tuple[list[bytes], int]:
    w = plain_words(text)
    if spans is None or not len(spans):
        return w, len(w)
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, spans.field("lo").to_numpy(zero_copy_only=False), 1)
    np.add.at(edge, spans.field("hi").to_numpy(zero_copy_only=False) + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w[i] for i in np.flatnonzero(keep)], len(w)


def _keyed(docs: DataFrame, doc_id: str) -> DataFrame:
    """docs with a key that tells rows apart: the doc_id where ids are unique, and otherwise rows are numbered once and
    written. No column of docs but doc_id may be called key."""
    n, ids, few = docs.agg(F.count("*"), F.count(doc_id), F.approx_count_distinct(doc_id, 0.02)).first()
    if n == ids and few >= 0.9 * n and not docs.groupBy(doc_id).count().where("count > 1").limit(1).collect():
        return docs.withColumn("key", F.col(doc_id).cast("long"))
    return materialise(docs.withColumn("key", F.monotonically_increasing_id()), "numbered")


def query(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per row of docs.

    A null or blank text has no words and keeps the empty text. Repeated rows are documents of their own, so that their
    windows repeat. Very long texts are taken whole. An empty table gives no rows. Other columns, of whatever name, are
    ignored.
    """
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    spans = repeats(rows, length, gram)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                out = []
                for text, s in zip(b.column("text").to_pylist(), b.column("spans"), strict=True):
                    kept, n = _kept(text, s.values if s.is_valid else None, length)
                    out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                n, gone, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Pipeline stage: docs with repeated words taken out of text; n_chars, where there is one, follows.

    A text that loses no word stays as it is, a null one null; else its kept words are joined by spaces. All rows and
    columns stay, whatever the columns' names; repeated rows are documents of their own.
    """
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name meets one of ours
    doc_id, text_at, chars_at = (f"c{names.index(n)}" if n in names else None for n in ("doc_id", "text", "n_chars"))
    rows = _keyed(inner, doc_id)
    spans = repeats(rows.select("key", F.col(text_at).cast("string").alias("text")), length, gram)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                new = []
                for text, s in zip(b.column(text_at).to_pylist(), b.column("spans"), strict=True):
                    if s.is_valid:
                        text = b" ".join(_kept(text, s.values, length)[0]).decode("utf-8", "surrogatepass")
                    new.append(text)
                cols = {c: b.column(c) for c in b.schema.names if c != "spans"}
                cols[text_at] = pa.array(new, cols[text_at].type)
                if chars_at:
                    cols[chars_at] = pa.array([len(t) if t is not None and s.is_valid else c for t, s, c in zip(new, b.column("spans"), b.column(chars_at).to_pylist(), strict=True)], cols[chars_at].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return rows.join(spans, "key", "left").select(*inner.columns, "spans").mapInArrow(run, inner.schema).toDF(*names)
