"""Toxicity by class-conditional Kneser-Ney bigram models.

One model is counted from toxic and one from ordinary documents. Each interpolates bigrams, absolutely discounted, with
the class's own continuation counts (distinct words before a word), and those with continuation counts shared by both
classes, so that rare expressions are as likely in one class as in the other. A text is judged by the two models'
log-likelihoods per word, of the whole text and of its most toxic passage; a logistic link on these two ratios is fitted
on labelled documents that the counts have not seen.

A bigram's count is the number of documents that hold it, so that no document's own words weigh by their repetition. The
discount is the one of DISCOUNTS with the least loss on documents that the counts have not seen; None stands for Kneser
and Ney's estimate n1 / (n1 + 2 n2) from the counts of counts. That estimate leaves words of one or two documents enough
weight to drown the expressions that toxic documents share, see README.

Labels are learned from a bounded sample: at most MAX_TOXIC and MAX_ORDINARY documents, chosen by a hash of doc_id, each
with its whole text. The model that goes to the executors holds words and bigrams of that sample only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batches, fewest

#: Labelled documents that are learned from, at most.
MAX_TOXIC = 2000
MAX_ORDINARY = 4000
HELD_OUT_FOLD, FOLDS = 0, 5
#: Words of a passage.
PASSAGE = 8
DISCOUNTS = (None, 3.0, 6.0, 12.0, 24.0)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


@dataclass
class Model:
    """Log ratios of the toxic to the ordinary model. Words are numbered in the order of index; the number after the last
    stands for all other words, and for the place before a text."""

    index: dict[bytes, int]
    uni: np.ndarray  # of a word by continuation counts alone
    back: np.ndarray  # of the weights that the models give to those after a word
    keys: np.ndarray  # counted bigrams, as first * (size + 1) + second, sorted
    both: np.ndarray  # of those bigrams
    link: tuple[float, float, float] = (4.0, 1.0, -3.0)

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word after the one before."""
        get, n = self.index.get, len(self.index)
        return self.ratios_of(np.fromiter((get(w, n) for w in words), np.int64, len(words)))

    def ratios_of(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.index)
        before = np.concatenate([[n], ids[:-1]]) if len(ids) else ids
        out = self.uni[ids] + self.back[before]
        if len(self.keys) and len(ids):
            key = before * (n + 1) + ids
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.both[at], out)
        return out

    def features(self, w: list[bytes]) -> tuple[float, float]:
        """Log-likelihood ratio per word: of the whole text, and of its most toxic passage."""
        return self.summary(self.ratios(w))

    @staticmethod
    def summary(r: np.ndarray) -> tuple[float, float]:
        if not len(r):
            return 0.0, 0.0
        if len(r) <= PASSAGE:
            return float(r.mean()), float(r.sum() / PASSAGE)
        s = np.concatenate([[0.0], np.cumsum(r)])
        return float(r.mean()), float((s[PASSAGE:] - s[:-PASSAGE]).max() / PASSAGE)

    def score(self, text: str | None) -> float:
        a, b = self.features(tokens(text))
        x, y, z = self.link
        return float(1 / (1 + np.exp(-np.clip(x * a + y * b + z, -30, 30))))


def estimate(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), of how many counts are one and two; a half where there are none of either."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def _once(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Documents as sorted distinct bigrams, each group of copies once: those that share, with no single one that stays
    before them, over half of the larger's bigrams. A group of copies is evidence of one document."""
    if not docs:
        return []
    size = np.array([len(d) for d in docs])
    _, which, spread = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(docs), dtype=np.int32), size)[np.argsort(which, kind="stable")]
    start, at = np.cumsum(spread) - spread, np.cumsum(size) - size
    stays = np.zeros(len(docs), bool)
    for k, own in enumerate(docs):
        mine = which[at[k] : at[k] + size[k]]
        # over half of the bigrams are shared, so one of the rarer half of them is; those of one document are not
        rare = mine[np.argsort(spread[mine], kind="stable")][: (len(mine) + 1) // 2]
        rare = rare[spread[rare] > 1]
        n = spread[rare]
        others = holders[np.repeat(start[rare] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        near = np.flatnonzero(np.bincount(others[(others < k) & stays[others]], minlength=1))
        stays[k] = not any(2 * len(np.intersect1d(own, docs[j], assume_unique=True)) > max(len(own), len(docs[j])) for j in near)
    return [docs[k] for k in np.flatnonzero(stays)]


@dataclass
class Tally:
    """Bigrams of the toxic and of the ordinary documents, and in how many documents each is. A group of copies counts as
    one document."""

    index: dict[bytes, int]
    pairs: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Tally:
        index: dict[bytes, int] = {}
        numbered = [[np.array([index.setdefault(w, len(index)) for w in d], np.int64) for d in docs] for docs in (toxic, ordinary)]
        return cls.of_ids(index, *numbered)

    @classmethod
    def of_ids(cls, index: dict[bytes, int], toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> Tally:
        """From documents of words by their numbers."""
        n, pairs, times = len(index), [], []
        for docs in (toxic, ordinary):
            rows = _once([np.unique(np.concatenate([[n], d[:-1]]) * (n + 1) + d) for d in docs if len(d)])
            k, t = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_counts=True)
            pairs.append(k)
            times.append(t.astype(float))
        return cls(index, pairs, times)

    def model(self, discount: float | None = None) -> Model:
        """The two models. discount: taken from each count, as far as it goes, and given to the level below."""
        n = len(self.index)
        keys = np.union1d(*self.pairs)
        first, second = (keys // (n + 1)).astype(np.int32), (keys % (n + 1)).astype(np.int32)
        # continuation counts, each class's own and shared
        own = np.stack([np.bincount(k % (n + 1), minlength=n + 1) for k in self.pairs], axis=1).astype(float)
        shared = (own.sum(axis=1) + 1) / (own.sum() + n + 1)
        low, gamma, p = np.empty((n + 1, 2)), np.zeros((n + 1, 2)), np.empty((len(keys), 2))
        for c, (k, t) in enumerate(zip(self.pairs, self.times, strict=True)):
            total = own[:, c].sum()
            kept = np.maximum(own[:, c] - (estimate(own[:, c]) if discount is None else discount), 0)
            low[:, c] = kept / total + (1 - kept.sum() / total) * shared if total else shared
            after = np.bincount(k // (n + 1), t, minlength=n + 1)
            kept = np.maximum(t - (estimate(t) if discount is None else discount), 0)
            taken = np.bincount(k // (n + 1), t - kept, minlength=n + 1)
            left = np.where(after > 0, taken / np.maximum(after, 1), 1.0)
            gamma[:, c] = np.log(left)
            seen = np.zeros(len(keys))
            seen[np.searchsorted(keys, k)] = kept
            p[:, c] = seen / np.maximum(after[first], 1) + left[first] * low[second, c]
        ratio = lambda x: x[:, 0] - x[:, 1]
        low = np.log(low)
        return Model(self.index, ratio(low), ratio(gamma), keys, ratio(np.log(p)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Newton's method with a small ridge; returns weights (bias last) and the mean loss."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def learn(rows: list[tuple[int, str | None, int]], discounts: tuple[float | None, ...] = DISCOUNTS) -> Model:
    """rows: doc_id, text, toxic. Counts on one half choose the discount and the link on the other; then all rows count."""
    index: dict[bytes, int] = {}
    docs = []
    for i, text, y in rows:  # words are kept as numbers, as the driver holds the whole sample
        docs.append((zlib.crc32(b"half" + str(i).encode()) % 2, np.array([index.setdefault(w, len(index)) for w in tokens(text)], np.int64), y))
    if len({y for *_, y in docs}) < 2:
        base = 30.0 if docs and docs[0][2] else -30.0
        none = np.zeros(1)
        return Model({}, none, none, np.zeros(0, np.int64), np.zeros(0), (0.0, 0.0, base))
    pick = lambda half, y: [w for h, w, c in docs if h != half and c == y]
    halves = [(h, Tally.of_ids(index, pick(h, 1), pick(h, 0))) for h in (0, 1) if pick(h, 1) and pick(h, 0)]
    best = None
    for d in discounts:
        x, y = [], []
        for half, tally in halves:
            m = tally.model(d)
            for h, w, c in docs:
                if h == half:
                    x.append(m.summary(m.ratios_of(w)))
                    y.append(c)
        if len(set(y)) == 2:
            w, loss = _logistic(np.array(x), np.array(y, float))
            if best is None or loss < best[0]:
                best = loss, d, w
    del halves
    model = Tally.of_ids(index, pick(2, 1), pick(2, 0)).model(best[1] if best else discounts[0])
    if best:
        model.link = tuple(map(float, best[2]))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """Learns from labelled rows outside the held-out fold; the highest label of an id counts, null labels do not."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT_FOLD)
    few = fewest(known.where("toxic = 1"), "toxic", max_toxic).union(fewest(known.where("toxic = 0"), "toxic", max_ordinary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    # of rows that share an id the text that sorts first, so that no more rows than ids are collected
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return learn(sorted(((r["doc_id"], r["text"], r["toxic"]) for r in rows), key=lambda r: (r[0], r[1] or "")))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted. A text without words has no evidence; its score is the link's constant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in batches(big):
                s = [shared.value.score(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None")).cast("binary")) % FOLDS == HELD_OUT_FOLD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs.

    Null, empty and blank texts have no evidence; their score is the link's constant. Very long texts are scored whole.
    Repeated rows stay, a null doc_id counts as held in no fold but that of "None". Without labels, or with one class
    only, all scores are equal. An empty table gives no rows. Other columns, of whatever name, are ignored.
    """
    return scored(docs, fit(docs, labels))
