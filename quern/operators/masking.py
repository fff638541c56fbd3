"""Masking of spans and permutation of sentences for denoising. Choices are hashes, so that they repeat anywhere."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.encode import MASK, PAD, SPECIALS

#: The share of masked tokens, the mean length of a span, and the label of what is not masked.
RATIO, MEAN_SPAN, IGNORED = 0.3, 3.0, -100


def _number(*key: object) -> float:
    """A number in [0, 1) from a hash."""
    return int(hashlib.md5("-".join(map(str, key)).encode()).hexdigest()[:12], 16) / 16**12


def poisson(u: float, mean: float = MEAN_SPAN) -> int:
    """The Poisson variate whose distribution function first exceeds u."""
    k, term, total = 0, math.exp(-mean), math.exp(-mean)
    while u >= total and k < 1000:
        k += 1
        term *= mean / k
        total += term
    return k


def masked(rows: list[list[int]], seed: str, ratio: float = RATIO, mean: float = MEAN_SPAN) -> list[tuple[list[int], list[int]]]:
    """Ids with masked spans, and labels, of a batch of id lists of one length.

    The batch's budget is the share of its tokens, specials aside, rounded up. Lengths of spans are drawn until they reach
    it, empty ones aside, and as many stay as come nearest to it. Spans start at different tokens and end with their row;
    special tokens are never masked. Labels are the ids of masked places. A masked span is one mask, and what follows it
    moves up, so that labels and ids no longer stand side by side.
    """
    open_places = [(i, j) for i, row in enumerate(rows) for j, x in enumerate(row) if x not in SPECIALS]
    budget = math.ceil(len(open_places) * ratio)
    if not budget:
        return [(list(row), list(row)) for row in rows]
    spans, total = [], 0
    while total < budget:
        n = poisson(_number(seed, "length", len(spans)), mean)
        spans.append(n)
        total += n
    spans = [n for n in spans if n]
    sums = [abs(sum(spans[: k + 1]) - budget) for k in range(len(spans))]
    spans = spans[: sums.index(min(sums)) + 1]
    starts = sorted(open_places, key=lambda p: (_number(seed, "start", *p), p))[: len(spans)]
    hidden: set[tuple[int, int]] = set()
    for (i, j), n in zip(starts, spans, strict=False):
        hidden.update((i, k) for k in range(j, min(j + n, len(rows[i]))) if rows[i][k] not in SPECIALS)
    out = []
    for i, row in enumerate(rows):
        labels = [x if (i, j) in hidden else IGNORED for j, x in enumerate(row)]
        ids = [MASK if (i, j) in hidden else x for j, x in enumerate(row) if (i, j) not in hidden or (i, j - 1) not in hidden]
        out.append((ids + [PAD] * (len(row) - len(ids)), labels))
    return out


def span_mask(rows: DataFrame, batch: str, key: str, seed: str, ratio: float = RATIO, mean: float = MEAN_SPAN) -> DataFrame:
    """batch, key, ids, labels: rows (batch, key, ids) with masked spans, a batch at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        found = masked([list(map(int, x)) for x in group["ids"]], f"{seed}-{group[batch].iloc[0]}", ratio, mean)
        return pd.DataFrame({batch: group[batch], key: group[key], "ids": [i for i, _ in found], "labels": [x for _, x in found]})

    kinds = dict(rows.dtypes)
    return rows.select(batch, key, "ids").groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, ids array<long>, labels array<long>")


def permuted(sentences: Column, key: Column, seed: str, ratio: float) -> Column:
    """An array of sentences, of which a share, rounded up, change places among each other: those whose hashes sort first
    move to their places in the order of another hash."""
    # a value that a lambda takes is computed once, however often it is used
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    dice = lambda name, i: F.md5(F.concat_ws("-", F.lit(f"{seed}-{name}"), key.cast("string"), i.cast("string")).cast("binary"))
    order = lambda name, of: F.transform(F.sort_array(F.transform(of, lambda i: F.struct(dice(name, i).alias("d"), i.alias("i")))), lambda x: x["i"])
    pair = lambda i, source: F.struct(i.alias("i"), source.alias("source"))

    def moved(s: Column) -> Column:
        n = F.size(s)
        most = F.ceil(n * F.lit(ratio)).cast("int")
        places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda _: n > 0)

        def sources(picked: Column) -> Column:
            moving = F.slice(picked, 1, most)
            rest = F.transform(F.slice(picked, most + 1, F.greatest(n, F.lit(1))), lambda i: pair(i, i))
            return F.sort_array(F.concat(F.zip_with(moving, order("place", moving), pair), rest))

        return F.transform(once(order("pick", places), sources), lambda x: F.element_at(s, x["source"]))

    return once(sentences, moved)
