"""Segmentation of names: unigram splitting, lexicons, rules, boundaries by freedoms, and a three-way vote.

Scalar functions where a text is scanned statefully; `named` runs them over distinct names, each with what a join found
for it, so that no model is collected. Spans are inclusive (start, end) pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.abbreviations import Lexicon

Span = tuple[int, int]
#: Longest word that may stand before another in a unigram segmentation.
LONGEST = 9
#: Lengths that the rules go by.
LONG_NAME, LONGEST_PART, LEAST_WORD, LEAST_ABBREVIATION, CUT_FROM = 10, 13, 3, 2, 4


def spans_of(parts: Iterable[str]) -> list[Span]:
    out, at = [], 0
    for p in parts:
        if p:
            out.append((at, at + len(p) - 1))
            at += len(p)
    return out


# unigram model ------------------------------------------------------------------------------------------------------


def best_segmentation(text: str, p: dict[str, float], longest: int = LONGEST, mode: str = "faithful", size: int | None = None) -> list[str]:
    """Most likely parts, in logs. A part is a known word of up to `longest` characters, or of any length at the text's end,
    or a single character; of equal segmentations the one with the shortest first part.

    mode: faithful divides each word's probability by the number of words (`size`, by default of p), and gives an unknown
    character one part in it; standard takes words as they are and charges unknown characters the square of that.
    """
    if not text:
        return []
    n = max(2, size if size is not None else len(p))
    share, floor = (math.log(n), -math.log(n)) if mode == "faithful" else (0.0, -2 * math.log(n))
    best: list[tuple[float, int]] = [(0.0, len(text))] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        top = (-math.inf, i + 1)
        for j in range(i + 1, len(text) + 1):
            if j - i > longest and j < len(text):
                continue
            w = text[i:j]
            own = math.log(p[w]) - share if p.get(w, 0) > 0 and (j - i > 1 or mode != "faithful") else floor if j - i == 1 else -math.inf
            if own + best[j][0] > top[0]:
                top = (own + best[j][0], j)
        best[i] = top
    out, i = [], 0
    while i < len(text):
        out.append(text[i : best[i][1]])
        i = best[i][1]
    return out


# lexicons -----------------------------------------------------------------------------------------------------------

OPENING, CLOSING = "'\"{[(", "'\":,;.!?}])"


def detached_head(text: str, chars: str = OPENING) -> tuple[list[str], str | None]:
    """Quotes and brackets before a word, and the word; None if there is none."""
    n = len(text) - len(text.lstrip(chars))
    return list(text[:n]), text[n:] if n < len(text) else None


def detached_tail(text: str, chars: str = CLOSING) -> tuple[list[str], str | None]:
    """Quotes, brackets and marks after a word, and the word; None if there is none."""
    n = len(text.rstrip(chars))
    return list(text[n:]), text[:n] if n else None


def delimited(text: str) -> list[str]:
    """Words between blanks and underscores with their blanks, quotes and marks as parts of their own."""
    out: list[str] = []
    for piece in text.replace("_", " ").split(" "):
        if out:
            out.append(" ")
        head, word = detached_head(piece)
        out += head
        tail, word = detached_tail(word) if word else ([], None)
        out += [word] if word else []
        out += tail
    return out


def by_letter(weights: dict[str, float], sort: str = "log") -> dict[str, list[str]]:
    """Words by first letter, by falling length, weight, or log weight times length ("length", "weight", "log"), then word."""
    key = {
        "length": lambda w: -len(w),
        "weight": lambda w: -weights[w],
        "log": lambda w: -math.log10(weights[w]) * len(w),
    }[sort]
    out: dict[str, list[str]] = {}
    for w in sorted((w for w in weights if w), key=lambda w: (key(w), w)):
        out.setdefault(w[0], []).append(w)
    return out


def merged_weights(pairs: Iterable[tuple[str, float]], lower: bool = True) -> dict[str, float]:
    """Sums of weights by word, in lower case if wanted."""
    out: dict[str, float] = {}
    for w, x in pairs:
        w = w.lower() if lower else w
        out[w] = out.get(w, 0.0) + x
    return out


def greedy_lexicon(text: str, lists: dict[str, list[str]], fold: bool = False) -> list[str]:
    """At each place the first word of its letter's list that fits; characters between words are one part. fold: words are
    looked for in lower case; parts keep theirs."""
    out, loose, i = [], "", 0
    seen = text.lower() if fold else text
    while i < len(text):
        hit = next((w for w in lists.get(seen[i], ()) if seen.startswith(w, i)), None)
        if hit:
            out += [loose, text[i : i + len(hit)]] if loose else [text[i : i + len(hit)]]
            loose, i = "", i + len(hit)
        else:
            loose, i = loose + text[i], i + 1
    return [*out, loose] if loose else out


def longest_first(text: str, words: Iterable[str], fold: bool = False) -> list[str]:
    """The longest word that fits at each place; of equal lengths the first in order."""
    lists: dict[str, list[str]] = {}
    for w in sorted((w for w in words if w), key=lambda w: (-len(w), w)):
        lists.setdefault(w[0], []).append(w)
    return greedy_lexicon(text, lists, fold)


def merged_grams(grams: list[str], counts: dict[str, int], rounds: int) -> list[str]:
    """Overlapping grams of a text (each shares all but a character with the next), the most frequent of which takes in its
    neighbours, so many times; the first of equal ones."""
    for _ in range(rounds):
        if len(grams) < 2:
            break
        k = max(range(len(grams)), key=lambda i: (counts.get(grams[i], 0), -i))
        lo, hi = max(0, k - 1), min(len(grams), k + 2)
        joined = grams[k]
        if k > 0:
            joined = grams[k - 1][:-1] + joined
        if k + 1 < len(grams):
            joined += grams[k + 1][1:]
        if k == len(grams) - 1 and k > 0:  # the last one is taken in whole
            joined = grams[k - 1] + grams[k][1:]
        grams = [*grams[:lo], joined, *grams[hi:]]
    return grams


# boundaries ---------------------------------------------------------------------------------------------------------


def boundary_spans(forward: list[float | None], backward: list[float | None], t: float) -> list[Span]:
    """A span closes after i where forward[i] or backward[i + 1] reaches t; where both do, it joins the one before."""
    out: list[Span] = []
    start, n = 0, len(forward)
    reached = lambda x: x is not None and x >= t
    for i in range(n):
        a = i + 1 < n and reached(backward[i + 1])
        b = reached(forward[i])
        if a and b and out:
            out[-1] = (out[-1][0], i)
            start = i + 1
        elif a or b:
            out.append((start, i))
            start = i + 1
    if start < n:
        out.append((start, n - 1))
    return out


def forward_parts(text: str, forward: list[float | None], t: float) -> list[str]:
    """Parts that end where the forward metric reaches t."""
    out, start = [], 0
    for i, x in enumerate(forward):
        if x is not None and x >= t:
            out.append(text[start : i + 1])
            start = i + 1
    return [*out, text[start:]] if start < len(text) else out


def peaks(rises: list[float], falls: list[float]) -> tuple[list[float | None], list[float | None]]:
    """Of freedoms after (rises) and before (falls) each place: by how much the step up to a place exceeds the step after
    it, forward, and the step down from a place the one before it, backward; None where there is no such step."""
    n = len(rises)
    up = [None, *(rises[i] - rises[i - 1] for i in range(1, n))][:n]
    down = [*(falls[i] - falls[i + 1] for i in range(n - 1)), None][-n:] if n else []
    minus = lambda a, b: None if a is None or b is None else a - b
    return [minus(up[i], up[i + 1]) if i + 1 < n else None for i in range(n)], [minus(down[i], down[i - 1]) if i else None for i in range(n)]


def scaled_sum(lists: list[list[float | None]]) -> list[float | None]:
    """Sums place by place, None where one is missing, over their greatest; by IEEE division, as the greatest may be 0."""
    total = [None if any(x is None for x in column) else sum(column) for column in zip(*lists, strict=True)]
    known = [x for x in total if x is not None]
    if not known:
        return total
    top = max(known)
    if top:
        return [None if x is None else x / top for x in total]
    return [None if x is None or x == 0 else math.copysign(math.inf, x) for x in total]


def freedom_spans(text: str, after: dict[str, int], before: dict[str, int], words: list[str], lengths: Iterable[int] = (1, 2, 3, 4, 5), t: float = 0.1) -> list[Span]:
    """Spans by peaks of freedom. after, before: how many characters follow and precede a gram; words: the parts that a
    lexicon makes of the text, at whose ends freedoms count double (four times for a part of one character)."""
    bonus = [1] * len(text)
    for a, b in spans_of(words):
        bonus[a] *= 2
        bonus[b] *= 2
    forward, backward = [], []
    for n in lengths:
        rises = [bonus[i] * after.get(text[max(0, i - n + 1) : i + 1], 0) for i in range(len(text))]
        falls = [bonus[i] * before.get(text[i : i + n], 0) for i in range(len(text))]
        f, b = peaks(rises, falls)
        forward.append(f)
        backward.append(b)
    return boundary_spans(scaled_sum(forward), scaled_sum(backward), t)


# rules --------------------------------------------------------------------------------------------------------------


def _cut(text: str, word: str) -> str:
    at = text.index(word)
    return text[:at] + text[at + len(word) :]


def known_parts(text: str, lexicon: Lexicon) -> list[str]:
    """Words and abbreviations found in a long word, quickly: a known word is itself; long abbreviations, the words they
    stand for, and stopwords are cut out; from the rest, from left to right, the shortest known part, or the first longer
    word that begins with it."""
    is_word = lexicon.words.__contains__
    if is_word(text):
        return [text]
    out, rest = [], text
    for short, full in lexicon.abbreviations.items():
        if len(short) < CUT_FROM:
            continue
        hit = False
        for w in full:
            if short in rest and w in rest:
                out.append(w)
                rest, hit = _cut(rest, w), True
        if not hit and short in rest:
            out.append(short)
            rest = _cut(rest, short)
    for w in lexicon.stopwords:
        if len(w) >= CUT_FROM and w in rest:
            out.append(w)
            rest = _cut(rest, w)
    if rest and is_word(rest):
        return [*out, rest]
    at, n = 0, len(rest)
    while at < n:
        step = 0
        for end in range(at + LEAST_ABBREVIATION, n + 1):
            part = rest[at:end]
            if part in lexicon.abbreviations:
                full = [w for w in lexicon.abbreviations[part] if w in rest[at:]]
                out += full or [part]
                step = sum(map(len, full)) or len(part)
                break
            if len(part) >= LEAST_WORD and is_word(part):
                longer = next((rest[at:e] for e in range(end + 1, n + 1) if is_word(rest[at:e])), part)
                out.append(longer)
                step = len(longer)
                break
        at += step or 1
    return out


def subtracted(text: str, words: list[str]) -> list[str]:
    """text taken apart at each word in turn, at its first place in the first piece that holds it: the words, then the pieces
    left, in the text's order."""
    found, pieces = [], [text]
    for w in words:
        k = next((i for i, p in enumerate(pieces) if w in p), None)
        if k is not None:
            found.append(w)
            before, after = pieces[k].split(w, 1)
            pieces[k : k + 1] = [p for p in (before, after) if p]
    return found + pieces


def parts_inside(text: str, lexicon: Lexicon) -> set[str]:
    """All abbreviations and known words inside a text."""
    inside = {text[i:j] for i in range(len(text)) for j in range(i + LEAST_ABBREVIATION, len(text) + 1)}
    return {w for w in inside if w in lexicon.abbreviations or len(w) >= LEAST_WORD and w in lexicon.words}


def best_cut(text: str, parts: set[str]) -> list[str]:
    """Of parts at their first places, those that do not overlap with the greatest sum of squared lengths; of equal choices
    the one whose spans sort first. In their order."""
    spans = sorted((text.index(w), text.index(w) + len(w)) for w in parts)
    best: list[tuple[int, tuple[Span, ...]]] = [(0, ())] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        choices = [best[i + 1], *((best[e][0] + (e - s) ** 2, ((s, e), *best[e][1])) for s, e in spans if s == i)]
        top = max(c[0] for c in choices)
        best[i] = top, min(c[1] for c in choices if c[0] == top)
    return [text[a:b] for a, b in best[0][1]]


def canonical_words(name: str, lexicon: Lexicon) -> set[str]:
    """Words of a name by the rules, of two characters or more."""
    out: set[str] = set()
    for word in name.split():
        if word.isdigit():
            continue
        for part in subtracted(word, known_parts(word, lexicon)) if len(word) >= LONG_NAME else [word]:
            if len(part) > LONGEST_PART:
                out.add(part)
                continue
            cut = best_cut(part, parts_inside(part, lexicon))
            out.update([x for w in cut for x in re.findall("[a-zA-Z]+", w)] if cut else [part])
    return {w for w in out if len(w) >= 2}


def occurrences(text: str, word: str) -> list[Span]:
    """Places of a word in a text, none overlapping; ends are exclusive."""
    return [m.span() for m in re.finditer(re.escape(word), text)]


def uncontained(places: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Places of words that are found more than once, without those inside a larger one of any word; ends are exclusive."""
    every = [s for v in places.values() for s in v]
    inside = lambda s: any(a <= s[0] and s[1] <= b and (a, b) != s for a, b in every)
    return {w: [s for s in v if not inside(s)] if len(v) > 1 else v for w, v in places.items()}


def rule_spans(name: str, lexicon: Lexicon) -> list[Span]:
    """Spans by the rules: the first place of each canonical word, and what lies between. Where no word is found, or after
    the last one, what is left goes from the second character, or from the end of that one, on."""
    words = [x for w in sorted(canonical_words(name, lexicon)) for x in lexicon.splits.get(w, w).split()]
    places = uncontained({w: occurrences(name.lower(), w) for w in words})
    out: list[Span] = []
    end = -1
    for start, stop in sorted(v[0] for v in places.values() if v):
        if end + 1 < start:
            out.append((end + 1, start - 1))
        out.append((start, stop - 1))
        end = stop - 1
    last = max(end, 0)
    if last != len(name) - 1:
        out.append((last + 1, len(name) - 1))
    return out


# vote ---------------------------------------------------------------------------------------------------------------


def vote(text: str, unigram: list[Span], rules: list[Span], freedom: list[Span], shared_ends: bool = True) -> list[str]:
    """Spans that two of three splitters have, then those of the splitter with most of them, where they fit; gaps are
    parts too. On a tie the rules win. Spans of one character are gaps.

    shared_ends: a span may begin with the character that another ends with; that character is then in both parts.
    """
    u, r, f = set(unigram), set(rules), set(freedom)
    agreed = (u & r) | (u & f) | (r & f)
    score = {"r": len(r & agreed), "f": len(f & agreed), "u": len(u & agreed)}
    base = freedom if score["f"] > max(score["r"], score["u"]) else unigram if score["u"] > score["r"] else rules
    apart = (lambda s, x: s[1] <= x[0] or s[0] >= x[1]) if shared_ends else (lambda s, x: s[1] < x[0] or s[0] > x[1])
    taken: list[Span] = []
    for s in [*sorted(agreed), *base]:
        if s[0] < s[1] and all(apart(s, x) for x in taken):
            taken.append(s)
    out, at = [], 0
    for a, b in sorted(taken):
        out += [text[at:a], text[a : b + 1]]
        at = b + 1
    return [x for x in [*out, text[at:]] if x]


# over tables --------------------------------------------------------------------------------------------------------


def substrings(names: DataFrame, name: str = "name") -> DataFrame:
    """name, w: the distinct substrings of distinct names."""
    c = F.col(name)
    start = names.select(name).distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.length(c)))).where(F.length(c) > 0)
    ends = start.withColumn("n", F.explode(F.sequence(F.lit(1), F.length(c) - F.col("i") + 1)))
    return ends.select(name, F.substring(c, F.col("i"), F.col("n")).alias("w")).distinct()


def found_in(names: DataFrame, lexicon: DataFrame, value: str, name: str = "name", alias: str = "found") -> DataFrame:
    """name and a map of the words inside it to their values. lexicon: w and value. Words meet names by an equi-join on
    substrings, so that a lexicon of any size is looked up whole."""
    pairs = substrings(names, name).join(lexicon.select("w", value), "w")
    return pairs.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("w", value))).alias(alias))


def named(f: Callable[..., list[str]], *columns: Column) -> Column:
    """A splitter as a vectorised column function: the parts joined by underscores; maps that are null are empty."""

    @F.pandas_udf("string")
    def run(*s: pd.Series) -> pd.Series:
        plain = lambda x: dict(x) if isinstance(x, list) else {} if x is None or isinstance(x, float) and math.isnan(x) else x
        return pd.Series([None if row[0] is None else "_".join(f(row[0], *map(plain, row[1:]))) for row in zip(*s, strict=True)], dtype=object)

    return run(*columns)


def applied(f: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A splitter that needs nothing but the text, as a column function."""
    return lambda c: named(f, c)
