"""Worked examples of the operators, and their properties."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import abbreviations as A
from quern.functions import text as T
from quern.operators import encode as E
from quern.operators import segment as S
from quern.operators import tables as O
from quern.operators.similarity import aligned

WORDS = ["tuna", "is", "fish", "cat", "mammal"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "w string, cnt long")


def test_tokenizers():
    assert S.detached_head("test") == ([], "test") and S.detached_head("'\"") == (["'", '"'], None) and S.detached_head("\"'test") == (['"', "'"], "test")
    assert S.detached_tail("it's.\"") == ([".", '"'], "it's") and S.detached_tail("..") == ([".", "."], None)
    assert S.delimited('say_"hi there."') == ["say", " ", '"', "hi", " ", "there", ".", '"']
    lists = S.by_letter(dict.fromkeys(WORDS, 1.0), "length")
    assert S.greedy_lexicon("tunaisafish.catisamammal", lists) == ["tuna", "is", "a", "fish", ".", "cat", "is", "a", "mammal"]
    assert S.greedy_lexicon("Tunaisafish.Catisamammal", lists) == ["Tuna", "is", "a", "fish", ".Cat", "is", "a", "mammal"]
    assert S.greedy_lexicon("Tunaisafish.Catisamammal", lists, fold=True) == ["Tuna", "is", "a", "fish", ".", "Cat", "is", "a", "mammal"]
    assert S.longest_first("tunaisafish", [*WORDS, "tunais"]) == ["tunais", "a", "fish"]
    assert S.merged_weights([("A", 1), ("a", 2.5), ("b", 1)]) == {"a": 3.5, "b": 1}
    assert S.forward_parts("abcd", [None, 0.5, 0.0, 0.2], 0.4) == ["ab", "cd"]
    assert S.merged_grams(["ab", "bc", "cd"], {"bc": 5}, 1) == ["abcd"]


@pytest.mark.parametrize(("names", "leaves"), [(["pig"], 11), (["ding", "dong"], 28)])
def test_freedom_model(spark, names, leaves):
    grams = O.char_grams(spark.createDataFrame([(n,) for n in names], "name string"), "name", 2)
    model = O.freedom_model(grams)
    assert O.leaves(*model) == leaves
    got = [{tuple(r)[:-1]: r["cnt"] for r in t.collect()} for t in model]
    want = [{}, {}, {}]
    for name in names:
        for n in (1, 2):
            for i in range(len(name) - n + 1):
                g = name[i : i + n]
                want[0][(g,)] = want[0].get((g,), 0) + 1
                if i + n < len(name):
                    want[1][g, name[i + n]] = want[1].get((g, name[i + n]), 0) + 1
                if i:
                    want[2][g, name[i - 1]] = want[2].get((g, name[i - 1]), 0) + 1
    assert got == want


def test_gram_freedoms(spark):
    for text, n, want in (("abcd", 1, {"a": (1, 0), "b": (1, 1), "c": (1, 1), "d": (0, 1)}), ("abcde", 2, {"ab": (1, 0), "bc": (1, 1), "cd": (1, 1), "de": (0, 1)})):
        grams = O.char_grams(spark.createDataFrame([(text,)], "name string"), "name", n).where(F.col("n") == n)
        assert {r["gram"]: (r["f_next"], r["f_prev"]) for r in O.gram_freedoms(grams, "name").collect()} == want


def test_counts(spark):
    merged = O.merge(table(spark, {"a": 1}), table(spark, {"a": 1, "b": 20}))
    assert {r["w"]: r["cnt"] for r in merged.collect()} == {"a": 2, "b": 20}
    kept = O.compress(table(spark, {"a": 1000, "b": 100, "c": 10, "d": 1}), 0.01)
    assert {r["w"] for r in kept.collect()} == {"a", "b", "c"}
    diff = O.difference(table(spark, {"a": 1, "b": 2, "c": 3, "d": 1}), table(spark, {"a": 1, "b": 3, "c": 2, "x": 1}))
    assert {r["w"]: r["diff"] for r in diff.collect()} == {"b": -1, "c": 1, "d": 1, "x": -1}
    p = {r["w"]: r["p"] for r in O.witten_bell(table(spark, {"get": 3, "set": 1, "name": 4})).collect()}
    assert all(math.isclose(p[w], x / 11) for w, x in (("get", 3), ("set", 1), ("name", 4)))


def test_camel_words(spark):
    for name, want in (("SmallRing_HTTPServerV2", ["small", "ring", "http", "server", "v", "2"]), ("aBCdEF12gH", ["a", "b", "cd", "ef", "12", "g", "h"]), ("__x-Y__", ["x", "y"]), ("", [])):
        assert one(spark, T.camel_words(F.lit(name), True)) == want


def brute_format(text):
    """Words by the stated alternatives, tried in order at each place."""
    import re

    pattern = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|%\d?\.?\d?s|%\d?\.?\d?d|%\d?\.?\d?f|-\d+|\d+")
    return [x for x in (m.lower() for m in pattern.findall(text)) if not re.match(r"%(\d+(\.\d+)?)?(d|f|s)", x) and len(x) > 1]


def test_format_words(spark):
    random.seed(3)
    texts = ["".join(random.choice(["%", "d", "s", "5", ".", "-", "A", "b", "HTTP", "Err", " ", "_"]) for _ in range(14)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.format_words(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r["w"] == brute_format(r["t"]), r["t"]


def test_text_functions(spark):
    assert one(spark, T.demangled(F.lit("_ZN3foo3barEv"))) == "foo::bar" and one(spark, T.demangled(F.lit("plain"))) == "plain"
    assert one(spark, T.without_brackets(F.lit("a(b(c)d)e)f"), "(", ")")) == "ae)f"
    assert one(spark, T.fixed_decimals(F.lit(0.125), 2)) == "0.12" and one(spark, T.fixed_decimals(F.lit(0), 3)) == "0.000"
    w = one(spark, T.weighted_line(F.lit("word\t9")))
    assert w["word"] == "word" and math.isclose(w["weight"], 1.0)
    assert one(spark, T.weighted_line(F.lit("word")))["weight"] == 1.0 and one(spark, T.weighted_line(F.lit("word;3"), False))["weight"] == 3.0
    assert one(spark, T.without_digits(F.lit([" a ", "12", "٣", "", "b1"]))) == ["a", "b1"]
    assert one(spark, T.blank_stripped(F.lit([" A b", "", "C"]))) == ["a", "b", "c"]
    assert one(spark, T.without_made(F.lit(["sub_1", "", "f"]))) == ["f"] and one(spark, T.kept_segment(F.lit(".text")))
    assert one(spark, T.underscored(F.lit(["a b", "c"]))) == "a_b_c"


def brute_segmentation(text, p, size):
    """All segmentations: the best product, in logs."""
    best = -math.inf
    for cuts in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        parts = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        score = 0.0
        for k, w in enumerate(parts):
            if len(w) > 1 and w in p and (len(w) <= S.LONGEST or k == len(parts) - 1):
                score += math.log(p[w] / size)
            elif len(w) == 1:
                score -= math.log(size)
            else:
                score = -math.inf
        best = max(best, score)
    return best


@given(st.text("abc", max_size=11), st.dictionaries(st.text("abc", min_size=1, max_size=11), st.floats(0.01, 1), max_size=8))
def test_unigram_segmentation_is_best(text, p):
    parts = S.best_segmentation(text, p, size=9)
    assert "".join(parts) == text and all(len(x) == 1 or x in p for x in parts)
    if text:
        score = sum(math.log(p[w] / 9) if len(w) > 1 else -math.log(9) for w in parts)
        assert math.isclose(score, brute_segmentation(text, p, 9), abs_tol=1e-9)


def test_standard_segmentation_is_best():
    p = {"ab": 0.2, "a": 0.5, "b": 0.1, "abc": 0.001, "c": 0.3}
    parts = S.best_segmentation("abcab", p, mode="standard")
    assert math.isclose(math.prod(p[x] for x in parts), 0.2 * 0.3 * 0.2)


@given(st.text("abc", max_size=30), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.floats(0.01, 1), max_size=8))
def test_splitters_tile_the_text(text, p):
    parts = S.best_segmentation(text, p)
    assert "".join(parts) == text
    assert "".join(S.greedy_lexicon(text, S.by_letter(p))) == text
    spans = S.boundary_spans([1.0 if c == "a" else 0.0 for c in text], [None] * len(text), 0.5)
    assert "".join(text[a : b + 1] for a, b in spans) == text
    rules = S.rule_spans(text, A.Lexicon(frozenset(p)))
    assert "".join(S.vote(text, S.spans_of(parts), rules, spans, shared_ends=False)) == text
    assert sorted("".join(S.subtracted(text, list(p)))) == sorted(text)


@given(st.text("abcd", min_size=1, max_size=9), st.sets(st.text("abcd", min_size=2, max_size=4), max_size=6))
def test_best_cut_is_best(text, words):
    parts = {w for w in words if w in text}
    best = 0
    for k in range(len(parts) + 1):
        for some in itertools.combinations(parts, k):
            spans = sorted((text.index(w), text.index(w) + len(w)) for w in some)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                best = max(best, sum(len(w) ** 2 for w in some))
    assert sum(len(w) ** 2 for w in S.best_cut(text, parts)) == best


def test_rules():
    lexicon = A.Lexicon(frozenset({"get", "language", "specific", "data", "string", "compare"}), {"str": ("string",), "cmp": ("compare",)}, ("before",), {"strcmp": "str cmp"})
    assert S.known_parts("getlanguagespecificdata", lexicon) == ["get", "language", "specific", "data"]
    assert S.known_parts("beforegetxx", lexicon) == ["before", "get"]
    assert S.subtracted("awdddwordkjh", ["word"]) == ["word", "awddd", "kjh"]
    assert S.canonical_words("strcmp 12 get", lexicon) == {"str", "cmp", "get"}
    assert S.rule_spans("strcmp", lexicon) == [(0, 2), (3, 5)] and S.rule_spans("xxgetyy", lexicon) == [(0, 1), (2, 4), (5, 6)]
    assert S.uncontained({"a": [(0, 1), (4, 5)], "ab": [(0, 2)]}) == {"a": [(4, 5)], "ab": [(0, 2)]}
    assert S.vote("getname", [(0, 2), (3, 6)], [(0, 2), (3, 6)], [(0, 6)]) == ["get", "name"]
    assert S.vote("abcdef", [(0, 2), (3, 5)], [(0, 2), (2, 5)], [(0, 5)]) == ["abc", "cdef"]


def profile_brute(text, after, before, words, t):
    """Boundaries by arrays with missing values, as tables of differences would have them."""
    n = len(text)
    total = {"f": [0.0] * n, "b": [0.0] * n}
    for k in (1, 2, 3, 4, 5):
        rise = [after.get(text[max(0, i - k + 1) : i + 1], 0) for i in range(n)]
        fall = [before.get(text[i : i + k], 0) for i in range(n)]
        at = 0
        for w in words:
            for i in (at, at + len(w) - 1):
                rise[i] *= 2
                fall[i] *= 2
            at += len(w)
        up = [math.nan] + [rise[i] - rise[i - 1] for i in range(1, n)]
        down = [fall[i] - fall[i + 1] for i in range(n - 1)] + [math.nan]
        for i in range(n):
            total["f"][i] += up[i] - (up[i + 1] if i + 1 < n else math.nan)
            total["b"][i] += down[i] - (down[i - 1] if i else math.nan)
    out = {}
    for key, x in total.items():
        top = max((v for v in x if v == v), default=math.nan)
        out[key] = [v / top if top else (math.nan if v == 0 or v != v else math.copysign(math.inf, v)) for v in x]
    spans, start = [], 0
    for i in range(n):
        a, b = i + 1 < n and out["b"][i + 1] >= t, out["f"][i] >= t
        if a or b:
            if a and b and spans:
                spans[-1] = (spans[-1][0], i)
            else:
                spans.append((start, i))
            start = i + 1
    return spans + ([(start, n - 1)] if start < n else [])


@given(st.text("abc", min_size=1, max_size=12), st.randoms())
def test_freedom_spans(text, rnd):
    grams = {text[i:j] for i in range(len(text)) for j in range(i + 1, min(len(text), i + 5) + 1)}
    after, before = ({g: rnd.randint(0, 4) for g in sorted(grams)} for _ in range(2))
    words = S.greedy_lexicon(text, S.by_letter({"ab": 2.0, "c": 3.0}))
    assert S.freedom_spans(text, after, before, words) == profile_brute(text, after, before, words, 0.1)


def test_alignment():
    assert aligned("abc", "abc") == (0, 3) and aligned("abc", "xyz") == (3, 3)
    a, b = aligned("getname", "get_name")
    assert b - a >= 7
    assert aligned("ABC", "xabcx") == (1, 4)


def test_truncation_is_one_by_one(spark):
    rows = [(a, b, r) for a in range(9) for b in range(9) for r in range(a + b + 1)]
    x, y = E.truncated(F.col("a"), F.col("b"), F.col("a") + F.col("b") - F.col("r"))
    for r in spark.createDataFrame(rows, "a int, b int, r int").select("*", x.alias("x"), y.alias("y")).collect():
        a, b = r["a"], r["b"]
        for _ in range(r["r"]):
            a, b = (a - 1, b) if a > b else (a, b - 1)
        assert (a, b) == (r["x"], r["y"])


def test_strategies():
    assert E.strategy(True, True, 8) == E.Strategy("longest", "longest_first", 8)
    assert E.strategy("max_length", None, None, longest=512) == E.Strategy("max_length", "do_not_truncate", 512)
    assert E.strategy("max_length", True) == E.Strategy("do_not_pad", "do_not_truncate", None)
    for bad in ({"padding": "most"}, {"truncation": "some"}, {"padding": True, "truncation": True, "max_length": 9, "multiple": 4}):
        with pytest.raises(ValueError):
            E.strategy(**bad)
    a = F.array(F.lit(7).cast("long"))
    with pytest.raises(ValueError):
        E.prepare(a, a, E.strategy(False, True, 8), overflow=True)
    with pytest.raises(ValueError):
        E.prepare(a, None, E.strategy(), specials=False)


def test_prepared_sequences(spark):
    ids = lambda n: F.sequence(F.lit(10).cast("long"), F.lit(9 + n).cast("long"))
    e = one(spark, E.prepare(ids(4), ids(3), E.strategy("max_length", True, 12)))
    assert e["input_ids"] == [3, 10, 11, 12, 13, 2, 10, 11, 12, 2, 0, 0] and e["token_type_ids"] == [0] * 6 + [1] * 4 + [0, 0]
    assert e["attention_mask"] == [1] * 10 + [0, 0] and e["special_tokens_mask"] == [1, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 1] and e["num_truncated_tokens"] == -2
    e = one(spark, E.prepare(ids(6), None, E.strategy(False, "only_first", 5), stride=1))
    assert e["input_ids"] == [3, 10, 11, 12, 2] and e["overflowing_tokens"] == [12, 13, 14, 15] and e["length"] == 5
    e = one(spark, E.prepare(ids(2), None, E.strategy("max_length", None, 6), pad_side="left"))
    assert e["input_ids"] == [0, 0, 3, 10, 11, 2]
    assert one(spark, E.causal_mask(F.lit(3))) == [[0, 1, 1], [0, 0, 1], [0, 0, 0]] and one(spark, E.pad_mask(F.lit([0, 5]))) == [1, 0]
