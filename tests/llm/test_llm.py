"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import dac, fingerprint, lm, mixing, packing, pipeline, quality, queries, sharding, simhash, substrings, toxicity
from quern.llm.common import Encoder
from quern.llm.components import connected

SF = "/root/testdata/sf0.001"
ALL = queries.queries()
CLASH = "doc_id long, text string, source string, key long, n long, word string, spans string, fp long, part int, size long, n_words string, copies int, s string, b int, row string, rid long"


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty, blank, equal, repeated, unusual and very long texts."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "a b", "x y z " * 40, "x y z " * 40, long, long + " end", "é ü  ñ x <|endoftext|> \x00 z", "A\nA\n\nB\nA", "word " * 3000]
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(3, "one", "s0"), (3, "one", "s0"), (None, "no id " * 20, None), (None, None, None), (2**62, "last", "s1"), (-5, "first word", "s2")]
    return spark.createDataFrame([(*r, *[None] * 13) for r in rows], CLASH)


@pytest.fixture(scope="module")
def some_labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 1), (7, 1, 0), (7, 1, 0), (8, None, None), (None, 1, 1), (11, 0, 1)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", [n for n in ALL if not n.startswith(("op10", "pipeline"))])
def test_edge_rows(name, spark, edge, some_labels, tmp_path):
    for part, n in ((edge, edge.count()), (edge.limit(0), 0)):
        part.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        some_labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        out = rows_of(ALL[name](spark, str(tmp_path)))
        assert len(out) == n
        if n:
            assert Counter(r["doc_id"] for r in out)[3] == 3


def test_encoder_equals_whole_texts(docs):
    e = Encoder.get()
    texts = [*texts_of(docs).values(), "", " ", "a  b", "a   b", "a \n b", "x\n\n\ny", "a.\nb, c", "b.\na\n11 \n \t\t1", None, "a\x00 b", " a", "a ", "\na", "'s it's  ", "<|endoftext|> x<|endoftext|>"]
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def jaccard(a, b):
    x, y = Counter(split(a)), Counter(split(b))
    return sum(min(x[w], y[w]) * len(w) for w in x | y) / max(1, sum(max(x[w], y[w]) * len(w) for w in x | y))


def test_fingerprint_is_generalised_jaccard(docs):
    t = texts_of(docs)
    ids = sorted(t)
    out = {r["doc_id"]: r for r in rows_of(fingerprint.query(docs))}
    assert sorted(out) == ids
    near, following = [], []
    for i, d in enumerate(ids):
        a, b = t[d] or "", t[ids[(i + 1) % len(ids)]] or ""
        k = len(a) // 4
        edited = a[: len(a) - k] + b[:k]
        r = out[d]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        near.append(r["near_edited"] - jaccard(a, edited))
        following.append(r["near_next"] - jaccard(a, b))
    for error in (near, following):
        assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.08
    by_text = defaultdict(set)
    for d in ids:
        by_text[t[d]].add(out[d]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    # different texts may share one only if they are nearly alike
    shared = defaultdict(list)
    for text, v in by_text.items():
        shared[v.pop()].append(text)
    assert all(jaccard(v[0], x) > 0.9 for v in shared.values() for x in v[1:]) and len(shared) > 0.95 * len(by_text)


@pytest.mark.parametrize(("terms", "n"), [(100, 900), (1000, 900), (10_000, 400)])
def test_fingerprint_has_no_bias_by_length(spark, terms, n):
    """Texts with counts of one to five, each half of it the half of the text before; near_edited and near_next against
    their true values, over 64 samples of each."""
    rng = np.random.default_rng(terms)
    halves = [" ".join(" ".join([f"w{k}x{i}"] * int(c)) for i, c in enumerate(rng.integers(1, 6, terms // 2))) for k in range(n)]
    rows = [(k, f"{halves[k]} {halves[(k + 1) % n]}") for k in range(n)]
    out = {r["doc_id"]: r for r in rows_of(fingerprint.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))}
    errors = [[], []]
    for k, t in rows:
        after = rows[(k + 1) % n][1]
        cut = len(t) // 4
        errors[0].append(out[k]["near_edited"] - jaccard(t, t[: len(t) - cut] + after[:cut]))
        errors[1].append(out[k]["near_next"] - jaccard(t, after))
    for e in errors:  # within 0.005, or three deviations of the mean where the texts are few
        assert abs(np.mean(e)) < max(0.005, 3 * np.std(e) / np.sqrt(n)), (np.mean(e), np.std(e))


def brute_simhash(texts):
    fp = {}
    for d, t in texts.items():
        w = [x for x in split((t or "").translate({c: c + 32 for c in range(65, 91)}))]
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp[d] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    up = {d: d for d in fp}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (f"{fp[d]:016x}", top(d)) for d in ids}


def test_simhash_equals_all_pairs(docs):
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(simhash.query(docs))}
    assert out == brute_simhash(texts_of(docs))


@pytest.mark.parametrize("chunk", [7, 4096])
def test_trie_links_near_fingerprints_with_hot_blocks(spark, chunk):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 6, np.uint64)]
    fps = {b ^ sum(1 << int(k) for k in rng.integers(0, 64, n)) for b in base for n in range(6) for _ in range(12)}
    fps = sorted(fps | {int(x) for x in rng.integers(0, 2**63, 60, np.uint64)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    got = {r["node"]: r["component"] for r in rows_of(connected(simhash.links(reps, chunk=chunk)))}
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert got == {i: u for i, u in enumerate(up) if u != i}


def test_trie_visits_few_pairs_and_finds_all():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 2**63, 3000, np.uint64)
    keys = np.unique(np.concatenate([keys, *(keys[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(3))]))
    for budget in (0, 1, 3):
        visits = []
        got = {(int(i), int(j)) for x, y in simhash.trie_join(keys, np.array([0]), np.array([len(keys)]), 0, budget, visits=visits) for i, j in zip(x, y, strict=True)}
        near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
        assert sum(visits) < len(keys) ** 2 / 8 and len(visits) > 10


def brute_substrings(rows):
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    out = []
    for d, w in rows:
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings_equal_all_windows(spark, docs, edge):
    for df in (docs, edge.where("doc_id <> 11")):
        rows = [(r["doc_id"], split(r["text"])) for r in df.select("doc_id", "text").collect()]
        out = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in rows_of(substrings.query(df))), key=str)
        assert out == brute_substrings(rows)


def test_substrings_with_frequent_passages(spark, monkeypatch):
    """Salted joins: frequent anchors, reaches and windows in many documents that differ around them."""
    monkeypatch.setattr(substrings.hot_keys, "__defaults__", ("n", 5))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"{' '.join(f'a{k}x{i}' for i in range(k % 23))} {passage} {' '.join(f'b{k % 7}x{i}' for i in range(50))}") for k in range(90)]
    rows += [(100 + k, passage) for k in range(40)]
    out = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in rows_of(substrings.query(spark.createDataFrame(rows, "doc_id long, text string")))), key=str)
    assert out == brute_substrings([(d, split(t)) for d, t in rows])


def test_cleaned_keeps_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "a", 7, [1], 3), (2, f"x {text}", "b", 8, None, 4), (3, None, None, None, None, None), (4, "short", "c", 9, [2], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, salt int, spans array<int>, n_chars long")
    out = {r["doc_id"]: r for r in rows_of(substrings.cleaned(df))}
    assert [out[d]["text"] for d in (1, 2, 3, 4)] == ["", "x", None, "short"] and [out[d]["n_chars"] for d in (1, 2, 3, 4)] == [0, 1, None, 5]
    assert [(out[d]["key"], out[d]["salt"], out[d]["spans"]) for d in (1, 2, 3, 4)] == [(r[2], r[3], r[4]) for r in rows]


def test_substrings_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.OP3_SQL).fetchall())
    assert want == sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in rows_of(ALL["op3_substring_dedup"](spark, SF)))


def brute_quality(text):
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*base, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_base_and_verdict(spark, docs, edge):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (docs, edge):
        texts = Counter((r["doc_id"], *brute_quality(r["text"])) for r in df.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], *(r[c] for c in names)) for r in rows_of(quality.query(df, labels))) == texts
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality.fit(quality.measured(big), labels)
    assert rules and all(len(r) <= quality.MAX_CONDITIONS for r in rules)
    stats = quality.measured(big)
    cols = [f"f_{f}" for f in quality.FEATURES]
    rows = stats.select("doc_id", "base_failed", quality.verdict(rules).alias("v"), *cols).collect()
    for r in rows:
        x = {f: np.array([r[f"f_{f}"]]) for f in quality.FEATURES}
        assert r["v"] == (not any(quality._covers(rule, x, 1)[0] for rule in rules))
    kept = {r["doc_id"] for r in rows if not r["base_failed"] and r["v"]}
    assert {r["doc_id"] for r in quality.keep(big, labels).select("doc_id").collect()} == kept
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(good[r["doc_id"]], r["v"]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([v for q, v in judged if q == 1]) > 0.98
    assert not any(quality.learn({"a": np.ones(9)}, np.zeros(9, bool), np.arange(9)))


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        rest = total - sum(full.values())
        w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > most * sizes[s]]
        if not over:
            return {**full, **{s: rest * weight[s] / w for s in left}}
        full.update((s, most * sizes[s]) for s in over)


def test_mixing_meets_targets(docs, edge):
    for df in (docs, edge):
        source = Counter()
        for r in df.select("source", "text").collect():
            source[r["source"]] += len(split(r["text"]))
        want = brute_targets(source)
        out = rows_of(mixing.query(df))
        again = rows_of(mixing.query(df))
        pick = lambda rows: Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)
        assert pick(out) == pick(again)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
        assert Counter(round(r["target"], 6) for r in out) == Counter(round(want[r["source"]], 6) for r in df.select("source").collect())
        assert abs(sum(r["taken"] for r in out) - sum(want.values())) <= len(want)
        places = [r["position"] for r in out if r["position"] is not None]
        assert places == sorted(places) and all(0 <= p <= 1 for p in places)


def test_mixing_schedule_is_inverted(spark):
    q = spark.range(101).select((F.col("id") / 100).alias("q"))
    for drift in (-0.9, -0.5, 0.0, 0.5, 0.9):
        for r in q.select("q", mixing.due(F.col("q"), F.lit(drift)).alias("t")).collect():
            assert abs(r["t"] + drift * (r["t"] ** 2 - r["t"]) - r["q"]) < 1e-12


def test_training_order_rows(docs, edge):
    for df in (docs, edge):
        out = rows_of(mixing.training_order(df))
        assert list(out[0]) == df.columns
        taken = sum(r["taken"] for r in rows_of(mixing.query(df)))
        assert sum(len(split(r["text"])) for r in out) == taken


def published_jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_function(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 400, 7), *(k * 0x9E3779B97F4A7C1 for k in range(9))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 100):
        assert [r["j"] for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("j")).collect()] == [published_jump(k, n) for k in keys]


def test_sharding_slots_and_growth(docs, edge, tmp_path):
    for df in (docs, edge):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.select("doc_id", "text").collect())
        out = rows_of(sharding.query(df))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sharding.write(docs, f"{tmp_path}/shards", 4)
    back = docs.sparkSession.read.parquet(f"{tmp_path}/shards")
    assert back.count() == docs.count() and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(4))


def test_token_output_round_trip(docs, edge, tmp_path):
    e = Encoder.get()
    for df in (docs, edge):
        rows = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        want, at = [], 0
        for d, t in rows:
            ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        written = dac.write(df, segment_ids=20_000)
        out = rows_of(dac.read(written))
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter(want)
        out.sort(key=lambda r: r["start"])
        assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]
        assert [r["doc_id"] for r in out] == [d for d, *_ in want]
        paths = dac.export(written, str(tmp_path))
        assert sum(dac.Image(open(p, "rb").read()).n for p in paths) == at
        ends = [dac.Image(open(p, "rb").read()).document(0)[-1] for p in paths]
        assert set(ends) <= {2}
        for p in paths:
            os.remove(p)


def test_codes_are_directly_addressable():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rng.integers(0, 50257, 5000).astype(np.uint32), np.full(700, 300, np.uint32)):
        image = dac.Image(dac.pack(ids, np.array([4]), np.array([len(ids)])))
        assert (image.slice(0, len(ids)) == ids).all() and [image[i] for i in range(len(ids))] == ids.tolist() and image.document(0).tolist() == ids.tolist()
        for x, y in rng.integers(0, len(ids) + 1, (20, 2)):
            assert image.slice(int(x), int(y)).tolist() == ids[x:y].tolist()
        with pytest.raises(IndexError):
            image[len(ids)]


class Touched:
    """Bytes that tell how many of them were asked for."""

    def __init__(self, data):
        self.data, self.n = data, 0

    def __getitem__(self, s):
        self.n += s.stop - s.start
        return self.data[s]


def test_a_document_is_read_by_its_chunks_and_ranks_alone(tmp_path):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 900, 2000)
    ids = rng.integers(0, 50257, lengths.sum()).astype(np.uint32)
    data = dac.pack(ids, np.arange(2000) * 3, lengths)
    touched = Touched(data)
    image = dac.Image(touched)
    start = np.concatenate([[0], np.cumsum(lengths)])
    for k in (0, 1, 777, 1999):
        touched.n = 0
        assert image.find(3 * k) == k and image.find(3 * k + 1) is None
        assert (image.document(k) == ids[start[k] : start[k + 1]]).all()
        # chunks of two levels and their bits, a part of a block of bits and an entry for each rank, and ids on the way
        assert touched.n < 3 * lengths[k] + 2 * (dac.BLOCK // 8 + 4) + 8 * 40 < len(data) / 100
    (tmp_path / "x.dac").write_bytes(data)
    import mmap

    with open(tmp_path / "x.dac", "rb") as f:
        mapped = dac.Image(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        assert (mapped.document(55) == ids[start[55] : start[56]]).all()


def brute_lm(rows, model, pieces, discount):
    """Scores of a model, one word and one id at a time, with plain counts."""
    train = [w for d, w in rows if not lm.held_out(d)]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    context, pair = defaultdict(Counter), Counter()
    for t in train:
        for a, b, w in zip([None, None, *t], [None, *t], t, strict=False):
            context[a, b][w] += 1
    pair = Counter(c for x in context.values() for c in x.values())
    assert discount == (pair[1] / (pair[1] + 2 * pair[2]) if pair[1] and pair[2] else 0.5)
    out = []
    for d, t in rows:
        ids = [pieces.of([w])[0].tolist() for w in t]
        seq = [x for i in ids for x in i]
        dist = []  # of every place, the probabilities of all classes
        for p in range(len(seq)):
            k = max(0, -(-(p - lm.WINDOW + 1) // lm.STRIDE)) * lm.STRIDE
            inputs = [len(model.cls) if q == 0 else seq[q - 1] for q in range(k, p + 1)]
            c_in = np.append(model.cls, len(model.w["class"]) - 1)
            x = np.stack([model.w["id"][i] + model.w["class"][c_in[i]] + model.w["place"][q] for q, i in enumerate(inputs)]).astype(float)
            q, key, value = np.split(x @ model.w["qkv"], 3, axis=1)
            a = q[-1] @ key.T / np.sqrt(lm.DIM)
            a = np.exp(a - a.max())
            h = x[-1] + (a / a.sum()) @ value @ model.w["mix"]
            z = h @ model.w["out"] + model.w["bias"]
            z = np.exp(z - z.max())
            dist.append((1 - lm.PRIOR) * z / z.sum() + lm.PRIOR * model.prior)
        p, score = 0, 0.0
        for j, w in enumerate(t):
            a, b = (t[j - 2] if j > 1 else None), (t[j - 1] if j else None)
            word = 0.0  # a logarithm, as long words have next to no probability
            for i in ids[j]:
                z = dist[p] / (dist[p][: model.n_first].sum() if model.first[i] else 1)
                word += np.log(z[model.cls[i]]) + model.share[i]
                p += 1
            if p < len(seq):
                word += np.log(dist[p][: model.n_first].sum())
            c = context[a, b]
            total = sum(c.values())
            seen = np.log((c[w] - discount) / total) if c[w] else -np.inf
            score += (np.logaddexp(seen, np.log(discount * len(c) / total) + word) if total else word) / np.log(10)
        base = sum(np.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        out.append((d, lm.held_out(d), len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


def lm_words(text):
    return [*split((text or "").translate({c: c + 32 for c in range(65, 91)})), lm.END]


def test_lm_equals_one_id_at_a_time(spark, docs, edge, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 60)
    monkeypatch.setattr(lm, "BATCH_BYTES", 20_000)
    pieces = lm.Pieces("byte_bpe_50k.json")
    for df in (docs.limit(60).unionByName(docs.limit(5)), edge.where("doc_id IS NULL OR doc_id < 7")):
        coded = lm.code(df)
        model = lm.fit(coded)
        _, words, discount = lm.counted(coded, 500)
        rows = [(r["doc_id"], lm_words(r["text"])) for r in df.select("doc_id", "text").collect()]
        want = sorted(brute_lm(rows, model, pieces, discount), key=str)
        assert words == len({w for d, t in rows if not lm.held_out(d) for w in t})
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        for keys in (lm.KEYS, 500):
            got = sorted((tuple(r[c] for c in names) for r in rows_of(lm.scored(coded, model, keys))), key=str)
            assert [g[:5] for g in got] == [w[:5] for w in want]
            assert np.allclose([g[5] for g in got], [w[5] for w in want]) and np.allclose([g[6] for g in got], [w[6] for w in want], rtol=2e-4, atol=2e-3)


def test_lm_base_counts_and_gain(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, edge):
        rows = [(r["doc_id"], lm_words(r["text"])) for r in df.select("doc_id", "text").collect()]
        c = Counter(w for d, t in rows if not lm.held_out(d) for w in t)
        n, v = sum(c.values()), len(c)
        out = rows_of(lm.query(df))
        want = Counter((d, lm.held_out(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for d, t in rows)
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    held = [r for r in rows_of(lm.query(docs)) if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    pieces = lm.Pieces("byte_bpe_50k.json")
    texts = [" ".join(["the dog" if k % 2 else "the cat", "ranzibule of"] * int(rng.integers(1, 30))) for k in range(40)]
    coded = lm.Coded.of(pa.array(texts), np.zeros(40, bool), pieces)
    seq, n = coded.sequence()
    windows = coded.windows(5)
    assert len(windows) == sum(-(-n // lm.SPAN))
    windows[windows == -2] = pieces.size
    counts = np.bincount(seq, minlength=pieces.size).astype(float)
    model = lm.started(windows, lm._company(windows[:, 1:], counts), counts, pieces.begins(), steps=40)
    # over all ids, known or not, after a few beginnings: those that start words, and those that go on with an ended word
    for words in ([], ["the"], ["the", "unheardofword", "zzzq"]):
        before = pieces.of(words)[0] if words else np.zeros(0, np.int32)
        ids = np.flatnonzero(model.first) if not words else np.arange(pieces.size)
        part = np.concatenate([np.concatenate([before, [i]]) for i in ids[::97]])
        out, ended = model.factors(part.astype(np.int32), np.full(len(ids[::97]), len(before) + 1))
        by_class = np.zeros(len(np.unique(model.cls)))
        last = np.cumsum(np.full(len(ids[::97]), len(before) + 1)) - 1
        for i, x, e in zip(ids[::97], out[last], ended[last], strict=True):
            by_class[model.cls[i]] = np.exp(x + e - model.share[i])
        seen = np.unique(model.cls[ids[::97]])
        assert abs(by_class[seen].sum() - 1) < 0.02 or len(seen) < len(np.unique(model.cls[ids]))
    assert np.allclose(np.bincount(model.cls, np.exp(model.share.astype(float))), 1, atol=1e-3)
    # of words after a known context, seen ones and the weight that is left
    p = lm.mixed(np.log(np.array([0.2, 0.3, 0.1])), np.array([3, 1, 0]), np.array([4, 4, 4]), np.array([2, 2, 2]), 0.7)
    assert np.allclose(np.exp(p), [2.3 / 4 + 0.35 * 0.2, 0.3 / 4 + 0.35 * 0.3, 0.35 * 0.1]) and abs(2.3 / 4 + 0.3 / 4 + 0.35 - 1) < 1e-12
    # documents in a row are scored apart, and a word's score does not depend on what follows it
    word = model.words(seq, n)
    one = model.words(seq[: n[0]], n[:1])
    assert np.allclose(word[: len(one)], one, atol=1e-3) and len(word) == len(coded.at)


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    out = rows_of(toxicity.query(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")))
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(y[r["doc_id"]], r["score"], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in held)
    pos, neg = [s for t, s, _ in held if t], [s for t, s, _ in held if not t]
    assert np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]) > 0.85
    assert np.mean([p for t, _, p in held if not t]) < 0.03
    assert np.mean([p for t, _, p in held if t]) > 0.6


def test_toxicity_one_class_only():
    assert toxicity.learn([]).score("a b") < 0.01 and toxicity.learn([(1, "a", 1)]).score("b") > 0.99


def brute_kneser_ney(docs, words, shared, d1, d2, w, before):
    """P(w | before) of one class, from its documents; None stands for the place before a text and for unknown words."""
    pairs = Counter(p for t in docs for p in set(zip([None, *t], t, strict=False)))
    own = Counter(b for _, b in pairs)
    total = sum(own.values())
    kept = {x: max(own[x] - d1, 0) for x in words}
    low = max(own[w] - d1, 0) / total + (1 - sum(kept.values()) / total) * shared(w)
    after = {b: n for (a, b), n in pairs.items() if a == before}
    n = sum(after.values())
    return low if not n else max(after.get(w, 0) - d2, 0) / n + sum(min(x, d2) for x in after.values()) / n * low


@pytest.mark.parametrize("discount", [None, 1.5])
def test_toxicity_equals_plain_kneser_ney(discount):
    rng = np.random.default_rng(6)
    word = [f"w{i}".encode() for i in range(30)]
    toxic, ordinary = ([[word[int(k)] for k in rng.zipf(1.4, int(rng.integers(3, 40))) % 30] for _ in range(n)] for n in (15, 25))
    tally = toxicity.Tally.of(toxic, ordinary)
    model = tally.model(discount)
    words = sorted({w for d in (*toxic, *ordinary) for w in d})
    kinds = []
    for docs, times in zip((toxic, ordinary), tally.times, strict=True):
        pairs = Counter(p for t in docs for p in set(zip([None, *t], t, strict=False)))
        assert sorted(pairs.values()) == sorted(times)  # no two documents here are copies
        kinds.append(Counter(b for _, b in pairs))
    total = sum(sum(k.values()) for k in kinds)
    shared = lambda w: (kinds[0][w] + kinds[1][w] + 1) / (total + len(words) + 1)
    estimate = lambda x: (lambda c: c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5)(Counter(int(v) for v in x))
    text = [word[3], word[1], word[2], b"unknown", word[2], word[29], word[1]]
    want = []
    for before, w in zip([None, *text], text, strict=False):
        p = []
        for docs, k, times in zip((toxic, ordinary), kinds, tally.times, strict=True):
            d1, d2 = (estimate(k.values()), estimate(times)) if discount is None else (discount, discount)
            p.append(brute_kneser_ney(docs, words, shared, d1, d2, w, before if before in words else None))
        want.append(np.log(p[0] / p[1]))
    assert np.allclose(model.ratios(text), want)
    mean, passage = model.features(text)
    assert np.isclose(mean, np.mean(want)) and np.isclose(passage, sum(want) / toxicity.PASSAGE)
    # each class's probabilities sum to one, over the words and all unknown ones as one
    for docs, k, times in zip((toxic, ordinary), kinds, tally.times, strict=True):
        d1, d2 = estimate(k.values()), estimate(times)
        for before in (word[1], word[29], None):
            assert np.isclose(sum(brute_kneser_ney(docs, words, shared, d1, d2, w, before) for w in [*words, b"unknown"]), 1)


def checked_packing(out, rows, capacity):
    e = Encoder.get()
    want = Counter()
    for d, t in rows:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            want[d, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), -(-sum(r["length"] for r in out) // capacity)


def test_packing_is_gapless_and_tight(spark, docs, edge):
    for path, df in (("/root/testdata/sf0.01", None), (None, edge)):
        df = df if df is not None else spark.read.parquet(f"{path}/documents.parquet")
        out = rows_of(packing.query(df))
        n, least = checked_packing(out, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], packing.CAPACITY)
        assert n <= least * 1.01 + 1
    assert rows_of(packing.query(edge.limit(0))) == []


def test_packing_plan_on_hot_lengths():
    rng = np.random.default_rng(2)
    for h in ({700: 9000, 648: 2, 2048: 5}, {1025: 50}, {1: 5000}, {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 500, 300), strict=True)}):
        rows = packing.plan(h)
        used = defaultdict(list)
        room = Counter()
        for length, r0, r1, seq0, offset in rows:
            used[length].append((r0, r1))
            for k in range(r1 - r0):
                room[seq0 + k] += length
        for length, runs in used.items():
            assert [x for r in sorted(runs) for x in r] == [x for a, b in zip([0, *np.cumsum([b - a for a, b in sorted(runs)])[:-1]], [b for _, b in sorted(runs)], strict=True) for x in (a, b)]
            assert sum(b - a for a, b in runs) == h[length]
        assert max(room.values()) <= 2048


def test_nnls_is_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), np.maximum(rng.standard_normal(12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = rng.standard_normal(30)
    got = packing.nnls(a, b)
    g = a.T @ (b - a @ got)
    assert (got >= 0).all() and (g < 1e-6).all() and abs(g @ got) < 1e-6


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (3, 2), (2, 3)]
    got = {r["node"]: r["component"] for r in rows_of(connected(spark.createDataFrame(links, "a long, b long")))}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 1000 for k in range(1001, 1200)}}
    assert rows_of(connected(spark.createDataFrame([], "a long, b long"))) == []


def shingles(text, width=5):
    w = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(texts, similarity=0.8):
    """Of each document, the smallest one that it reaches over pairs of at least this Jaccard similarity."""
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s or {None}:
            holders[x].add(d)
    up = {d: d for d in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for e in {e for x in s or {None} for e in holders[x] if e < d}:
            both = len(s & sets[e])
            if both >= similarity * (len(s) + len(sets[e]) - both):
                x, y = top(d), top(e)
                up[max(x, y)] = min(x, y)
    return {d: top(d) for d in texts}


def test_near_dedup_is_by_shingles(spark, docs):
    for df in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        texts = texts_of(df)
        want = brute_groups(texts)
        got = {r["doc_id"]: r["component"] for r in rows_of(simhash.groups(df.select("doc_id", "text")))}
        gone = {d for d, c in want.items() if c != d}
        assert set(got) <= gone and len(got) >= 0.98 * len(gone)
        assert {d for d in gone if texts[d] == texts[want[d]]} <= set(got)


def test_pipeline_stages_equal_plain_versions(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"] for r in rows_of(quality.query(docs, labels)) if r["kept"]}
    one = pipeline.quality_rules(spark, docs, sf).cache()
    assert one.columns == columns and {r["doc_id"] for r in one.select("doc_id").collect()} == kept
    two = pipeline.near_dedup(spark, one, sf).cache()
    groups = brute_groups(texts_of(one))
    stay = {r["doc_id"] for r in two.select("doc_id").collect()}
    assert two.columns == columns and {d for d, c in groups.items() if c == d} <= stay
    assert len(stay) <= sum(c == d for d, c in groups.items()) + 0.02 * sum(c != d for d, c in groups.items())
    three = pipeline.substring_dedup(spark, two, sf).cache()
    before = [(d, split(t)) for d, t in texts_of(two).items()]
    want = {d: (gone, sha) for d, _, gone, sha in brute_substrings(before)}
    after = {r["doc_id"]: r for r in rows_of(three)}
    assert three.columns == columns and len(after) == len(want)
    for d, t in texts_of(two).items():
        text = after[d]["text"]
        assert after[d]["n_chars"] == len(text)
        assert text == t if not want[d][0] else hashlib.sha256(text.encode()).hexdigest() == want[d][1]
    four = pipeline.materialise(pipeline.source_mixing(spark, three, sf), "mixed")
    taken = Counter()
    for r in rows_of(four):
        taken[r["doc_id"]] += len(split(r["text"]))
    assert four.columns == columns and taken == Counter({r["doc_id"]: r["taken"] for r in rows_of(mixing.query(three)) if r["taken"]})
    five = rows_of(pipeline.best_fit_packing(spark, four, sf))
    n, least = checked_packing(five, [(r["doc_id"], r["text"]) for r in rows_of(four)], packing.CAPACITY)
    assert n <= least * 1.01 + pipeline.TIMES
    # sequences keep the order of the mix: each time's come after those of the times before
    spans = defaultdict(list)
    for r in five:
        spans[r["time"]].append(r["sequence_id"])
    assert sorted(spans) == list(range(pipeline.TIMES))
    assert all(max(spans[k]) < min(spans[k + 1]) for k in range(pipeline.TIMES - 1))
    first = {}
    for r in rows_of(mixing.query(three)):
        first[r["doc_id"]] = r["position"]
    early = [first[r["doc_id"]] for r in five if r["time"] == 0]
    assert np.quantile(early, 0.95) < 0.2
    run = rows_of(pipeline.run(spark, sf))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in five)
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_pipeline_stages_on_edge_rows(spark, edge, some_labels, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, and columns named like inner ones."""
    more = " ".join(f"q{i * 31 % 211}" for i in range(400))
    extra = spark.createDataFrame([(200 + i, f"{more} tail{i % 3}", "s1", *[None] * 13) for i in range(6)], CLASH)
    some_labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    for table in (edge.unionByName(extra), edge.limit(0)):
        table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for k, (name, stage) in enumerate(pipeline.STAGES):
            n = docs.count()
            out = pipeline.materialise(stage(spark, docs, str(tmp_path)), f"stage{k}")
            if k < 4:
                assert out.columns == table.columns
                if k == 0:
                    assert out.where("text IS NULL OR length(text) < 50").count() == 0
                if k == 1 and n:
                    assert out.where("doc_id BETWEEN 200 AND 210").count() == 1
                if k == 2:
                    assert out.count() == n
                docs = out
            else:
                assert out.count() >= n
                assert (n == 0) == (out.count() == 0)
        # each stage alone, on the rows as they are
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        n = docs.count()
        assert pipeline.near_dedup(spark, docs, "").where("doc_id IS NULL").count() == (2 if n else 0)
        assert pipeline.substring_dedup(spark, docs, "").count() == n
        pieces = pipeline.best_fit_packing(spark, docs, "")
        assert pieces.where("piece = 0").count() == n


def test_shared_folder_is_asked_for_on_a_cluster():
    from quern.llm import common

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())


def test_batches_are_bounded_in_bytes():
    from quern.llm.common import batches

    text = pa.array(["x" * n for n in (10, 10, 3000, 10, 900, 900, 10)] + [None])
    got = [b.num_rows for b in batches(pa.RecordBatch.from_arrays([text], ["text"]), 3, 1000)]
    assert got == [2, 1, 2, 2, 1] or sum(got) == 8 and max(got) <= 3
    assert list(batches(pa.RecordBatch.from_arrays([text[:0]], ["text"]))) == []
