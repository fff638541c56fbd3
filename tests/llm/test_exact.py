"""Stages and operators that lose nothing: against plain versions on rows that a bounded search or a sample would miss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_groups, rows_of, texts_of

from quern.llm import fingerprint, lm, simhash


def groups_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component"] for r in rows_of(simhash.groups(docs))}


def test_near_dedup_finds_a_pair_without_a_band_in_common(spark):
    w = [f"12915v{i}" for i in range(14)]  # eight of ten shingles in common; 20 bands of 4 least hashes all differ
    assert groups_of(spark, {1: " ".join(w[:13]), 2: " ".join(w[1:])}) == {2: 1}


def test_near_dedup_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {d: c for d, c in brute_groups(texts_of(docs)).items() if c != d}
    assert {r["doc_id"]: r["component"] for r in rows_of(simhash.groups(docs))} == want


def test_near_dedup_of_chains_and_common_passages(spark):
    rng = np.random.default_rng(3)
    line = [f"c{i}" for i in range(600)]
    common = [f"p{i}" for i in range(90)]
    texts, ids = {}, rng.permutation(400).tolist()
    for i in range(50):  # neighbours are alike, the next but one are not
        texts[ids.pop()] = " ".join(line[i * 10 : i * 10 + 94])
    for i in range(60):  # a passage in common, not alike; each has a twin
        own = [f"o{i}x{k}" for k in range(14)]
        texts[ids.pop()] = " ".join(common + own)
        texts[ids.pop()] = " ".join(common + own[:-1])
    want = {d: c for d, c in brute_groups(texts).items() if c != d}
    assert len(want) == 49 + 60 and groups_of(spark, texts) == want


def test_near_dedup_compares_those_that_a_smaller_document_stands_before(spark):
    w = [f"b{i}" for i in range(170)]  # the first holds all that the others have in common, and is like none
    texts = {1: " ".join(w), 5: " ".join(w[:94]), 3: " ".join(w[10:104]), 9: " ".join(w[:94]), 7: " ".join(w[10:104])}
    assert groups_of(spark, texts) == {5: 3, 7: 3, 9: 3}


@pytest.mark.parametrize("rows", [1, 2, 3, 1000])
def test_shared_keys_over_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        keys = [1, 2, 2, 3, 4, 4, 4, 4, 4, 5, 6, 6]
        df = spark.createDataFrame([(k, n, 9, n) for n, k in enumerate(keys)], "h long, node long, size int, pos int")
        got = sorted((r["h"], r["node"], r["rep"]) for r in rows_of(simhash._shared(df)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(k, n, keys.index(k)) for n, k in enumerate(keys) if keys.count(k) > 1]


def test_lm_fits_every_id_of_every_training_document():
    pieces = lm.Pieces("byte_bpe_50k.json")
    texts = ["", "one", *(" ".join(f"w{i * k % 97}" for i in range(40 * k)) for k in range(1, 40))]
    held = np.arange(len(texts)) % 5 == 1
    coded = lm.Coded.of(pa.array(texts), held, pieces)
    seq, n = coded.sequence()
    want = np.concatenate([x for x, h in zip(np.split(seq, np.cumsum(n)[:-1]), held, strict=True) if not h])
    targets = coded.windows(0)[:, 1:].ravel()
    assert (targets[targets >= 0] == want).all()


@pytest.mark.parametrize("most", [7, 500_000])
def test_lm_shards_hold_every_window(spark, monkeypatch, most):
    monkeypatch.setattr(lm, "BATCH_BYTES", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    coded = lm.code(docs)
    monkeypatch.setattr(lm, "SHARD_WINDOWS", most)
    size = lm.Pieces("byte_bpe_50k.json").size
    n = coded.agg({"n_windows": "sum"}).first()[0]

    def f(windows, shard):
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(windows)]), pa.array([int((windows[:, 1:] >= 0).sum())])], ["shard", "n", "ids"])

    got = rows_of(lm._shards(coded, size, n, f, "shard long, n long, ids long"))
    assert sum(r["n"] for r in got) == n and len({r["shard"] for r in got}) == len(got)
    assert sum(r["ids"] for r in got) == int(lm._id_counts(coded, size).sum())


def test_lm_encodes_a_word_once_and_keeps_its_ids(monkeypatch):
    pieces, plain = lm.Pieces("byte_bpe_50k.json"), lm.Pieces("byte_bpe_50k.json").encoder.words
    asked = []
    monkeypatch.setattr(pieces.encoder, "words", lambda w: asked.extend(w.to_pylist()) or plain(w))
    monkeypatch.setattr(lm, "KNOWN", 60)
    for words in ([f"w{k}." for k in range(40)], [f"w{k}." for k in range(20, 60)], [f"v{k}é" for k in range(50)], ["v3é", lm.END, "w1."]):
        ids, size = pieces.of(words)
        want, n = zip(*(([pieces.end], [1]) if w == lm.END else plain(pa.array([w])) for w in words), strict=True)
        assert ids.tolist() == np.concatenate(want).tolist() and size.tolist() == np.concatenate(n).tolist()
    assert len(asked) == 40 + 20 + 50 + 1


def test_lm_exponentials_beyond_the_range_of_floats():
    z = np.array([[300, 299, 500], [-300, -301, 5], [1, 2, 3]], np.float32)
    part = np.array([1, 1, 0], np.float32)
    e, total = lm._exps(z.copy, lambda x: x.sum(axis=-1), part)
    want = np.exp(z.astype(float) - z[:, :2].max(axis=1, keepdims=True)) * part
    assert np.allclose(e / total[:, None], want / want.sum(axis=1, keepdims=True))


def test_fingerprint_draws_are_gamma_to_their_tails(spark):
    h = F.xxhash64("id")
    rows = spark.range(200_000).select(fingerprint._turned(h).alias("z"), fingerprint._halvings(F.xxhash64(h, F.lit(1))).alias("n"))
    got = np.array([(r["z"], r["n"], r["x"]) for r in rows.withColumn("x", fingerprint._exponentials(F.col("z"), F.col("n"))).collect()])
    z, n, x = got.T
    # the logarithm, then the distribution: 1 - (1 + x) exp(-x)
    assert np.allclose(x, (n + 1) * np.log(2) - 4 * np.arctanh(z), rtol=0, atol=1e-10) and x.min() > 0
    x = np.sort(x)
    assert np.abs(1 - np.exp(-x) * (1 + x) - np.arange(1, len(x) + 1) / len(x)).max() < 2 / np.sqrt(len(x))
    assert (x > 12).mean() == pytest.approx(13 * np.exp(-12), rel=0.6)
    assert [spark.range(1).select(fingerprint._halvings(F.lit(v))).first()[0] for v in (0, 2, 6, -1, -(2**63))] == [63, 63, 0, 0, 63]
