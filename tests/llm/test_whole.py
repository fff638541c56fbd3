"""Operators take in whole texts and all documents."""

from __future__ import annotations

import numpy as np

from quern.llm import lm, toxicity


def test_lm_knows_what_follows_in_all_words_of_all_documents(spark):
    """Only word order differs between the corpora, after word 1500 of each document."""
    ids = [d for d in range(200) if not lm.held_out(d)][:60]
    held = next(d for d in range(200) if lm.held_out(d))
    rng = np.random.default_rng(0)
    fill = [" ".join(f"w{k}" for k in rng.integers(0, 50, 1500)) for _ in ids]
    score = []
    for tail in ("pear quince " * 400, "pear " * 400 + "quince " * 400):
        rows = [(d, f"{t} {tail}") for d, t in zip(ids, fill, strict=True)] + [(held, "pear quince " * 50)]
        out = lm.query(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
        score.append(out[0]["score"] - out[0]["base_score"])
    assert score[0] > score[1] + 1


def test_lm_tells_documents_that_occur_twice(spark):
    rng = np.random.default_rng(1)
    ids = [d for d in range(600) if not lm.held_out(d)][:200]
    texts = {d: " ".join(f"v{k}" for k in rng.zipf(1.3, 200) % 900) for d in ids}
    texts.update({ids[k + 100]: texts[ids[k]] for k in range(20)})
    rows = list(texts.items())
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = {*ids[:20], *ids[100:120]}
    assert min(out[d] for d in twice) > max(out[d] for d in ids if d not in twice)


def test_toxicity_learns_from_whole_texts():
    rows = [(i, " ".join(f"w{(i // 2 * 31 + k * k) % 997}" for k in range(2100)) + (" vile rotten swine" * 3 if i % 2 else ""), i % 2) for i in range(60)]
    model = toxicity.learn(rows)
    assert model.score("vile rotten swine") > model.score("w1 w2 w3")


def test_toxicity_counts_copies_of_one_document_once():
    a, b = ([f"{c}{k}".encode() for k in range(40)] for c in "ab")
    mixed = [*a[:20], *b[:20]]
    tally = toxicity.Tally.of([a, b, mixed, a, [*a, b"z"]], [b])
    n, i = len(tally.index) + 1, tally.index
    times = dict(zip(tally.pairs[0].tolist(), tally.times[0].tolist(), strict=True))
    assert times[i[a[3]] * n + i[a[4]]] == 2 and times[i[b[3]] * n + i[b[4]]] == 2
