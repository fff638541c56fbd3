"""Splitters know every word of the names, however many there are."""

import itertools

from quern import queries

Q = queries.queries()


def test_rare_words_beyond_ten_thousand_are_split_off(spark, tmp_path):
    words = ["".join(w) for w in itertools.islice(itertools.product("bcdfghjklm", repeat=4), 10_000)]
    rows = [(i, f"{w} {w}", "Brand#1") for i, w in enumerate(words)] + [(-1, "zzyzx qqvqq", "Brand#1")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("unigram_segment", "lexicon_tokenize"):
        got = Q[name](spark, str(tmp_path)).where("p_partkey = -1").first()["parts"]
        assert "zzyzx" in got and "qqvqq" in got, name
