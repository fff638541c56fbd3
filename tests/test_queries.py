"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quern import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or v.__class__.__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, con):
    df = Q[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert got
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


def test_pairs_per_key_are_five(spark):
    rows = Q["variant_pairs"](spark, SF).groupBy("l_partkey").count().collect()
    assert {r["count"] for r in rows} == {5}


def test_no_plan_holds_all_rows_in_one_window(spark):
    """Ranks over whole tables go by buckets: no window without a partition takes in more than a row for each."""
    for name in ("split_801010", "split_95_5", "label_vocab_ident", "row_shuffle", "batch_chunks", "first_seen", "neg_sampling"):
        plan = Q[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "Window [" in line and "row_number()" in line:
                assert "_bucket" in line.split("row_number()")[1], (name, line)
