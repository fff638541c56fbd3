"""What all queries share: their registry, table readers, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import tables as O

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ident() -> Column:
    return F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("_HTTPServer"), F.replace("p_brand", F.lit("Brand#"), F.lit("V")))


IDENT = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') || '_HTTPServer' || replace(p_brand, 'Brand#', 'V')"
CAMEL = "list_transform(regexp_extract_all(regexp_replace({}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"
NAMES = f"list_filter({CAMEL.format(IDENT)}, lambda x: NOT regexp_full_match(x, '[0-9]+'))"
TOK = "tok AS (SELECT doc_id, pos - 1 AS pos, w FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS l FROM documents)))"
GRAM = "gram AS (SELECT p_name, n, pos, substr(p_name, pos + 1, n) AS gram, nullif(substr(p_name, pos + n + 1, 1), '') AS nxt, CASE WHEN pos > 0 THEN substr(p_name, pos, 1) END AS prv FROM (SELECT p_name, n, unnest(range(0, length(p_name) - n + 1)) AS pos FROM (SELECT DISTINCT p_name FROM part), (SELECT unnest(range(1, 11)) AS n) WHERE length(p_name) >= n))"
DICE = "md5('{}-' || {}::VARCHAR)"

CTOK = TOK.replace("documents", "conversations").replace("doc_id", "conv_id, turn").replace("tok AS", "ctok AS")
VOC = "voc AS (SELECT w, cnt, row_number() OVER (ORDER BY cnt DESC, w) + 4 AS id FROM (SELECT w, count(*) AS cnt FROM tok GROUP BY w) QUALIFY row_number() OVER (ORDER BY cnt DESC, w) <= 13000)"
#: Longest gram of the freedom model.
MOST_GRAM = 10


def tokens(spark: SparkSession, d: str, table: str = "documents", *keys: str) -> DataFrame:
    keys = keys or ("doc_id",)
    return read(spark, d, table).select(*keys, F.posexplode(T.spaced_words(F.col("text"))).alias("pos", "w"))


def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.posexplode(T.camel_words(ident())).alias("pos", "w"))


def grams(spark: SparkSession, d: str) -> DataFrame:
    return O.char_grams(read(spark, d, "part"), "p_name", MOST_GRAM)


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
