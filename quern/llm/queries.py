"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import dac, fingerprint, lm, mixing, packing, pipeline, quality, sharding, simhash, substrings, toxicity
from quern.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def _labelled(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_document_fingerprints": _docs(fingerprint.query),
        "op2_simhash_near_dedup": _docs(simhash.query),
        "op3_substring_dedup": _docs(substrings.query),
        "op4_quality_rules": _labelled(quality.query),
        "op5_source_mixing": _docs(mixing.query),
        "op6_sharding": _docs(sharding.query),
        "op7_token_output": _docs(dac.query),
        "op8_lm_scoring": _docs(lm.query),
        "op9_toxicity": _labelled(toxicity.query),
        "op10_best_fit_packing": _docs(packing.query),
        "pipeline": pipeline.run,
    }


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), twice AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN twice USING (s)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL}
