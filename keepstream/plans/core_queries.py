"""Queries of the general operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepstream.operators.reconcile import ledger_differences


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return ledger_differences(table(spark, folder, "ledger_a"), table(spark, folder, "ledger_b"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found}


def _state(name: str) -> str:
    return rf"""
  SELECT sid, score, response FROM (
    SELECT sid, CASE WHEN isnan(CAST(score AS DOUBLE)) THEN NULL ELSE CAST(score AS DOUBLE) + 0.0 END AS score, response,
           row_number() OVER (PARTITION BY sid ORDER BY written_at DESC NULLS LAST, row_no DESC NULLS LAST) AS rn
    FROM (SELECT *, regexp_replace(trim(sample_id, ' ' || chr(9)), '^0+([0-9])', '\1') AS sid FROM {name})) x WHERE rn = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH a AS ({_state("ledger_a")}), b AS ({_state("ledger_b")}),
both_sides AS (
  SELECT coalesce(a.sid, b.sid) AS sample_id, a.sid AS in_a, b.sid AS in_b, a.score AS sa, b.score AS sb, a.response AS ra, b.response AS rb
  FROM a FULL OUTER JOIN b ON a.sid = b.sid)
SELECT sample_id, 'only_a' AS diff FROM both_sides WHERE in_b IS NULL
UNION ALL SELECT sample_id, 'only_b' FROM both_sides WHERE in_a IS NULL
UNION ALL SELECT sample_id, 'score' FROM both_sides WHERE in_a IS NOT NULL AND in_b IS NOT NULL AND sa IS DISTINCT FROM sb
UNION ALL SELECT sample_id, 'response' FROM both_sides WHERE in_a IS NOT NULL AND in_b IS NOT NULL AND ra IS DISTINCT FROM rb"""
    }
