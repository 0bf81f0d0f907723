"""The registered queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from voxmill import dataset_queries
from voxmill.operators import coverage, references


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.speech_periods(table(spark, sf_dir, "diarized_segments")).select("source_id", "chunk_idx", "speaker", "kind", "start_ms", "end_ms")


def _reference_tables(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("metadata", "metadata_extended")}, table(spark, sf_dir, "audio_files")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans(*_reference_tables(spark, sf_dir)).select("ref_table", "row_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(*_reference_tables(spark, sf_dir))


def p3_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans(*_reference_tables(spark, sf_dir))


SPACES = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"

_P2 = f"""WITH c AS (
  SELECT source_id, chunk_idx, upper(regexp_replace(speaker, '^{SPACES}+|{SPACES}+$', '', 'g')) AS speaker, round(start * 1000)::BIGINT AS s, round("end" * 1000)::BIGINT AS e
  FROM diarized_segments WHERE NOT isnan(start) AND NOT isnan("end")),
k AS (SELECT * FROM c WHERE speaker <> '' AND e > s),
f AS (SELECT *, max(e) OVER (PARTITION BY source_id, chunk_idx, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, chunk_idx, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM f),
p AS (SELECT source_id, chunk_idx, speaker, min(s) AS a, max(e) AS b FROM i GROUP BY source_id, chunk_idx, speaker, isl),
g AS (SELECT *, lead(a) OVER (PARTITION BY source_id, chunk_idx, speaker ORDER BY a) AS nxt FROM p)
SELECT source_id, chunk_idx, speaker, 'period' AS kind, a AS start_ms, b AS end_ms FROM p
UNION ALL SELECT source_id, chunk_idx, speaker, 'gap', b, nxt FROM g WHERE nxt IS NOT NULL"""

_KEY = lambda c: rf"regexp_replace(regexp_replace(lower(regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')), '[\\/]+', '/', 'g'), '^(\./)+', '')"

# each reference is held against the intervals of its path, one by one
_P3 = f"""WITH refs AS (
  SELECT 'metadata' AS ref_table, row_id, {_KEY('file')} AS path, committed_at, file FROM metadata
  UNION ALL SELECT 'metadata_extended', row_id, {_KEY('file')}, committed_at, file FROM metadata_extended),
iv AS (SELECT {_KEY('path')} AS path, listed_at AS a, deleted_at AS b FROM audio_files WHERE listed_at IS NOT NULL AND {_KEY('path')} <> ''),
pairs AS (SELECT r.ref_table, r.row_id, r.committed_at, iv.path IS NOT NULL AS listed, a <= committed_at AND b IS NULL AS live, a <= committed_at AND b > committed_at AS held, a <= committed_at AS was
  FROM refs r LEFT JOIN iv ON r.path = iv.path WHERE regexp_replace(r.file, '^{SPACES}+|{SPACES}+$', '', 'g') <> ''),
j AS (SELECT ref_table, row_id, any_value(committed_at) AS committed_at, CASE WHEN bool_or(live) THEN 'ok' WHEN bool_or(held) THEN 'deleted_later' WHEN bool_or(was) THEN 'deleted' WHEN bool_or(listed) THEN 'late' ELSE 'missing' END AS validity
  FROM pairs GROUP BY ref_table, row_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dataset_queries.queries() | {f.__name__: f for f in (p2_found, p3_found, p3_report, p3_validity)}


def oracle_sql() -> dict[str, str]:
    own = {
        "p2_found": _P2,
        "p3_found": f"{_P3} SELECT ref_table, row_id FROM j WHERE validity <> 'ok'",
        "p3_validity": f"{_P3} SELECT ref_table, row_id, validity FROM j WHERE validity <> 'ok'",
        "p3_report": f"""{_P3} SELECT ref_table, coalesce(strftime(committed_at, '%Y-%m'), 'unknown') AS month, count(*) AS refs, count(*) FILTER (validity <> 'ok') AS orphans,
            count(*) FILTER (validity = 'deleted_later') AS deleted_later, count(*) FILTER (validity = 'deleted') AS deleted, count(*) FILTER (validity = 'late') AS late, count(*) FILTER (validity = 'missing') AS missing FROM j GROUP BY 1, 2""",
    }
    return dataset_queries.oracle_sql() | dataset_queries.nan_safe(own)
