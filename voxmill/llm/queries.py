"""The registered queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.dataset_queries import SPACES, nan_safe, table
from voxmill.llm import cutoffs, encoding, languages, leaks, percentiles, personal, repetition

def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.kept_rows(table(spark, sf_dir, "metadata_extended"))


def p1_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.cutoff_report(table(spark, sf_dir, "metadata_extended")).withColumn("kept_share", F.round("kept_share", 6))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = percentiles.long_values(table(spark, sf_dir, "metadata_extended"))
    return percentiles.exact_percentiles(values).withColumn("value", F.round("value", 9))


def _daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "metadata_extended").withColumn("day", F.to_date("committed_at"))
    return percentiles.long_values(rows, extra=("day",))


def p5_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the runs of separate days, combined."""
    runs = percentiles.value_counts(_daily_values(spark, sf_dir), ("day",))
    return percentiles.percentiles_of_counts(percentiles.combined_counts(runs)).withColumn("value", F.round("value", 9))


def p5_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the summaries of separate days, combined, and whether each is within its bound of the exact one."""
    values = _daily_values(spark, sf_dir)
    bounded = percentiles.summary_percentiles(percentiles.combine_summaries(percentiles.day_summaries(values)))
    exact = percentiles.exact_percentiles(values).withColumnsRenamed({"value": "exact", "n": "exact_n"})
    apart = F.when(F.col("value") == F.col("exact"), 0.0).otherwise(F.abs(F.col("value") - F.col("exact")))
    return bounded.join(exact, ["source", "metric", "p"]).select("source", "metric", "p", "n", (apart <= F.col("bound")).alias("within"), (F.col("n") == F.col("exact_n")).alias("same_n"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive_rows(table(spark, sf_dir, "metadata_extended"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_shares(table(spark, sf_dir, "metadata_extended")).withColumn("share", F.round("share", 6))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.scored_rows(table(spark, sf_dir, "metadata_extended")).withColumn("probability", F.round("probability", 6))


def p4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.classifier_report(table(spark, sf_dir, "metadata_extended"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(table(spark, sf_dir, "metadata_extended"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_segments(table(spark, sf_dir, "metadata_extended")).withColumn("confidence", F.round("confidence", 6))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.token_ids(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also passages with a few words wrong."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_pieces(table(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_cutoffs, p5_percentiles, p5_combined, p5_bounded, p4_found, p4_shares, p4_scores, p4_classifier, p6_found, p6_segments, p7_ids, p8_found, p8_near, p9_found, p9_redacted)}


_COUNTED = f"""counted AS (
  SELECT row_id, regexp_replace(source, '^{SPACES}+|{SPACES}+$', '', 'g') AS source, speaker_similarity AS score
  FROM metadata_extended WHERE NOT isnan(speaker_similarity) AND speaker_similarity BETWEEN -1 AND 1),
ranked AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS rk FROM counted WHERE source <> ''),
cut AS (SELECT source, n, score AS cutoff FROM ranked WHERE rk = (3 * n + 4) // 5)"""

_VALUES = f"""src AS (SELECT *, coalesce(regexp_replace(source, '^{SPACES}+|{SPACES}+$', '', 'g'), '') AS s FROM metadata_extended),
vals AS (
  SELECT s AS source, 'duration' AS metric, duration AS value FROM src WHERE duration IS NOT NULL AND NOT isnan(duration)
  UNION ALL SELECT s, 'speaker_similarity', speaker_similarity FROM src WHERE speaker_similarity IS NOT NULL AND NOT isnan(speaker_similarity))"""


_P5 = f"""WITH {_VALUES}, q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p), o AS (
    SELECT source, metric, value, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY source, metric) AS n FROM vals WINDOW w AS (PARTITION BY source, metric ORDER BY value)),
    t AS (SELECT source, metric, p, n, p * (n - 1) AS h, max(value) FILTER (rk = floor(p * (n - 1))) AS a, max(value) FILTER (rk = ceil(p * (n - 1))) AS b FROM o, q GROUP BY source, metric, p, n)
    SELECT source, metric, p::DOUBLE AS p, n, round(a + (b - a) * (h - floor(h)), 9) AS value FROM t"""


def oracle_sql() -> dict[str, str]:
    return nan_safe({
        "p1_found": f"WITH {_COUNTED} SELECT row_id FROM ranked JOIN cut USING (source) WHERE score >= cutoff",
        "p1_cutoffs": f"""WITH {_COUNTED} SELECT source, any_value(cut.n) AS n, any_value(cutoff) AS cutoff, count(*) AS kept, round(count(*) / any_value(cut.n), 6) AS kept_share
            FROM ranked JOIN cut USING (source) WHERE score >= cutoff GROUP BY source""",
        "p5_percentiles": _P5,
        "p5_combined": _P5,
        "p5_bounded": f"SELECT source, metric, p, n, true AS within, true AS same_n FROM ({_P5})",
    })
