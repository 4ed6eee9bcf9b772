"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyreel.operators.orphans import orphan_references


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that did not resolve when their row arrived."""
    return orphan_references(spark, sf_dir)[0].select("ref_table", "row_key", "ref_field")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, month of arrival and what became of them."""
    found = orphan_references(spark, sf_dir)[0]
    return found.groupBy("ref_table", "ref_field", F.date_format("t", "yyyy-MM").alias("month"), "status").agg(F.count("*").alias("orphans"))


_ORPHANS = """
WITH v AS (SELECT DISTINCT upper(trim(video_id)) AS video, registered_at AS a, removed_at AS b FROM videos WHERE trim(video_id) <> ''),
k AS (SELECT upper(trim(video_id)) AS video, 'kf_n' AS ref_field, kf_n AS val, min(ingested_at) AS a FROM global_keyframes WHERE kf_n IS NOT NULL GROUP BY ALL
      UNION ALL SELECT upper(trim(video_id)), 'frame_idx', frame_idx, min(ingested_at) FROM global_keyframes WHERE frame_idx IS NOT NULL GROUP BY ALL),
r AS (SELECT 'asr_global_merged_v2' AS ref_table, embedding_row AS row_key, upper(trim(video_id)) AS video, kf_n, frame_idx, min(ingested_at) AS t FROM asr_global_merged_v2 GROUP BY ALL
      UNION ALL SELECT 'search_result', result_id, upper(trim(video_id)), kf_n, frame_idx, min(served_at) FROM search_result GROUP BY ALL
      UNION ALL SELECT 'global_keyframes', g, upper(trim(video_id)), NULL, NULL, min(ingested_at) FROM global_keyframes GROUP BY g, upper(trim(video_id))),
p AS (SELECT r.*, EXISTS (SELECT 1 FROM v WHERE v.video = r.video AND v.a <= r.t AND (v.b IS NULL OR v.b > r.t)) AS here,
      EXISTS (SELECT 1 FROM v WHERE v.video = r.video AND v.b <= r.t) AS gone, EXISTS (SELECT 1 FROM v WHERE v.video = r.video AND v.a > r.t) AS later FROM r WHERE video <> ''),
f AS (SELECT ref_table, row_key, video, t, 'kf_n' AS ref_field, kf_n AS val FROM p WHERE here AND kf_n IS NOT NULL
      UNION ALL SELECT ref_table, row_key, video, t, 'frame_idx', frame_idx FROM p WHERE here AND frame_idx IS NOT NULL),
o AS (SELECT ref_table, row_key, 'video_id' AS ref_field, t, CASE WHEN gone THEN 'removed' WHEN later THEN 'arrived_later' ELSE 'never_there' END AS status FROM p WHERE NOT here
      UNION ALL SELECT f.ref_table, f.row_key, f.ref_field, f.t, CASE WHEN k.a IS NULL THEN 'never_there' ELSE 'arrived_later' END FROM f LEFT JOIN k USING (video, ref_field, val) WHERE k.a IS NULL OR k.a > f.t)
"""

QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
SQL = {
    "p7_found": _ORPHANS + "SELECT ref_table, row_key, ref_field FROM o",
    "p7_counts": _ORPHANS + "SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, status, count(*) AS orphans FROM o GROUP BY ALL",
}
