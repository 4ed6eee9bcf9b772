"""Cleaned views of the tables that the queries share, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyreel.session import table, tidy_id


def canonical(spark: SparkSession, d: str) -> DataFrame:
    """One row per keyframe; repeated deliveries have the same content."""
    return table(spark, d, "global_keyframes").select("g", tidy_id("video_id").alias("video_id"), "pack", "kf_n", "frame_idx", "pts_time").where("video_id IS NOT NULL").distinct()


def speech(spark: SparkSession, d: str) -> DataFrame:
    """One row per speech chunk."""
    return table(spark, d, "asr_global_merged_v2").select("embedding_row", tidy_id("video_id").alias("video_id"), "chunk_index", "text", "start", "end", "kf_n", "frame_idx", "pts_time", "source_pack").distinct()


def screen(spark: SparkSession, d: str) -> DataFrame:
    """One row per screen text."""
    return table(spark, d, "ocr_global_merged_v2").select("embedding_row", tidy_id("video_id").alias("video_id"), "kf_n", "frame_idx", "pts_time", "ocr_text", "source_pack", "source_provenance", "source_priority").distinct()


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Served results with a usable video and score; the kind of query is the channel."""
    h = table(spark, d, "search_result").select("result_id", "query_id", "rank", tidy_id("video_id").alias("video_id"), "frame_idx", "kf_n", "pts_time", "score").distinct()
    ok = F.col("video_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return h.where(ok).withColumn("channel", F.split("query_id", "-")[0])


CANON = "canon AS (SELECT DISTINCT g, upper(trim(video_id)) AS video_id, pack, kf_n, frame_idx, pts_time FROM global_keyframes WHERE trim(video_id) <> '')"
SPEECH = """speech AS (SELECT DISTINCT embedding_row, nullif(upper(trim(video_id)), '') AS video_id, chunk_index, text, start, "end", kf_n, frame_idx, pts_time, source_pack FROM asr_global_merged_v2)"""
SCREEN = "screen AS (SELECT DISTINCT embedding_row, nullif(upper(trim(video_id)), '') AS video_id, kf_n, frame_idx, pts_time, ocr_text, source_pack, source_provenance, source_priority FROM ocr_global_merged_v2)"
HITS = "hits AS (SELECT DISTINCT result_id, query_id, rank, upper(trim(video_id)) AS video_id, frame_idx, kf_n, pts_time, score, split_part(query_id, '-', 1) AS channel FROM search_result WHERE trim(video_id) <> '' AND isfinite(score))"
#: A query number that several channels share: the served queries of one number are one request asked in several ways.
REQUEST = "CAST(split_part(query_id, '-', 2) AS BIGINT) % 40"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Hits as channels of 40 requests: (query, channel, item, video_id, score, kf_n, frame_idx, pts_time)."""
    h = hits(spark, d)
    return h.select((F.get(F.split("query_id", "-"), F.lit(1)).try_cast("long") % 40).alias("query"), "channel", F.col("result_id").alias("item"), "video_id", "score", "kf_n", "frame_idx", "pts_time")


REQUESTS = f"{HITS}, req AS (SELECT {REQUEST} AS query, channel, result_id AS item, video_id, score, kf_n, frame_idx, pts_time FROM hits)"


def fold_sql(c: str) -> str:
    """The fold expression in SQL."""
    from keyreel.functions.text import ACCENTED, PLAIN

    return f"translate(lower({c}), '{ACCENTED}', '{PLAIN}')"


def tokens_sql(c: str) -> str:
    """The token expression in SQL."""
    return f"coalesce(regexp_extract_all({fold_sql(c)}, '[\\p{{L}}\\p{{N}}_]+'), [])"
