"""Retrieval quality and paired reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_bucket(rank: Column) -> Column:
    """r1_5, r6_20, r21_100, gt_not_in_r100 or unavailable."""
    return F.when(rank.isNull(), "unavailable").when(rank <= 5, "r1_5").when(rank <= 20, "r6_20").when(rank <= 100, "r21_100").otherwise("gt_not_in_r100")


def recall_at(first_rank: DataFrame, ks: list[int], *, rank: str = "rank") -> DataFrame:
    """(k, queries, recall) of a table with one row per query and its first relevant rank (null: none)."""
    rows = first_rank.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), F.coalesce((F.col(rank) <= F.col("k")).cast("int"), F.lit(0)).alias("hit"))
    return rows.groupBy("k").agg(F.count("*").alias("queries"), F.avg("hit").alias("recall"))


def tolerance_hits(predicted: Column, truth: Column, seconds: float) -> Column:
    """Whether every event's time lies within the tolerance of the truth; arrays of unequal length miss."""
    return (F.size(predicted) == F.size(truth)) & F.forall(F.zip_with(predicted, truth, lambda a, b: F.coalesce(F.abs(a - b) <= seconds, F.lit(False))), lambda x: x)


def failure_taxonomy(rows: DataFrame, *, rank: str, stage: str) -> DataFrame:
    """Counts per stage and rank bucket."""
    return rows.groupBy(stage, rank_bucket(F.col(rank)).alias("bucket")).agg(F.count("*").alias("queries"))


def paired(a: DataFrame, b: DataFrame, *, query: str, score: str, least_gap: float = 0.05) -> DataFrame:
    """Two reports on the same queries; the first is chosen unless the second leads by ``least_gap``. A query in one report only is 'unpaired'."""
    j = a.select(query, F.col(score).alias("a")).join(b.select(query, F.col(score).alias("b")), query, "full")
    return j.withColumn("chosen", F.when(F.col("a").isNull() | F.col("b").isNull(), "unpaired").when(F.col("b") - F.col("a") >= least_gap, "b").otherwise("a"))


def same_queries(*reports: DataFrame, query: str) -> DataFrame:
    """Queries that aren't in all of the reports; empty if they match."""
    ids = None
    for r in reports:
        d = r.select(query).distinct()
        ids = d if ids is None else ids.unionAll(d)
    return ids.groupBy(query).agg(F.count("*").alias("n")).where(F.col("n") < len(reports)).select(query)


def metric_scope(name: Column) -> Column:
    """'oracle' where the name says that the video was given, else 'end_to_end'."""
    return F.when(F.lower(name).rlike("oracle|given_video|gt_video"), "oracle").otherwise("end_to_end")


def latest_percentile(events: DataFrame, *, by: str, time: str, value: str, q: float = 0.95, last: int = 1000) -> DataFrame:
    """Value at place floor(q * (n - 1)) of the ``last`` most recent ones of each group."""
    recent = events.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(time)))).where(F.col("_r") <= last)
    n = F.count("*").over(W.partitionBy(by))
    placed = recent.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(value)) - 1).withColumn("_n", n)
    return placed.where(F.col("_i") == F.floor(q * (F.col("_n") - 1))).select(by, F.col(value).alias("percentile"), F.col("_n").alias("n"))
