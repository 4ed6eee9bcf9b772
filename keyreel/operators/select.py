"""Budgeted choice of candidates: coverage before depth, reservations, policies and their metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def channel_ranks(candidates: DataFrame, *, score: str, source: str, item: str) -> DataFrame:
    """1-based rank within (query, video, source)."""
    return candidates.withColumn("source_rank", F.row_number().over(W.partitionBy("query", "video_id", source).orderBy(F.desc(score), item)))


def allocate_rounds(candidates: DataFrame, *, budget: int, score: str, item: str, video_rank: str, per_video: int = 2) -> DataFrame:
    """Coverage first: the best of every ranked video, then the second of each, up to ``per_video``; ``budget`` in all."""
    r = F.row_number().over(W.partitionBy("query", "video_id").orderBy(F.desc(score), item))
    rounds = candidates.withColumn("round", r).where(F.col("round") <= per_video)
    return rounds.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("round", video_rank, item))).where(F.col("place") <= budget)


def allocate_policy(candidates: DataFrame, *, policy: str, budget: int, score: str, item: str, video_rank: str, p: float = 0.05) -> DataFrame:
    """Policies: 'legacy' (video by video), 'balanced' (two rounds), 'global_p' (score - p * log1p(rank)), 'hybrid_n' (half coverage, half global)."""
    if policy == "balanced":
        return allocate_rounds(candidates, budget=budget, score=score, item=item, video_rank=video_rank)
    per = F.row_number().over(W.partitionBy("query", "video_id").orderBy(F.desc(score), item))
    rows = candidates.withColumn("round", per)
    if policy == "legacy":
        order = [F.asc(video_rank), F.asc("round")]
    elif policy == "global_p":
        order = [F.desc(F.round(F.col(score) - p * F.log1p(F.col(video_rank)), 9)), F.asc(item)]
    elif policy == "hybrid_n":
        order = [F.desc((F.col("round") == 1) & (F.col(video_rank) <= budget // 2)), F.desc(F.round(score, 9)), F.asc(item)]
    else:
        raise ValueError(policy)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("place") <= budget)


def allocate_reserved(candidates: DataFrame, *, budget: int, specialists: tuple[str, ...] = ("asr", "ocr"), reserve: int = 1, per_video: int = 2, adaptive: bool = True) -> DataFrame:
    """(query, item, place, why): coverage of the ranked videos, reservations per specialist, then depth, at most ``per_video`` of a video.

    Columns: query, item, video_id, video_rank, source, score; an item belongs to one video. The coverage pass takes
    ``budget - max(1, budget // 6)`` places if ``adaptive``. The walk gets all that it can look at, and no group grows with
    the corpus. Coverage and depth: the first ``budget`` videos in the order of their best rows (each gives a place before
    a later one is reached), with their ``per_video`` best items over all sources. Reservations, by score alone: of each
    specialist the ``budget + reserve`` best items (at most ``budget`` are taken before).
    """
    rows = candidates.select("query", "item", "video_id", "video_rank", "source", "score")
    once = rows.withColumn("_i", F.row_number().over(W.partitionBy("query", "video_id", "item").orderBy(F.desc("score")))).where("_i = 1").drop("_i")
    deep = once.withColumn("_v", F.row_number().over(W.partitionBy("query", "video_id").orderBy(F.asc_nulls_last("video_rank"), F.desc("score"), "item"))).where(F.col("_v") <= per_video)
    first = deep.where("_v = 1").withColumn("_p", F.row_number().over(W.partitionBy("query").orderBy(F.asc_nulls_last("video_rank"), F.desc("score"), "item"))).where(F.col("_p") <= budget)
    walked = deep.drop("_v").join(first.select("query", "video_id"), ["query", "video_id"], "left_semi").withColumn("special", F.lit(False))
    own = W.partitionBy("query", "source", "item")
    best = rows.where(F.col("source").isin(*specialists)).withColumn("_j", F.row_number().over(own.orderBy(F.desc("score")))).where(F.col("_j") <= reserve).withColumn("_b", F.max("score").over(own))
    best = best.withColumn("_s", F.dense_rank().over(W.partitionBy("query", "source").orderBy(F.desc("_b"), "item"))).where(F.col("_s") <= budget + reserve)
    short = walked.unionByName(best.drop("_j", "_b", "_s").withColumn("special", F.lit(True)))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["video_rank", "score", "item"], ascending=[True, False, True])
        chosen: dict = {}
        used: dict = {}

        def take(row, why: str) -> None:
            if len(chosen) < budget and row.item not in chosen and used.get(row.video_id, 0) < per_video:
                chosen[row.item] = (row.query, row.item, row.video_id, len(chosen) + 1, why)
                used[row.video_id] = used.get(row.video_id, 0) + 1

        rows = list(pdf[~pdf.special].itertuples(index=False))
        best = sorted(pdf[pdf.special].itertuples(index=False), key=lambda r: (-r.score, r.item))
        floor = budget - max(1, budget // 6) if adaptive else budget
        for row in rows:
            if len(chosen) < floor and not used.get(row.video_id):
                take(row, "coverage")
        for s in specialists:
            for row in [r for r in best if r.source == s and r.item not in chosen][:reserve]:
                take(row, f"reserved_{s}")
        for row in rows:
            take(row, "depth")
        return pd.DataFrame(list(chosen.values()), columns=["query", "item", "video_id", "place", "why"])

    types = dict(candidates.dtypes)
    return short.groupBy("query").applyInPandas(pick, f"query {types['query']}, item {types['item']}, video_id {types['video_id']}, place int, why string")


def allocate_anchors(candidates: DataFrame, *, budget: int, per_video: int = 2) -> DataFrame:
    """Visual anchors first (the best visual row of each video), then the best specialist row of each source, then depth; window stages only."""
    rows = candidates.withColumn("_r", F.row_number().over(W.partitionBy("query", "video_id", "source").orderBy(F.desc("score"), "item"))).withColumn("_best", F.row_number().over(W.partitionBy("query", "source").orderBy(F.desc("score"), "item")))
    stage = F.when((F.col("source") == "visual") & (F.col("_r") == 1), 0).when((F.col("source") != "visual") & (F.col("_best") == 1), 1).otherwise(2)
    rows = rows.withColumn("stage", stage).withColumn("_n", F.row_number().over(W.partitionBy("query", "video_id").orderBy("stage", F.desc("score"), "item"))).where(F.col("_n") <= per_video)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("stage", "video_rank", F.desc("score"), "item"))).where(F.col("place") <= budget).drop("_r", "_best", "_n")


def selection_metrics(pool: DataFrame, selected: DataFrame, relevant: DataFrame, *, item: str) -> DataFrame:
    """Per query: pool, unique, collisions, selected, videos, recall of the relevant items."""
    a = pool.groupBy("query").agg(F.count("*").alias("pool"), F.countDistinct(item).alias("unique_items")).withColumn("collisions", F.col("pool") - F.col("unique_items"))
    b = selected.groupBy("query").agg(F.count("*").alias("selected"), F.countDistinct("video_id").alias("videos"))
    hit = relevant.join(selected.select("query", item).distinct(), ["query", item], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    c = relevant.groupBy("query").agg(F.count("*").alias("relevant")).join(hit, "query", "left").select("query", (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"))
    return a.join(b, "query", "left").join(c, "query", "left").na.fill(0, ["selected", "videos"])


def two_stage(candidates: DataFrame, *, first: str, second: str, item: str, shortlist: int = 24, k: int = 6) -> DataFrame:
    """The ``shortlist`` best by the first score, reranked by the second; ties by item."""
    top = candidates.withColumn("_a", F.row_number().over(W.partitionBy("query").orderBy(F.desc(first), item))).where(F.col("_a") <= shortlist)
    return top.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc(second), item))).where(F.col("place") <= k).drop("_a")


def answer_consistency(answers: DataFrame, *, answer: str) -> DataFrame:
    """Share of a query's answers that are equal to this one."""
    return answers.withColumn("consistency", F.count("*").over(W.partitionBy("query", answer)) / F.count("*").over(W.partitionBy("query")))


def rank_answers(answers: DataFrame, *, required: bool) -> DataFrame:
    """Final order: with required sources by support, origin, ranks, grounding, confidence, consistency; else by a weighted sum."""
    if required:
        order = [F.desc("support"), F.desc("direct"), F.asc("source_rank"), F.asc("video_rank"), F.desc("grounding"), F.desc("confidence"), F.desc("consistency"), F.asc("video_id"), F.asc("kf_n")]
        return answers.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order)))
    total = 1 / (1 + F.col("video_rank")) + 0.05 * F.col("base") + 0.20 * F.col("consistency") + 0.25 * F.coalesce("grounding", F.lit(0.0)) + 0.10 * F.coalesce("confidence", F.lit(0.0)) + 0.15 * F.coalesce("support", F.lit(0.0))
    return answers.withColumn("final", total).withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("final", 9)), "video_id", "kf_n")))
