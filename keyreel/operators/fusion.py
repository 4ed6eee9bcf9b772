"""Score normalisation, rank fusion, guarded fusion and deduplication of ranked channels.

A channel is a set of rows (query, channel, item/video, score). Absent channels add nothing; they are never filled with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def zscore(c: str, by: list[str]) -> Column:
    """(x - mean) / (population deviation + 1e-6) within ``by``."""
    w = W.partitionBy(*by)
    return (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-6)


def minmax(c: str, by: list[str], constant: float = 1.0) -> Column:
    """Scaled to [0, 1] within ``by``; where all are equal, ``constant``."""
    w = W.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(constant))


def rank_norm(c: str, id: str, by: list[str]) -> Column:
    """(n - rank + 1) / n within ``by``, ties by id."""
    return (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(W.partitionBy(*by).orderBy(F.desc(c), id)) + 1) / F.count("*").over(W.partitionBy(*by))


def oriented(c: Column, higher_is_better: bool) -> Column:
    """Scores so that larger is better."""
    return c if higher_is_better else -c


def ranked_hits(hits: DataFrame, *, item: str, score: str, position: str | None = None) -> DataFrame:
    """Rank within (query, channel) by score descending, item ascending; a repeated item keeps its first rank, but its repeats use up ranks."""
    order = [F.desc(score), F.asc(item), *([F.asc(position)] if position else [])]
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query", "channel").orderBy(*order)))
    return ranked.groupBy("query", "channel", item).agg(F.min("rank").alias("rank"), F.max(score).alias(score))


def weights_column(weights: dict[str, float], modality: Column | None = None) -> Column:
    """The weight of a row's channel, else of its modality, else 1."""
    get = lambda c: F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[c]
    if not weights:
        return F.lit(1.0)
    return F.coalesce(get(F.col("channel")), *([get(modality)] if modality is not None else []), F.lit(1.0))


def rrf(hits: DataFrame, *, item: str, score: str, weights: dict[str, float] | None = None, k: int = 60, top_k: int | None = None) -> DataFrame:
    """(query, item, rrf, norm, channel_ranks, rank): sum of w / (k + rank) and of w * minmax over the channels; order rrf descending, item ascending."""
    ranked = ranked_hits(hits, item=item, score=score).withColumn("norm", minmax(score, ["query", "channel"])).withColumn("w", weights_column(weights or {}))
    fused = ranked.groupBy("query", item).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("rrf"), F.sum(F.col("w") * F.col("norm")).alias("norm"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("channel_ranks"))
    fused = fused.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("rrf", 9)), item)))
    return fused.where(F.col("rank") <= top_k) if top_k else fused


def video_rrf(hits: DataFrame, *, item: str, video: str, score: str, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Channels collapsed to their best item per video and re-ranked, then fused; the representative is the smallest (rank, channel, item)."""
    ranked = ranked_hits(hits, item=item, score=score).join(hits.select("query", "channel", item, video).distinct(), ["query", "channel", item])
    best = ranked.groupBy("query", "channel", video).agg(F.min(F.struct("rank", item)).alias("b")).select("query", "channel", video, F.col("b.rank").alias("item_rank"), F.col(f"b.{item}").alias(item))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query", "channel").orderBy("item_rank", video))).withColumn("w", weights_column(weights or {}))
    fused = best.groupBy("query", video).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("rank", "channel", item)).alias("r"))
    return fused.select("query", video, "rrf", F.col(f"r.{item}").alias(item))


def collapse_ranks(hits: DataFrame, *, video: str) -> DataFrame:
    """Best rank per (query, channel, video)."""
    return hits.groupBy("query", "channel", video).agg(F.min("rank").alias("rank"))


def guarded_rrf(ranks: DataFrame, *, video: str, weights: dict[str, float], k: int = 60, top_k: int = 20, visual: str = "visual", strong_rank: int = 5, support_rank: int = 20, least_channels: int = 2, rescued: DataFrame | None = None) -> DataFrame:
    """Weighted fusion in which a specialist can't push in a video alone: (query, video, rrf, guard).

    Admitted are videos of the visual channel's first ``top_k``; videos a specialist has within ``strong_rank``; videos that
    ``least_channels`` specialists have within ``support_rank``; and rescued ones (query, video). Specialist rows that pass
    score with their original ranks.
    """
    per = ranks.groupBy("query", video).agg(
        F.min(F.when(F.col("channel") == visual, F.col("rank"))).alias("visual_rank"),
        F.min(F.when(F.col("channel") != visual, F.col("rank"))).alias("best"),
        F.countDistinct(F.when((F.col("channel") != visual) & (F.col("rank") <= support_rank), F.col("channel"))).alias("support"),
        F.sum(F.coalesce(weights_column(weights), F.lit(1.0)) / (k + F.col("rank"))).alias("rrf"),
    )
    per = per.join(rescued.select("query", video).distinct().withColumn("saved", F.lit(True)), ["query", video], "left") if rescued is not None else per.withColumn("saved", F.lit(None).cast("boolean"))
    guard = F.when(F.col("visual_rank") <= top_k, "visual").when(F.col("best") <= strong_rank, "strong").when(F.col("support") >= least_channels, "support").when(F.col("saved"), "rescued")
    kept = per.withColumn("guard", guard).where("guard IS NOT NULL")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("rrf", 9)), video))).where(F.col("place") <= top_k).select("query", video, "rrf", "guard", "place")


#: Channel weights by question type.
ROUTING = {
    "general": {"visual": 1.0, "asr": 0.5, "ocr": 0.5},
    "spoken_fact": {"visual": 0.75, "asr": 1.0, "ocr": 0.5},
    "screen_text": {"visual": 0.75, "asr": 0.5, "ocr": 1.0},
    "visual_detail": {"visual": 1.0, "asr": 0.25, "ocr": 0.25},
    "temporal": {"visual": 1.0, "asr": 0.5, "ocr": 0.25},
}


def routing_weights(spark) -> DataFrame:
    """(plan, channel, weight) as a small table."""
    return spark.createDataFrame([(p, c, w) for p, x in ROUTING.items() for c, w in x.items()], "plan string, channel string, weight double")


def outer_rrf(left: DataFrame, right: DataFrame, *, video: str, k: int = 60, names: tuple[str, str] = ("visual", "image")) -> DataFrame:
    """Unweighted fusion of two ranked lists per video; ties by the two ranks."""
    a, b = (d.select("query", video, F.col("rank").alias(f"{n}_rank")) for d, n in zip((left, right), names))
    both = a.join(b, ["query", video], "full")
    part = lambda n: F.coalesce(1.0 / (k + F.col(f"{n}_rank")), F.lit(0.0))
    return both.withColumn("rrf", part(names[0]) + part(names[1]))


def zfusion(scores: DataFrame, *, video: str, a: str, b: str, alpha: float = 0.4) -> DataFrame:
    """alpha * z(a) + (1 - alpha) * z(b) over the videos of a query, with the margin between the first and the second."""
    z = scores.withColumn("fused", alpha * zscore(a, ["query"]) + (1 - alpha) * zscore(b, ["query"]))
    w = W.partitionBy("query").orderBy(F.desc(F.round("fused", 9)), video)
    return z.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("fused").over(w)).withColumn("margin", F.when(F.col("rank") == 1, F.col("fused") - F.col("next"))).drop("next")


def union_branches(hits: DataFrame, *, key: list[str], score: str, per_branch: int, k: int) -> DataFrame:
    """First ``per_branch`` of each branch (query, branch, branch_ord), united: the first branch's score stays, sources in branch order."""
    r = F.row_number().over(W.partitionBy("query", "branch").orderBy(F.desc(score), *key))
    top = hits.withColumn("r", r).where(F.col("r") <= per_branch)
    united = top.groupBy("query", *key).agg(F.min(F.struct("branch_ord", "r", score)).alias("f"), F.transform(F.array_sort(F.collect_set(F.struct("branch_ord", "branch"))), lambda x: x["branch"]).alias("sources"))
    out = united.select("query", *key, F.col(f"f.{score}").alias(score), "sources", F.col("f.branch_ord").alias("o"), F.col("f.r").alias("p"))
    return out.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("o", "p"))).where(F.col("place") <= k).drop("o", "p")


def dedupe(hits: DataFrame, *, score: str, item: str) -> DataFrame:
    """One row per (query, video, frame_idx, else kf_n, else item): the largest (score, item) stays."""
    key = F.coalesce(F.concat(F.lit("f"), F.col("frame_idx")), F.concat(F.lit("k"), F.col("kf_n")), F.concat(F.lit("i"), F.col(item)))
    w = W.partitionBy("query", "video_id", "_key").orderBy(F.desc(score), F.desc(item))
    return hits.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")


def select_top(hits: DataFrame, k: int, *, score: str, item: str) -> DataFrame:
    """Deduplicated, then the ``k`` best per query."""
    return dedupe(hits, score=score, item=item).withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc(score), item))).where(F.col("place") <= k)


def merge_provenance(candidates: DataFrame, *, score: str, source: str, position: str, first: list[str]) -> DataFrame:
    """One row per (query, video, kf_n): largest score, sources and provenance united in first-seen order, other fields from the first row that has them."""
    agg = [F.max(score).alias(score), F.min(position).alias(position)]
    agg += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in first]
    prov = F.array_sort(F.collect_list(F.struct(position, source, score)))
    out = candidates.groupBy("query", "video_id", "kf_n").agg(*agg, prov.alias("provenance"))
    return out.withColumn("sources", F.array_distinct(F.transform("provenance", lambda x: x[source])))


def best_per_video(fused: DataFrame, *, video: str, item: str) -> DataFrame:
    """Best item per video by rrf, then norm, then the larger item."""
    return fused.groupBy("query", video).agg(F.max(F.struct("rrf", "norm", item)).alias("b")).select("query", video, "b.*")


def hard_negative(candidates: DataFrame, *, base: str, features: dict[str, float], item: str, base_weight: float = 1.0) -> DataFrame:
    """base_weight * base - rank * 1e-9 + weighted minmax of the features; a constant feature counts 0."""
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc(base), item)) - 1
    total = base_weight * F.col(base) - r * 1e-9
    for f, w in features.items():
        total = total + w * F.coalesce(minmax(f, ["query"], 0.0), F.lit(0.0))
    return candidates.withColumn("reranked", total)


def rescue_reason(provenance: Column, *, modes: list[str], most_rank: int = 3, least_score: float = 0.8, exact: tuple[str, ...] = ("exact", "quote")) -> Column:
    """Reason given by the first provenance record (mode, rank, score, view) that allows a rescue; null for none."""
    ok = F.filter(provenance, lambda p: p["mode"].isin(modes) & (p["rank"] <= most_rank) & ((p["score"] >= least_score) | p["mode"].isin(*exact)))
    return F.when(F.size(ok) > 0, F.concat_ws(":", ok[0]["mode"], ok[0]["view"], ok[0]["rank"].cast("string")))


def eligible_evidence(score: Column, floor: float, fields: list[Column]) -> Column:
    """A finite score of at least the floor, and some field that isn't blank."""
    said = F.exists(F.array(*[F.coalesce(F.trim(f.cast("string")), F.lit("")) for f in fields]), lambda x: x != "")
    return F.coalesce((score >= floor) & ~F.isnan(score) & said, F.lit(False))


def expand(candidates: DataFrame, neighbours: DataFrame, *, item: str, score: str, most: int | None = None) -> DataFrame:
    """Candidates united with their neighbours (query, item, score, ...), then one row per frame."""
    out = dedupe(candidates.unionByName(neighbours, allowMissingColumns=True), score=score, item=item)
    return select_top(out, most, score=score, item=item) if most else out


def dedupe_guarded(rows: DataFrame, *, key: list[str], order: list, place: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; keys whose rows disagree on ``place`` are dropped altogether."""
    agree = rows.groupBy(*key).agg(F.countDistinct(F.struct(*place)).alias("_n")).where("_n = 1").drop("_n")
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return best.join(agree, key, "left_semi")


def reroute(fused: DataFrame, third: DataFrame, *, video: str, score: str, margin: float = 0.05) -> DataFrame:
    """Queries whose first two videos lie within ``margin`` take the third model's scores, the others keep the fused ones; ranked again."""
    close = fused.where((F.col("rank") == 1) & (F.col("margin") < margin)).select("query")
    kept = fused.join(close, "query", "left_anti").select("query", video, F.col("fused").alias("score"), F.lit("fused").alias("route"))
    other = third.join(close, "query", "left_semi").select("query", video, F.col(score).alias("score"), F.lit("third").alias("route"))
    return kept.unionByName(other).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), video)))
