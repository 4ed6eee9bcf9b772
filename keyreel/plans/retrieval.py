"""Queries: dense search, normalisation, fusion, guarded fusion, deduplication and allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.operators import dense, fusion, select
from keyreel.plans.base import CANON, REQUESTS, canonical, requests
from keyreel.session import table
from keyreel.sources import ingest

#: The query vectors, set against all rows.
_Q = "vec_id % 20 = 0"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return dense.score_all(e, e.where(_Q).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), vec="embedding", query_id="q", query_vec="qv", keep=["vec_id", "label"])


_SCORED = f"""sc AS (SELECT q.vec_id AS query, e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE {_Q}) q)"""


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every twentieth vector."""
    e = table(spark, d, "embeddings")
    out = dense.search(e, e.where(_Q).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), id="vec_id", vec="embedding", query_id="q", query_vec="qv", k=10, normalise=False)
    return out.select(F.col("query").cast("long").alias("query"), "vec_id", F.round("score", 6).alias("score"), "rank")


def video_max(spark: SparkSession, d: str) -> DataFrame:
    """Best frame score per query and video, with the frame."""
    return _scored(spark, d).groupBy("query", "label").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("o"))).alias("b")).select("query", "label", F.round("b.score", 6).alias("score"), (-F.col("b.o")).alias("vec_id"))


def zscore_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two score columns (best and mean frame) z-fused over videos, with margin."""
    v = _scored(spark, d).groupBy("query", "label").agg(F.max("score").alias("a"), F.avg("score").alias("b"))
    return fusion.zfusion(v, video="label", a="a", b="b").select("query", "label", F.round("fused", 6).alias("fused"), "rank", F.round("margin", 6).alias("margin"))


def clip_top3(spark: SparkSession, d: str) -> DataFrame:
    """Clip search: mean of the three best query-frame scores per video."""
    best = _scored(spark, d).groupBy("query", "label").agg(F.max("score").alias("m"))
    top = best.groupBy("label").agg(F.slice(F.sort_array(F.collect_list("m"), asc=False), 1, 3).alias("x"))
    return top.select("label", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x) / F.size("x"), 6).alias("score"))


def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    """Channel scores scaled to [0, 1] and by rank."""
    r = requests(spark, d)
    return r.select("item", F.round(fusion.minmax("score", ["query", "channel"]), 6).alias("minmax"), F.round(fusion.rank_norm("score", "item", ["query", "channel"]), 6).alias("by_rank"))


def rrf_item(spark: SparkSession, d: str) -> DataFrame:
    """Frames fused over channels, weighted, 50 per request."""
    r = requests(spark, d).withColumn("item", F.concat_ws("/", "video_id", "kf_n"))
    out = fusion.rrf(r.select("query", "channel", "item", "score"), item="item", score="score", weights={"kis": 1.0, "qa": 0.5, "vkis": 0.8, "trake": 0.6}, top_k=50)
    return out.select("query", "item", F.round("rrf", 6).alias("rrf"), F.round("norm", 6).alias("norm"), "rank")


def rrf_video(spark: SparkSession, d: str) -> DataFrame:
    """Videos fused over channels, with the representative frame."""
    out = fusion.video_rrf(requests(spark, d).select("query", "channel", "item", "video_id", "score"), item="item", video="video_id", score="score")
    return out.select("query", "video_id", F.round("rrf", 6).alias("rrf"), "item")


def _channel_ranks(spark: SparkSession, d: str) -> DataFrame:
    hits = requests(spark, d).select("query", F.when(F.col("channel") == "kis", "visual").when(F.col("channel") == "qa", "asr").otherwise("ocr").alias("channel"), "item", "video_id", "score")
    return fusion.collapse_ranks(hits.withColumn("rank", F.row_number().over(W.partitionBy("query", "channel").orderBy(F.desc("score"), "item"))), video="video_id")


def rrf_weighted_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Guarded fusion: specialists push in a video only with a strong rank or together."""
    out = fusion.guarded_rrf(_channel_ranks(spark, d), video="video_id", weights=fusion.ROUTING["spoken_fact"])
    return out.select("query", "video_id", F.round("rrf", 6).alias("rrf"), "guard", "place")


def outer_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists per request joined outer."""
    r = _channel_ranks(spark, d)
    return fusion.outer_rrf(r.where("channel = 'visual'"), r.where("channel = 'ocr'"), video="video_id").select("query", "video_id", "visual_rank", "image_rank", F.round("rrf", 6).alias("rrf"))


def union_provenance(spark: SparkSession, d: str) -> DataFrame:
    """First five of every channel united, first channel's score, sources in order."""
    r = requests(spark, d).where("kf_n IS NOT NULL").groupBy("query", "channel", "video_id", "kf_n").agg(F.max("score").alias("score"))
    order = F.when(F.col("channel") == "kis", 0).when(F.col("channel") == "vkis", 1).when(F.col("channel") == "qa", 2).otherwise(3)
    branches = r.withColumn("branch_ord", order).withColumnRenamed("channel", "branch")
    out = fusion.union_branches(branches, key=["video_id", "kf_n"], score="score", per_branch=5, k=12)
    return out.select("query", "video_id", "kf_n", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"), "place")


def dedupe_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One hit per frame of a request: the best score, then the larger item."""
    r = requests(spark, d)
    return fusion.select_top(r, 20, score="score", item="item").select("query", "item", "place")


def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """Hits merged per frame with united sources."""
    r = requests(spark, d).where("kf_n IS NOT NULL")
    out = fusion.merge_provenance(r.select("query", "video_id", "kf_n", "score", "channel", "item", "frame_idx"), score="score", source="channel", position="item", first=["frame_idx"])
    return out.select("query", "video_id", "kf_n", F.round("score", 6).alias("score"), "item", "frame_idx", F.array_join("sources", ",").alias("sources"), F.size("provenance").alias("records"))


def hard_negative(spark: SparkSession, d: str) -> DataFrame:
    """Reranking with min-max features, constant ones 0."""
    r = requests(spark, d).where("channel = 'kis' AND pts_time IS NOT NULL").select("query", "item", "score", F.col("pts_time").alias("late"), F.lit(1.0).alias("flat"))
    return fusion.hard_negative(r, base="score", features={"late": -0.1, "flat": 0.5}, item="item").select("query", "item", F.round("reranked", 6).alias("reranked"))


def best_of_video(spark: SparkSession, d: str) -> DataFrame:
    """Frames collapsed to one per video; ties to the larger item."""
    r = requests(spark, d)
    f = fusion.rrf(r.select("query", "channel", "item", "score"), item="item", score="score").join(r.select("query", "item", "video_id").distinct(), ["query", "item"])
    return fusion.best_per_video(f.withColumn("rrf", F.round("rrf", 6)).withColumn("norm", F.round("norm", 6)), video="video_id", item="item")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    v = _channel_ranks(spark, d).groupBy("query", "video_id").agg(F.min("rank").alias("vr"))
    v = v.withColumn("video_rank", F.row_number().over(W.partitionBy("query").orderBy("vr", "video_id"))).drop("vr")
    return requests(spark, d).join(v, ["query", "video_id"]).withColumn("source", F.when(F.col("channel") == "kis", "visual").when(F.col("channel") == "qa", "asr").otherwise("ocr"))


def allocate_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds over the ranked videos, 24 places."""
    return select.allocate_policy(_pool(spark, d), policy="balanced", budget=24, score="score", item="item", video_rank="video_rank").select("query", "item", "place")


def allocate_global(spark: SparkSession, d: str) -> DataFrame:
    """Scores less a penalty for the video's rank, 24 places."""
    return select.allocate_policy(_pool(spark, d), policy="global_p", budget=24, score="score", item="item", video_rank="video_rank").select("query", "item", "place")


def allocate_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Visual anchors, specialists, depth."""
    return select.allocate_anchors(_pool(spark, d), budget=24).select("query", "item", "stage", "place")


def allocate_reserved(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, reservations, depth: a sequential walk over each request's shortlist."""
    return select.allocate_reserved(_pool(spark, d), budget=24).select("query", "item", "place", "why")


def two_stage(spark: SparkSession, d: str) -> DataFrame:
    """Shortlist by score, rerank by time."""
    r = requests(spark, d).where("pts_time IS NOT NULL")
    return select.two_stage(r, first="score", second="pts_time", item="item").select("query", "item", "place")


def answer_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Share of a request's hits that name the same video."""
    return select.answer_consistency(requests(spark, d), answer="video_id").select("item", F.round("consistency", 6).alias("consistency"))


def clip_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Clip search over frames: three best queries, best query smoothed over five places, blended, 20 videos."""
    out = dense.clip_scores(_scored(spark, d), video="label", frame="vec_id", order="vec_id", shortlist=5)
    return out.select("label", "vec_id", F.round("top3", 6).alias("top3"), F.round("smooth5", 6).alias("smooth5"), F.round("hybrid", 6).alias("hybrid"))


def per_video_frames(spark: SparkSession, d: str) -> DataFrame:
    """Two best frames of every query and video."""
    return dense.per_video(_scored(spark, d), video="label", frame="vec_id", k=2).select("query", "label", "vec_id", "place")


def margin_route(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a close race take the third model's scores."""
    v = _scored(spark, d).groupBy("query", "label").agg(F.max("score").alias("a"), F.avg("score").alias("b"))
    f = fusion.zfusion(v, video="label", a="a", b="b")
    return fusion.reroute(f, v.withColumn("third", F.col("a") + F.col("b")), video="label", score="third", margin=0.3).select("query", "label", F.round("score", 6).alias("score"), "route", "rank")


def canonicalised_pool(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the map's frames; unknown keys dropped, stale frames put right."""
    pool = requests(spark, d).where("kf_n IS NOT NULL").select("query", "item", "video_id", "kf_n", "frame_idx")
    return ingest.canonicalise(pool, canonical(spark, d))


_CH = "CASE channel WHEN 'kis' THEN 'visual' WHEN 'qa' THEN 'asr' ELSE 'ocr' END"
_RANKS = f"""{REQUESTS}, c AS (SELECT query, {_CH} AS channel, item, video_id, score FROM req),
cr AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, item) AS rank FROM c),
ranks AS (SELECT query, channel, video_id, min(rank) AS rank FROM cr GROUP BY ALL)"""
_POOL = f"""{_RANKS}, vr AS (SELECT query, video_id, row_number() OVER (PARTITION BY query ORDER BY min(rank), video_id) AS video_rank FROM ranks GROUP BY query, video_id),
pool AS (SELECT req.*, video_rank, {_CH} AS source FROM req JOIN vr USING (query, video_id))"""

QUERIES = {f.__name__: f for f in (dense_topk, video_max, zscore_fusion, clip_top3, minmax_norm, rrf_item, rrf_video, rrf_weighted_guarded, outer_fusion, union_provenance, dedupe_candidates, merge_sources, hard_negative, best_of_video, allocate_balanced, allocate_global, allocate_anchors, allocate_reserved, two_stage, answer_consistency, clip_hybrid, per_video_frames, margin_route, canonicalised_pool)}
SQL = {
    "dense_topk": f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc) SELECT query, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "video_max": f"WITH {_SCORED} SELECT query, label, round(max(score), 6) AS score, arg_max(vec_id, (score, -vec_id)) AS vec_id FROM sc GROUP BY ALL",
    "zscore_fusion": f"""WITH {_SCORED}, v AS (SELECT query, label, max(score) AS a, avg(score) AS b FROM sc GROUP BY ALL),
z AS (SELECT query, label, 0.4 * (a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-6) + 0.6 * (b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-6) AS fused FROM v WINDOW w AS (PARTITION BY query)),
r AS (SELECT *, row_number() OVER w AS rank, lead(fused) OVER w AS nxt FROM z WINDOW w AS (PARTITION BY query ORDER BY round(fused, 9) DESC, label))
SELECT query, label, round(fused, 6) AS fused, rank, round(CASE WHEN rank = 1 THEN fused - nxt END, 6) AS margin FROM r""",
    "clip_top3": f"WITH {_SCORED}, b AS (SELECT query, label, max(score) AS m FROM sc GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC) AS n FROM b) SELECT label, round(avg(m), 6) AS score FROM r WHERE n <= 3 GROUP BY label",
    "minmax_norm": f"""WITH {REQUESTS} SELECT item, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 6) AS minmax,
round((count(*) OVER w - row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, item) + 1) / count(*) OVER w, 6) AS by_rank FROM req WINDOW w AS (PARTITION BY query, channel)""",
    "rrf_item": f"""WITH {REQUESTS}, i AS (SELECT query, channel, concat_ws('/', video_id, kf_n) AS item, score FROM req),
r AS (SELECT query, channel, item, min(rank) AS rank, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, item) AS rank FROM i) GROUP BY ALL),
n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS norm, CASE channel WHEN 'kis' THEN 1.0 WHEN 'qa' THEN 0.5 WHEN 'vkis' THEN 0.8 WHEN 'trake' THEN 0.6 ELSE 1.0 END::DOUBLE AS w FROM r WINDOW w AS (PARTITION BY query, channel)),
f AS (SELECT query, item, sum(w / (60 + rank)) AS rrf, sum(w * norm) AS norm FROM n GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 9) DESC, item) AS rank FROM f)
SELECT query, item, round(rrf, 6) AS rrf, round(norm, 6) AS norm, rank FROM o WHERE rank <= 50""",
    "rrf_video": f"""WITH {REQUESTS}, r AS (SELECT query, channel, item, video_id, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, item) AS rank FROM req),
b AS (SELECT query, channel, video_id, min(rank) AS item_rank, arg_min(item, (rank, item)) AS item FROM r GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY item_rank, video_id) AS rank FROM b)
SELECT query, video_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, arg_min(item, (rank, channel, item)) AS item FROM v GROUP BY query, video_id""",
    "rrf_weighted_guarded": f"""WITH {_RANKS}, p AS (SELECT query, video_id, min(rank) FILTER (channel = 'visual') AS vrank, min(rank) FILTER (channel <> 'visual') AS best, count(DISTINCT channel) FILTER (channel <> 'visual' AND rank <= 20) AS support,
sum(CASE channel WHEN 'visual' THEN 0.75 WHEN 'asr' THEN 1.0 ELSE 0.5 END::DOUBLE / (60 + rank)) AS rrf FROM ranks GROUP BY ALL),
g AS (SELECT *, CASE WHEN vrank <= 20 THEN 'visual' WHEN best <= 5 THEN 'strong' WHEN support >= 2 THEN 'support' END AS guard FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 9) DESC, video_id) AS place FROM g WHERE guard IS NOT NULL)
SELECT query, video_id, round(rrf, 6) AS rrf, guard, place FROM o WHERE place <= 20""",
    "outer_fusion": f"""WITH {_RANKS} SELECT query, video_id, a.rank AS visual_rank, b.rank AS image_rank, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS rrf
FROM (SELECT * FROM ranks WHERE channel = 'visual') a FULL JOIN (SELECT * FROM ranks WHERE channel = 'ocr') b USING (query, video_id)""",
    "union_provenance": f"""WITH {REQUESTS}, h AS (SELECT query, channel, video_id, kf_n, max(score) AS score, CASE channel WHEN 'kis' THEN 0 WHEN 'vkis' THEN 1 WHEN 'qa' THEN 2 ELSE 3 END AS o FROM req WHERE kf_n IS NOT NULL GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, video_id, kf_n) AS r FROM h) WHERE r <= 5),
u AS (SELECT query, video_id, kf_n, arg_min(score, (o, r)) AS score, min((o, r)) AS f, string_agg(channel, ',' ORDER BY o) AS sources FROM t GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY f) AS place FROM u) SELECT query, video_id, kf_n, round(score, 6) AS score, sources, place FROM p WHERE place <= 12""",
    "dedupe_candidates": f"""WITH {REQUESTS}, d AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY query, video_id, coalesce('f' || frame_idx, 'k' || kf_n, 'i' || item) ORDER BY score DESC, item DESC) = 1)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS place FROM d QUALIFY place <= 20""",
    "merge_sources": f"""WITH {REQUESTS}, h AS (SELECT * FROM req WHERE kf_n IS NOT NULL), s AS (SELECT query, video_id, kf_n, channel, min(item) AS i FROM h GROUP BY ALL), t AS (SELECT query, video_id, kf_n, string_agg(channel, ',' ORDER BY i) AS sources FROM s GROUP BY ALL)
SELECT query, video_id, kf_n, round(max(score), 6) AS score, min(item) AS item, arg_min(frame_idx, item) FILTER (frame_idx IS NOT NULL) AS frame_idx, any_value(sources) AS sources, count(*) AS records FROM h JOIN t USING (query, video_id, kf_n) GROUP BY ALL""",
    "hard_negative": f"""WITH {REQUESTS}, h AS (SELECT query, item, score, pts_time AS late FROM req WHERE channel = 'kis' AND pts_time IS NOT NULL)
SELECT query, item, round(score - (row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1) * 1e-9 - 0.1 * coalesce(CASE WHEN max(late) OVER w > min(late) OVER w THEN (late - min(late) OVER w) / (max(late) OVER w - min(late) OVER w) ELSE 0 END, 0), 6) AS reranked FROM h WINDOW w AS (PARTITION BY query)""",
    "best_of_video": f"""WITH {REQUESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, item) AS rank, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS norm FROM req WINDOW w AS (PARTITION BY query, channel)),
f AS (SELECT query, item, video_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, round(sum(norm), 6) AS norm FROM r GROUP BY ALL)
SELECT query, video_id, rrf, norm, item FROM f QUALIFY row_number() OVER (PARTITION BY query, video_id ORDER BY rrf DESC, norm DESC, item DESC) = 1""",
    "allocate_balanced": f"""WITH {_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY query, video_id ORDER BY score DESC, item) AS round FROM pool)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round, video_rank, item) AS place FROM r WHERE round <= 2 QUALIFY place <= 24""",
    "allocate_global": f"WITH {_POOL} SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(score - 0.05::DOUBLE * ln(1 + video_rank), 9) DESC, item) AS place FROM pool QUALIFY place <= 24",
    "allocate_anchors": f"""WITH {_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY query, video_id, source ORDER BY score DESC, item) AS r, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, item) AS b FROM pool),
s AS (SELECT *, CASE WHEN source = 'visual' AND r = 1 THEN 0 WHEN source <> 'visual' AND b = 1 THEN 1 ELSE 2 END AS stage FROM r),
n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, video_id ORDER BY stage, score DESC, item) <= 2)
SELECT query, item, stage, row_number() OVER (PARTITION BY query ORDER BY stage, video_rank, score DESC, item) AS place FROM n QUALIFY place <= 24""",
    "two_stage": f"""WITH {REQUESTS}, a AS (SELECT * FROM req WHERE pts_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 24)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY pts_time DESC, item) AS place FROM a QUALIFY place <= 6""",
    "answer_consistency": f"WITH {REQUESTS} SELECT item, round(count(*) OVER (PARTITION BY query, video_id) / count(*) OVER (PARTITION BY query), 6) AS consistency FROM req",
    "clip_hybrid": f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) AS n FROM sc), t AS (SELECT label, vec_id, avg(score) FILTER (n <= 3) AS top3, max(score) AS best FROM r GROUP BY ALL),
k AS (SELECT label FROM t GROUP BY label ORDER BY round(max(top3), 9) DESC, label LIMIT 5),
l AS (SELECT label, vec_id, top3, best, coalesce(lag(best, 1) OVER w, first_value(best) OVER f) AS a, coalesce(lag(best, 2) OVER w, first_value(best) OVER f) AS b, coalesce(lead(best, 1) OVER w, last_value(best) OVER f) AS c, coalesce(lead(best, 2) OVER w, last_value(best) OVER f) AS d FROM t WHERE label IN (FROM k) WINDOW w AS (PARTITION BY label ORDER BY vec_id), f AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT label, vec_id, round(top3, 6) AS top3, round((best + a + b + c + d) / 5, 6) AS smooth5, round(0.5::DOUBLE * top3 + 0.5::DOUBLE * (best + a + b + c + d) / 5, 6) AS hybrid FROM l""",
    "per_video_frames": f"WITH {_SCORED} SELECT query, label, vec_id, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS place FROM sc QUALIFY place <= 2",
    "margin_route": f"""WITH {_SCORED}, v AS (SELECT query, label, max(score) AS a, avg(score) AS b FROM sc GROUP BY ALL),
z AS (SELECT *, 0.4 * (a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-6) + 0.6 * (b - avg(b) OVER w) / (stddev_pop(b) OVER w + 1e-6) AS fused FROM v WINDOW w AS (PARTITION BY query)),
r AS (SELECT *, row_number() OVER w AS rank, lead(fused) OVER w AS nxt FROM z WINDOW w AS (PARTITION BY query ORDER BY round(fused, 9) DESC, label)),
c AS (SELECT query FROM r WHERE rank = 1 AND fused - nxt < 0.3),
s AS (SELECT query, label, CASE WHEN query IN (FROM c) THEN a + b ELSE fused END AS score, CASE WHEN query IN (FROM c) THEN 'third' ELSE 'fused' END AS route FROM z)
SELECT query, label, round(score, 6) AS score, route, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, label) AS rank FROM s""",
    "canonicalised_pool": f"""WITH {CANON}, {REQUESTS}, c AS (SELECT video_id, kf_n, any_value(frame_idx) AS f FROM canon GROUP BY ALL)
SELECT query, item, r.video_id, r.kf_n, c.f AS frame_idx, CASE WHEN r.frame_idx IS NOT DISTINCT FROM c.f THEN 'kept' ELSE 'remapped' END AS trace FROM req r JOIN c ON r.video_id = c.video_id AND r.kf_n = c.kf_n""",
}
