"""Queries: canonical map, mapping, intervals, neighbours, sessions, sampling and ordered alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.operators import align, quality, temporal
from keyreel.plans.base import CANON, HITS, SCREEN, SPEECH, canonical, hits, screen, speech
from keyreel.session import table
from keyreel.sources import ingest


def canonical_map(spark: SparkSession, d: str) -> DataFrame:
    """The canonical map with a dense row number over pack, video and keyframe."""
    c = canonical(spark, d).select("video_id", "pack", "kf_n", "frame_idx", "pts_time")
    return ingest.dense_id(c, ["pack", "video_id", "kf_n"], "row_id")


def identity_set(spark: SparkSession, d: str) -> DataFrame:
    """Identities of which only the map or only the stored speech mapping knows."""
    rows = speech(spark, d).where("video_id IS NOT NULL AND kf_n IS NOT NULL AND frame_idx IS NOT NULL")
    return quality.identity_difference(canonical(spark, d), rows)


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Rows, videos and repeated keys of the keyed tables."""
    return quality.inventory({"keyframes": canonical(spark, d), "speech": speech(spark, d), "screen": screen(spark, d)})


def mapping_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Stored speech mappings by what is wrong with them."""
    return quality.mapping_report(speech(spark, d), canonical(spark, d)).groupBy("source_pack", "mapping").agg(F.count("*").alias("n"))


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes with screen text by video, pack and in all."""
    out = quality.coverage(canonical(spark, d), screen(spark, d).where("video_id IS NOT NULL AND kf_n IS NOT NULL"))
    return out.withColumn("share", F.round("share", 6))


def timeline_report(spark: SparkSession, d: str) -> DataFrame:
    """Rules a canonical map breaks."""
    return quality.timeline_report(canonical(spark, d))


def preflight(spark: SparkSession, d: str) -> DataFrame:
    """Problem codes of both modalities."""
    return quality.preflight(speech(spark, d), screen(spark, d), canonical(spark, d))


def artifact_scope(spark: SparkSession, d: str) -> DataFrame:
    """Scope of each modality against the catalog."""
    n = table(spark, d, "videos").select(F.countDistinct(F.upper(F.trim("video_id"))).alias("all"))
    parts = [t.agg(F.count("*").alias("rows"), F.countDistinct("video_id").alias("videos")).select(F.lit(k).alias("name"), "rows", "videos") for k, t in (("speech", speech(spark, d)), ("screen", screen(spark, d)), ("keyframes", canonical(spark, d)))]
    return quality.together(parts).join(F.broadcast(n)).select("name", "rows", "videos", quality.artifact_scope(F.col("rows"), F.col("videos"), F.col("all")).alias("scope"))


def priority_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One screen text per keyframe by source priority, provenance and row."""
    s = screen(spark, d).where("video_id IS NOT NULL AND kf_n IS NOT NULL")
    w = W.partitionBy("video_id", "kf_n").orderBy("source_priority", "source_provenance", "embedding_row")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select("video_id", "kf_n", "embedding_row", "source_provenance")


def resolve_frames(spark: SparkSession, d: str) -> DataFrame:
    """Served (video, keyframe) references resolved in the map."""
    h = hits(spark, d).where("kf_n IS NOT NULL").select("video_id", "kf_n").distinct()
    return ingest.resolve_frames(h, canonical(spark, d))


def pilot_scope(spark: SparkSession, d: str) -> DataFrame:
    """The middle keyframe of every video of two packs."""
    return ingest.select_scope(canonical(spark, d), packs=["L21", "K01"], pilot=True).select("video_id", "kf_n")


def nearest_frame(spark: SparkSession, d: str) -> DataFrame:
    """Nearest keyframe of every chunk's middle, whatever the distance; ties to the earlier."""
    s = speech(spark, d).where("video_id IS NOT NULL AND start IS NOT NULL AND `end` >= start").withColumn("mid", (F.col("start") + F.col("end")) / 2)
    c = canonical(spark, d).select("video_id", F.col("pts_time").alias("c_time"), "kf_n").withColumnRenamed("kf_n", "near")
    out = temporal.nearest_row(s.select("embedding_row", "video_id", "mid"), c, on="video_id", time="mid", right_time="c_time", payload=["near"])
    return out.where("near_near IS NOT NULL").select("embedding_row", F.col("near_near").alias("kf_n"), F.round("distance", 6).alias("distance"))


def interval_context(spark: SparkSession, d: str) -> DataFrame:
    """First three chunks within 15 seconds of every keyframe, joined and cut."""
    a = canonical(spark, d).where("pts_time IS NOT NULL").select(F.col("g").alias("anchor"), "video_id", F.col("pts_time").alias("at"))
    s = speech(spark, d).where("trim(text) <> ''").select("video_id", "start", "end", "text", "embedding_row")
    return temporal.context_windows(a, s, on="video_id", anchor="anchor", time="at", start="start", end="end", text="text", order="embedding_row", within=15.0, most_rows=3, most_chars=1500)


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap and gap of each chunk with the next of its video."""
    s = speech(spark, d).where("video_id IS NOT NULL AND start IS NOT NULL AND `end` >= start")
    w = W.partitionBy("video_id").orderBy("start", "end", "embedding_row")
    n = s.withColumn("s2", F.lead("start").over(w)).withColumn("e2", F.lead("end").over(w)).where("s2 IS NOT NULL")
    return n.select("embedding_row", F.round(temporal.overlap_seconds(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")), 6).alias("overlap"), F.round(temporal.gap_seconds(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")), 6).alias("gap"))


def temporal_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Two frames before and after every keyframe."""
    c = canonical(spark, d).where("pts_time IS NOT NULL")
    return temporal.neighbours(c, c, by="video_id", id="g", order=["pts_time", "kf_n"], radius=2).select("seed", "g", "offset")


def _frame_scores(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).where("kf_n IS NOT NULL").groupBy("video_id", "kf_n").agg(F.max("score").alias("score"))
    return h.join(canonical(spark, d).where("pts_time IS NOT NULL").select("video_id", "kf_n", "pts_time", "g"), ["video_id", "kf_n"])


_FRAMES = f"{CANON}, {HITS}, fs AS (SELECT h.video_id, h.kf_n, max(score) AS score, any_value(c.pts_time) AS pts_time, any_value(c.g) AS g FROM hits h JOIN canon c ON h.video_id = c.video_id AND h.kf_n = c.kf_n AND c.pts_time IS NOT NULL GROUP BY ALL)"


def temporal_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Frame scores blended with the best of two neighbours on either side."""
    return temporal.consensus(_frame_scores(spark, d), by=["video_id"], order=["pts_time", "kf_n"], score="score").select("g", F.round("consensus", 6).alias("consensus"))


def peak_neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    """Frames around the two peaks of every video."""
    return temporal.around_peaks(_frame_scores(spark, d), by=["video_id"], time="pts_time", score="score", id="g").select("g", F.round("blended", 6).alias("blended"))


def moving_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Frame scores smoothed over five places."""
    return temporal.smooth(_frame_scores(spark, d), by=["video_id"], order=["pts_time", "kf_n"], value="score", width=5).select("g", F.round("smoothed", 6).alias("smoothed"))


def peaks_nms(spark: SparkSession, d: str) -> DataFrame:
    """Greedy peaks of every video."""
    return temporal.peaks(_frame_scores(spark, d), by=["video_id"], kf="kf_n", time="pts_time", score="score")


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of screen texts with gaps of at most 15 seconds, and their density."""
    s = screen(spark, d).where("video_id IS NOT NULL AND pts_time IS NOT NULL")
    c = temporal.sessions(s, by="video_id", time="pts_time", order=["embedding_row"], gap=15.0)
    size = c.groupBy("video_id", "session").agg(F.count("*").alias("n"), F.min("pts_time").alias("first"), F.max("pts_time").alias("last"))
    return size.join(temporal.density(c, by=["video_id", "session"], time="pts_time"), ["video_id", "session"]).withColumn("density", F.round("density", 6))


def time_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Frames at least ten seconds apart, at most 40 per video."""
    return temporal.sample_by_interval(canonical(spark, d), by="video_id", time="pts_time", id="g", interval=10.0, most=40)


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Speech rows regrouped to windows of about eight seconds."""
    s = speech(spark, d).where("video_id IS NOT NULL AND text IS NOT NULL")
    return temporal.word_windows(s, by="video_id", word="text", start="start", end="end")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """A score matrix: per frame of `events` one column per event type, null where the frame isn't of it, on a half-second grid of exact values."""
    e = table(spark, d, "events")
    s = F.round(F.col("value") * 64) / 64
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    kind = F.pmod(F.col("event_id"), F.lit(3))
    cols = [F.when(kind != (i + 1) % 3, s).alias(f"e{i}") for i in range(3)]
    return e.where("value IS NOT NULL").select("user_id", F.col("event_id").alias("frame"), t.alias("t"), *cols)


def ordered_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Three ordered events per user, penalty per frame between."""
    out = align.align(_events(spark, d), by=["user_id"], time="t", frame="frame", events=["e0", "e1", "e2"], penalty=0.25, axis="index")
    return out.select("user_id", F.round("score", 6).alias("score"), F.array_join("path", "-").alias("path"))


def timed_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Three ordered events per user, penalty per second between (a power of two, so both engines round alike)."""
    out = align.align(_events(spark, d), by=["user_id"], time="t", frame="frame", events=["e0", "e1", "e2"], penalty=2.0**-16, axis="time")
    return out.select("user_id", F.round("score", 6).alias("score"), F.array_join("path", "-").alias("path"))


def gap_alignment(spark: SparkSession, d: str) -> DataFrame:
    """As ordered_alignment with at most ten frames between two events."""
    out = align.align(_events(spark, d), by=["user_id"], time="t", frame="frame", events=["e0", "e1", "e2"], penalty=0.25, axis="index", max_gap=10)
    return out.select("user_id", F.round("score", 6).alias("score"), F.array_join("path", "-").alias("path"))


def event_division(spark: SparkSession, d: str) -> DataFrame:
    """Videos found by every kind of query, and the sum of their best scores."""
    h = hits(spark, d)
    ok = align.covering(h, by=["video_id"], event="channel", needed=4)
    best = h.groupBy("video_id", "channel").agg(F.max("score").alias("m")).groupBy("video_id").agg(F.sum("m").alias("bound"))
    return best.join(ok, "video_id", "left_semi").select("video_id", F.round("bound", 6).alias("bound"))


def event_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Twenty videos with the largest upper bound over the kinds of query."""
    return align.shortlist(hits(spark, d).withColumn("all", F.lit(1)), by=["all"], video="video_id", event="channel", score="score", k=20).select("video_id", F.round("bound", 6).alias("bound"), "place")


def lattice_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Three best frames of every video and kind of query, and their neighbours."""
    h = hits(spark, d).where("kf_n IS NOT NULL").groupBy("video_id", "channel", "kf_n").agg(F.max("score").alias("score"))
    pos = h.withColumn("pos", F.row_number().over(W.partitionBy("video_id", "channel").orderBy("kf_n")))
    return align.lattice(pos, by=["video_id"], event="channel", frame="kf_n", score="score", pos="pos", top_k=3).select("video_id", "channel", "kf_n", "kind")


def temporal_relation(spark: SparkSession, d: str) -> DataFrame:
    """Order of the best KIS and the best Q&A evidence of every video."""
    h = hits(spark, d).where("pts_time IS NOT NULL")
    return align.relation(h.where("channel = 'kis'"), h.where("channel = 'qa'"), by="video_id", time="pts_time", score="score")


def event_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Logistic z-scores and half min-max, half rank scores of the hits within video and kind."""
    h = hits(spark, d)
    n = align.event_hit_norm(h, by=["video_id", "channel"], score="score", key="result_id")
    return n.select("result_id", F.round(align.normalise_events("score", ["channel"]), 6).alias("logistic"), F.round("norm", 6).alias("norm"))


def fused_modalities(spark: SparkSession, d: str) -> DataFrame:
    """Per video and keyframe the weighted sum of the best score of every kind."""
    h = hits(spark, d).where("kf_n IS NOT NULL")
    return align.fuse_modalities(h, by=["video_id", "kf_n"], modality="channel", score="score", weights={"kis": 1.0, "qa": 0.5}).select("video_id", "kf_n", F.round("fused", 6).alias("fused"), F.size("evidence").alias("modalities"))


_ALIGN_STEPS = """
s1 AS (SELECT *, {t} AS tt, e0::DOUBLE AS dp, [frame] AS path FROM m),
s2 AS (SELECT *, max(CASE WHEN dp IS NOT NULL THEN {{'x': dp + {p} * tt, 'o': -i, 'p': path}} END) OVER w AS b FROM s1 WINDOW w AS (PARTITION BY user_id ORDER BY t, frame ROWS BETWEEN {lo} AND 1 PRECEDING)),
s3 AS (SELECT * REPLACE (e1 + b.x - {p} * tt AS dp, list_concat(b.p, [frame]) AS path) FROM s2),
s4 AS (SELECT * EXCLUDE (b), max(CASE WHEN dp IS NOT NULL THEN {{'x': dp + {p} * tt, 'o': -i, 'p': path}} END) OVER w AS b FROM s3 WINDOW w AS (PARTITION BY user_id ORDER BY t, frame ROWS BETWEEN {lo} AND 1 PRECEDING)),
s5 AS (SELECT * REPLACE (e2 + b.x - {p} * tt AS dp, list_concat(b.p, [frame]) AS path) FROM s4),
z AS (SELECT user_id, max({{'s': dp, 'o': -i, 'p': path}}) AS b FROM s5 WHERE dp IS NOT NULL GROUP BY user_id)
SELECT user_id, round(b.s, 6) AS score, array_to_string(b.p, '-') AS path FROM z"""
_MATRIX = """WITH x AS (SELECT user_id, event_id AS frame, floor(epoch_us(ts) / 1000000)::DOUBLE AS t, round(value * 64) / 64 AS s, event_id % 3 AS k FROM events WHERE value IS NOT NULL),
m AS (SELECT user_id, frame, t, row_number() OVER (PARTITION BY user_id ORDER BY t, frame)::DOUBLE AS i, CASE WHEN k <> 1 THEN s END AS e0, CASE WHEN k <> 2 THEN s END AS e1, CASE WHEN k <> 0 THEN s END AS e2 FROM x),"""

QUERIES = {f.__name__: f for f in (canonical_map, identity_set, inventory, mapping_mismatch, coverage_rollup, timeline_report, preflight, artifact_scope, priority_dedupe, resolve_frames, pilot_scope, nearest_frame, interval_context, interval_overlap, temporal_neighbors, temporal_consensus, peak_neighbourhoods, moving_smooth, peaks_nms, gap_sessions, time_sampling, word_windows, ordered_alignment, timed_alignment, gap_alignment, event_division, event_shortlist, lattice_candidates, temporal_relation, event_normalised, fused_modalities)}
SQL = {
    "canonical_map": f"WITH {CANON} SELECT video_id, pack, kf_n, frame_idx, pts_time, row_number() OVER (ORDER BY pack NULLS FIRST, video_id, kf_n, frame_idx) - 1 AS row_id FROM canon",
    "identity_set": f"""WITH {CANON}, {SPEECH}, a AS (SELECT DISTINCT video_id, kf_n, frame_idx FROM canon), b AS (SELECT DISTINCT video_id, kf_n, frame_idx FROM speech WHERE video_id IS NOT NULL AND kf_n IS NOT NULL AND frame_idx IS NOT NULL)
SELECT *, 'a' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'b' FROM (FROM b EXCEPT FROM a)""",
    "inventory": f"""WITH {CANON}, {SPEECH}, {SCREEN}, k AS (SELECT 'keyframes' AS name, video_id, kf_n, count(*) AS n FROM canon GROUP BY ALL UNION ALL SELECT 'speech', video_id, kf_n, count(*) FROM speech GROUP BY video_id, kf_n UNION ALL SELECT 'screen', video_id, kf_n, count(*) FROM screen GROUP BY video_id, kf_n)
SELECT name, sum(n)::BIGINT AS rows, count(DISTINCT video_id) AS videos, count(*) FILTER (n > 1) AS repeated_keys FROM k GROUP BY name""",
    "mapping_mismatch": f"""WITH {CANON}, {SPEECH} SELECT source_pack, CASE WHEN s.video_id IS NULL OR s.kf_n IS NULL THEN 'unmapped' WHEN c.frame_idx IS NULL THEN 'unknown_key' WHEN s.frame_idx <> c.frame_idx THEN 'frame_mismatch' WHEN abs(s.pts_time - c.pts_time) > 0.01 THEN 'time_mismatch' ELSE 'ok' END AS mapping, count(*) AS n
FROM speech s LEFT JOIN canon c ON s.video_id = c.video_id AND s.kf_n = c.kf_n GROUP BY ALL""",
    "coverage_rollup": f"""WITH {CANON}, {SCREEN}, h AS (SELECT DISTINCT video_id, kf_n, 1 AS has FROM screen) SELECT pack, video_id, count(*) AS frames, coalesce(sum(has), 0)::BIGINT AS with_rows, round(coalesce(sum(has), 0) / count(*), 6) AS share FROM canon LEFT JOIN h USING (video_id, kf_n) GROUP BY ROLLUP (pack, video_id)""",
    "timeline_report": f"""WITH {CANON}, l AS (SELECT *, lag(pts_time) OVER w AS pt, lag(frame_idx) OVER w AS pf FROM canon WINDOW w AS (PARTITION BY video_id ORDER BY kf_n))
SELECT unnest(['null_time', 'negative', 'time_goes_back', 'frame_goes_back', 'same_frame']) AS code, unnest([count(*) FILTER (pts_time IS NULL), count(*) FILTER (kf_n < 0 OR frame_idx < 0 OR pts_time < 0), count(*) FILTER (pts_time < pt), count(*) FILTER (frame_idx < pf), count(*) FILTER (frame_idx = pf)]) AS n FROM l""",
    "preflight": f"""WITH {CANON}, {SPEECH}, {SCREEN}, a AS (SELECT s.*, c.frame_idx AS cf, c.pts_time AS ct FROM speech s LEFT JOIN canon c ON s.video_id = c.video_id AND s.kf_n = c.kf_n), o AS (SELECT s.*, c.frame_idx AS cf, c.pts_time AS ct FROM screen s LEFT JOIN canon c ON s.video_id = c.video_id AND s.kf_n = c.kf_n)
SELECT 'asr' AS modality, unnest(['null_video', 'null_kf', 'null_frame', 'unknown_key', 'frame_mismatch', 'time_mismatch', 'blank_text', 'null_interval', 'reversed_interval', 'negative_start', 'long_chunk', 'replacement']) AS code,
unnest([count(*) FILTER (video_id IS NULL), count(*) FILTER (kf_n IS NULL), count(*) FILTER (frame_idx IS NULL), count(*) FILTER (video_id IS NOT NULL AND kf_n IS NOT NULL AND cf IS NULL), count(*) FILTER (frame_idx <> cf), count(*) FILTER (abs(pts_time - ct) > 0.01), count(*) FILTER (coalesce(trim(text) = '', true)), count(*) FILTER (start IS NULL OR "end" IS NULL), count(*) FILTER ("end" < start), count(*) FILTER (start < 0), count(*) FILTER ("end" - start > 30), count(*) FILTER (contains(text, chr(65533)))]) AS n FROM a
UNION ALL SELECT 'ocr', unnest(['null_video', 'null_kf', 'null_frame', 'unknown_key', 'frame_mismatch', 'time_mismatch', 'blank_text', 'null_time', 'replacement']),
unnest([count(*) FILTER (video_id IS NULL), count(*) FILTER (kf_n IS NULL), count(*) FILTER (frame_idx IS NULL), count(*) FILTER (video_id IS NOT NULL AND kf_n IS NOT NULL AND cf IS NULL), count(*) FILTER (frame_idx <> cf), count(*) FILTER (abs(pts_time - ct) > 0.01), count(*) FILTER (coalesce(trim(ocr_text) = '', true)), count(*) FILTER (pts_time IS NULL), count(*) FILTER (contains(ocr_text, chr(65533)))]) FROM o""",
    "artifact_scope": f"""WITH {CANON}, {SPEECH}, {SCREEN}, n AS (SELECT count(DISTINCT upper(trim(video_id))) AS al FROM videos), t AS (SELECT 'speech' AS name, count(*) AS rows, count(DISTINCT video_id) AS videos FROM speech UNION ALL SELECT 'screen', count(*), count(DISTINCT video_id) FROM screen UNION ALL SELECT 'keyframes', count(*), count(DISTINCT video_id) FROM canon)
SELECT name, rows, videos, CASE WHEN rows = 0 THEN 'missing' WHEN videos >= al THEN 'global' WHEN videos * 10 < al THEN 'diagnostic' ELSE 'partial' END AS scope FROM t, n""",
    "priority_dedupe": f"WITH {SCREEN} SELECT video_id, kf_n, embedding_row, source_provenance FROM screen WHERE video_id IS NOT NULL AND kf_n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, kf_n ORDER BY source_priority NULLS FIRST, source_provenance NULLS FIRST, embedding_row) = 1",
    "resolve_frames": f"WITH {CANON}, {HITS}, h AS (SELECT DISTINCT video_id, kf_n FROM hits WHERE kf_n IS NOT NULL) SELECT video_id, kf_n, frame_idx, pts_time, frame_idx IS NOT NULL AS found FROM h LEFT JOIN canon USING (video_id, kf_n)",
    "pilot_scope": f"WITH {CANON} SELECT video_id, kf_n FROM canon WHERE pack IN ('L21', 'K01') QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY kf_n) = count(*) OVER (PARTITION BY video_id) // 2 + 1",
    "nearest_frame": f"""WITH {CANON}, {SPEECH}, k AS (SELECT video_id, pts_time, min(kf_n) AS kf_n FROM canon WHERE pts_time IS NOT NULL GROUP BY ALL), s AS (SELECT embedding_row, video_id, (start + "end") / 2 AS mid FROM speech WHERE video_id IS NOT NULL AND "end" >= start)
SELECT embedding_row, arg_min(kf_n, (abs(pts_time - mid), pts_time)) AS kf_n, round(min(abs(pts_time - mid)), 6) AS distance FROM s JOIN k USING (video_id) GROUP BY embedding_row""",
    "interval_context": f"""WITH {CANON}, {SPEECH}, a AS (SELECT g AS anchor, video_id, pts_time AS at_t FROM canon WHERE pts_time IS NOT NULL),
j AS (SELECT anchor, text, row_number() OVER (PARTITION BY anchor ORDER BY embedding_row) AS r FROM a JOIN speech s ON a.video_id = s.video_id AND s."end" >= s.start AND s.start - 15 <= at_t AND s."end" + 15 >= at_t WHERE trim(text) <> '')
SELECT anchor, substring(string_agg(text, ' ' ORDER BY r), 1, 1500) AS context FROM j WHERE r <= 3 GROUP BY anchor""",
    "interval_overlap": f"""WITH {SPEECH}, n AS (SELECT embedding_row, start AS s1, "end" AS e1, lead(start) OVER w AS s2, lead("end") OVER w AS e2 FROM speech WHERE video_id IS NOT NULL AND "end" >= start WINDOW w AS (PARTITION BY video_id ORDER BY start, "end", embedding_row))
SELECT embedding_row, round(greatest(0.0, least(e1, e2) - greatest(s1, s2)), 6) AS overlap, round(greatest(0.0, s2 - e1, s1 - e2), 6) AS gap FROM n WHERE s2 IS NOT NULL""",
    "temporal_neighbors": f"""WITH {CANON}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_time, kf_n) AS pos FROM canon WHERE pts_time IS NOT NULL)
SELECT a.g AS seed, b.g, (b.pos - a.pos)::INTEGER AS offset FROM p a JOIN p b ON a.video_id = b.video_id AND b.pos - a.pos BETWEEN -2 AND 2 AND a.pos <> b.pos""",
    "temporal_consensus": f"""WITH {_FRAMES}, l AS (SELECT g, score, greatest(lag(score, 1) OVER w, lead(score, 1) OVER w, lag(score, 2) OVER w, lead(score, 2) OVER w) AS near FROM fs WINDOW w AS (PARTITION BY video_id ORDER BY pts_time, kf_n))
SELECT g, round(0.7::DOUBLE * score + 0.3::DOUBLE * coalesce(near, score), 6) AS consensus FROM l""",
    "peak_neighbourhoods": f"""WITH {_FRAMES}, pk AS (SELECT video_id, pts_time AS p FROM fs QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, g) <= 2), nr AS (SELECT DISTINCT fs.* FROM fs JOIN pk USING (video_id) WHERE abs(pts_time - p) <= 3),
b AS (SELECT video_id, g, 0.7::DOUBLE * score + 0.3::DOUBLE * max(score) OVER (PARTITION BY video_id ORDER BY pts_time RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS blended FROM nr)
SELECT g, round(blended, 6) AS blended FROM b QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY blended DESC, g) <= 5""",
    "moving_smooth": f"""WITH {_FRAMES}, l AS (SELECT g, score, coalesce(lag(score, 1) OVER w, first_value(score) OVER f) AS a, coalesce(lag(score, 2) OVER w, first_value(score) OVER f) AS b, coalesce(lead(score, 1) OVER w, last_value(score) OVER f) AS c, coalesce(lead(score, 2) OVER w, last_value(score) OVER f) AS d FROM fs WINDOW w AS (PARTITION BY video_id ORDER BY pts_time, kf_n), f AS (PARTITION BY video_id ORDER BY pts_time, kf_n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT g, round((score + a + b + c + d) / 5, 6) AS smoothed FROM l""",
    "gap_sessions": f"""WITH {SCREEN}, s AS (SELECT *, pts_time - lag(pts_time) OVER (PARTITION BY video_id ORDER BY pts_time, embedding_row) AS gap FROM screen WHERE video_id IS NOT NULL AND pts_time IS NOT NULL),
n AS (SELECT *, (sum(CASE WHEN gap > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pts_time, embedding_row ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM s),
g AS (SELECT *, pts_time - lag(pts_time) OVER (PARTITION BY video_id, session ORDER BY pts_time) AS inner_gap FROM n)
SELECT video_id, session, count(*) AS n, min(pts_time) AS first, max(pts_time) AS last, round(greatest(0.0, least(1.0, 1 - coalesce(avg(inner_gap), 0) / 15)), 6) AS density FROM g GROUP BY video_id, session""",
    "ordered_alignment": _MATRIX + _ALIGN_STEPS.format(t="i", p="0.25::DOUBLE", lo="UNBOUNDED PRECEDING"),
    "timed_alignment": _MATRIX + _ALIGN_STEPS.format(t="t", p="(1.0::DOUBLE / 65536)", lo="UNBOUNDED PRECEDING"),
    "gap_alignment": _MATRIX + _ALIGN_STEPS.format(t="i", p="0.25::DOUBLE", lo="10 PRECEDING"),
    "event_division": f"WITH {HITS}, b AS (SELECT video_id, channel, max(score) AS m FROM hits GROUP BY ALL) SELECT video_id, round(sum(m), 6) AS bound FROM b GROUP BY video_id HAVING count(*) = 4",
    "event_shortlist": f"WITH {HITS}, b AS (SELECT video_id, channel, max(score) AS m FROM hits GROUP BY ALL), s AS (SELECT video_id, sum(m) AS bound FROM b GROUP BY video_id), r AS (SELECT *, row_number() OVER (ORDER BY round(bound, 9) DESC, video_id) AS place FROM s) SELECT video_id, round(bound, 6) AS bound, place FROM r WHERE place <= 20",
    "lattice_candidates": f"""WITH {HITS}, h AS (SELECT video_id, channel, kf_n, max(score) AS score FROM hits WHERE kf_n IS NOT NULL GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY video_id, channel ORDER BY kf_n) AS pos, row_number() OVER (PARTITION BY video_id, channel ORDER BY score DESC, kf_n) AS r FROM h)
SELECT a.video_id, a.channel, a.kf_n, CASE WHEN bool_or(a.pos = s.pos) THEN 'seed' ELSE 'neighbor' END AS kind FROM p a JOIN p s ON a.video_id = s.video_id AND a.channel = s.channel AND s.r <= 3 AND abs(a.pos - s.pos) <= 1 GROUP BY ALL""",
    "temporal_relation": f"""WITH {HITS}, b AS (SELECT video_id, channel, count(*) AS n, min(pts_time) AS t FROM (SELECT *, rank() OVER (PARTITION BY video_id, channel ORDER BY score DESC) AS r FROM hits WHERE pts_time IS NOT NULL AND channel IN ('kis', 'qa')) WHERE r = 1 GROUP BY ALL)
SELECT video_id, CASE WHEN a.n = 1 AND c.n = 1 AND a.t < c.t THEN 'before' WHEN a.n = 1 AND c.n = 1 AND a.t > c.t THEN 'after' ELSE 'ambiguous' END AS relation FROM (SELECT * FROM b WHERE channel = 'kis') a FULL JOIN (SELECT * FROM b WHERE channel = 'qa') c USING (video_id)""",
    "event_normalised": f"""WITH {HITS} SELECT result_id, round(CASE WHEN stddev_pop(score) OVER c <= 1e-12 THEN 0.5 ELSE 1 / (1 + exp(-greatest(-60.0, least(60.0, (score - avg(score) OVER c) / stddev_pop(score) OVER c)))) END, 6) AS logistic,
round(0.5::DOUBLE * (CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END + (count(*) OVER w - row_number() OVER (PARTITION BY video_id, channel ORDER BY score DESC, result_id) + 1) / count(*) OVER w), 6) AS norm
FROM hits WINDOW c AS (PARTITION BY channel), w AS (PARTITION BY video_id, channel)""",
    "fused_modalities": f"WITH {HITS}, b AS (SELECT video_id, kf_n, channel, max(score) AS m FROM hits WHERE kf_n IS NOT NULL GROUP BY ALL) SELECT video_id, kf_n, round(sum(CASE channel WHEN 'qa' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * m), 6) AS fused, count(*)::INTEGER AS modalities FROM b GROUP BY ALL",
}
