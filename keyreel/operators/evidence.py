"""Evidence packets, claims and verification of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.functions.text import acronyms, content_tokens, fold, is_non_answer, numbers, numeric_anchors, proper_spans, quoted_spans, squeeze, tokens
from keyreel.operators.temporal import distance_to_interval, range_join


def select_rows(anchors: DataFrame, rows: DataFrame, *, anchor: str, on: str, time: str, query: str, start: str, end: str, text: str, row: str, within: float, limit: int) -> DataFrame:
    """Per anchor the ``limit`` rows within reach with the largest word overlap with the query, then the nearest, then the lowest; ``place`` is their order in time."""
    near = range_join(anchors, rows, on=on, time=time, start=start, end=end, within=within)
    shared = F.size(F.array_intersect(F.array_distinct(tokens(query)), F.array_distinct(tokens(text))))
    near = near.withColumn("overlap", shared).withColumn("distance", distance_to_interval(F.col(time), F.col(start), F.col(end)))
    top = near.withColumn("_r", F.row_number().over(W.partitionBy(anchor).orderBy(F.desc("overlap"), "distance", row))).where(F.col("_r") <= limit)
    return top.withColumn("place", F.row_number().over(W.partitionBy(anchor).orderBy(start, row))).drop("_r")


def modality_status(anchors: DataFrame, covered: DataFrame, silent: DataFrame, matched: DataFrame, *, on: str, anchor: str, none: str) -> DataFrame:
    """(anchor, status): coverage_missing, ``none`` (covered and known to have no rows), no_match or matched."""
    a = anchors.select(anchor, on)
    flag = lambda d, c, k: d.select(k).distinct().withColumn(c, F.lit(True))
    j = a.join(flag(covered, "_c", on), on, "left").join(flag(silent, "_s", on), on, "left").join(flag(matched, "_m", anchor), anchor, "left")
    return j.select(anchor, F.when(F.col("_m"), "matched").when(F.col("_s"), none).when(F.col("_c"), "no_match").otherwise("coverage_missing").alias("status"))


def packets(anchors: DataFrame, speech: DataFrame, screen: DataFrame, *, anchor: str) -> DataFrame:
    """One row per anchor with arrays of its speech rows and screen rows, in time order, and the sources that gave any."""
    def gather(d: DataFrame, name: str, cols: list[str]) -> DataFrame:
        return d.groupBy(anchor).agg(F.array_sort(F.collect_list(F.struct("place", *cols))).alias(name))

    j = anchors.join(gather(speech, "speech", ["start", "end", "text"]), anchor, "left").join(gather(screen, "screen", ["pts_time", "text"]), anchor, "left")
    sources = F.filter(F.array(F.when(F.size("speech") > 0, "asr"), F.when(F.size("screen") > 0, "ocr")), lambda x: x.isNotNull())
    return j.withColumn("sources", F.concat(F.array(F.lit("visual")), sources))


def attach_frames(anchors: DataFrame, pool: DataFrame, *, anchor: str, on: str, time: str, within: float = 20.0, limit: int = 3) -> DataFrame:
    """Up to ``limit`` pool frames (``on``, p_time, p_kf, origin, p_score) near each anchor: specialist, temporal, visual; then distance, score, keyframe."""
    near = range_join(anchors, pool.withColumn("_e", F.col("p_time")), on=on, time=time, start="p_time", end="_e", within=within).drop("_e")
    kind = F.when(F.col("origin") == "specialist", 0).when(F.col("origin") == "temporal", 1).otherwise(2)
    order = [kind, F.abs(F.col("p_time") - F.col(time)), F.desc("p_score"), F.asc("p_kf")]
    return near.withColumn("place", F.row_number().over(W.partitionBy(anchor).orderBy(*order))).where(F.col("place") <= limit)


def claims(queries: DataFrame, *, id: str, text: str, most: int = 6) -> DataFrame:
    """(id, claim, kind, threshold): quotes of three words or more (.8), acronyms (1), named entities (2/3), measured numbers (1); at most ``most``."""
    one = lambda arr, kind, order, limit: F.transform(arr, lambda x: F.struct(F.lit(order).alias("o"), x.alias("claim"), F.lit(kind).alias("kind"), F.lit(limit).alias("threshold")))
    quotes = F.filter(quoted_spans(text), lambda q: F.size(tokens(q)) >= 3)
    parts = F.concat(one(quotes, "quote", 0, 0.8), one(acronyms(text), "acronym", 1, 1.0), one(numeric_anchors(text), "numeric", 2, 1.0), one(proper_spans(text, 2), "entity", 3, 2 / 3))
    return queries.select(id, F.posexplode(F.slice(parts, 1, most)).alias("n", "c")).select(id, "n", "c.claim", "c.kind", "c.threshold")


def claim_score(kind: Column, claim: Column, evidence: Column) -> Column:
    """Acronym: as a word; quote: containment or token share; number: the number and then the other words; entity: token share."""
    a, b = F.array_distinct(tokens(claim)), F.array_distinct(tokens(evidence))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    inside = F.instr(F.array_join(tokens(evidence), " "), F.array_join(tokens(claim), " ")) > 0
    digit = F.arrays_overlap(numbers(claim), numbers(evidence))
    return F.when(kind == "acronym", F.array_contains(b, fold(claim)).cast("double")).when(kind == "numeric", F.when(digit, share).otherwise(0.0)).when(inside, 1.0).otherwise(share)


def claim_division(scored: DataFrame, wanted: DataFrame, *, query: str, video: str) -> DataFrame:
    """(query, video): videos in which every claim of the query reaches its threshold."""
    need = wanted.groupBy(query).agg(F.countDistinct("n").alias("need"))
    met = scored.where("score >= threshold").groupBy(query, video).agg(F.countDistinct("n").alias("met"))
    return met.join(need, query).where("met = need").select(query, video)


def answer_score(answer: Column, evidence: Column) -> Column:
    """Containment 1; same numbers 0.9; subset of the words 0.8; five words or more of which 80 % are there 0.8; else 0."""
    a, b = content_tokens(answer), content_tokens(evidence)
    inside = (F.size(a) > 0) & (F.instr(squeeze(fold(evidence)), squeeze(fold(answer))) > 0)
    num = (F.size(numbers(answer)) > 0) & (F.size(F.array_except(numbers(answer), numbers(evidence))) == 0)
    left = F.size(F.array_except(a, b))
    return F.when(F.size(a) == 0, F.when(inside, 1.0).otherwise(0.0)).when(inside, 1.0).when(num & (left == 0), 0.9).when(left == 0, 0.8).when((F.size(a) >= 5) & (left <= 0.2 * F.size(a)), 0.8).otherwise(0.0)


def support(answer: Column, evidence: Column) -> Column:
    """0 for an unsafe answer or no text, 1 if any word is shared, else 0.25."""
    shared = F.arrays_overlap(content_tokens(answer), content_tokens(evidence))
    return F.when(is_non_answer(answer) | F.coalesce(squeeze(evidence) == "", F.lit(True)), 0.0).when(shared, 1.0).otherwise(0.25)


def verify(answers: DataFrame, evidence: DataFrame, *, id: str, answer: str, required: str) -> DataFrame:
    """(id, support, verdict): unsafe, unavailable (a required source gave nothing), unsupported or accepted. Evidence: (id, source, text)."""
    score = evidence.join(answers.select(id, answer), id).withColumn("s", answer_score(F.col(answer), F.col("text")))
    per = score.groupBy(id).agg(F.max("s").alias("support"), F.collect_set(F.when(F.col("s") > 0, F.col("source"))).alias("good"), F.collect_set("source").alias("there"))
    j = answers.join(per, id, "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    none = F.array().cast("array<string>")
    lacks = lambda have: F.size(F.array_except(F.col(required), F.coalesce(have, none))) > 0
    verdict = F.when(is_non_answer(answer), "unsafe").when(lacks(F.col("there")), "unavailable").when((F.col("support") == 0) | lacks(F.col("good")), "unsupported").otherwise("accepted")
    return j.select(id, "support", verdict.alias("verdict"))


def role_rows(rows: DataFrame, anchors: DataFrame, *, on: str, query: str) -> DataFrame:
    """Rows that may tell the role asked for near a strong anchor: from 120 s before to 60 s after and in the first 90 s, scored, at least .55, three per anchor."""
    lo, hi = F.greatest(F.lit(0.0), F.col("anchor_time") - 120), F.least(F.lit(90.0), F.col("anchor_time") + 60)
    j = rows.join(anchors.where("strength >= 0.8"), on).where((F.col("pts_time") >= lo) & (F.col("pts_time") <= hi))
    f = fold("text")
    cue = f.rlike("\\b(chu tich|giam doc|bo truong|pgs|gs|ts|bs|president|director|minister|doctor|professor)\\b").cast("double")
    named = (F.size(proper_spans("text", 2)) > 0).cast("double")
    shared = F.least(F.lit(1.0), F.size(F.array_intersect(content_tokens("text"), content_tokens(query))) / 3.0)
    near = 1 - F.least(F.lit(1.0), F.abs(F.col("pts_time") - F.col("anchor_time")) / 120)
    short = (F.length("text") <= 120).cast("double")
    scored = j.withColumn("score", 0.42 * cue + 0.18 * named + 0.22 * shared + 0.10 * near + 0.08 * short).where("score >= 0.55")
    return scored.withColumn("place", F.row_number().over(W.partitionBy("anchor").orderBy(F.desc(F.round("score", 9)), "pts_time", "kf_n"))).where("place <= 3")


def decide(required_hit: Column, available: Column, baseline: Column) -> Column:
    """State of a specialist flow: success, no_hit, degraded or failed."""
    return F.when(available & required_hit, "success").when(available, "no_hit").when(baseline, "degraded").otherwise("failed")


def select_at_anchors(anchors: DataFrame, rows: DataFrame, *, anchor: str, on: str, times: str, query: str, start: str, end: str, text: str, row: str, within: float, limit: int) -> DataFrame:
    """Rows chosen around each of several times of an anchor, united, repeats of (start, end, text) dropped, the ``limit`` first in time."""
    each = anchors.select(anchor, on, query, F.posexplode(F.array_distinct(times)).alias("_i", "_t")).withColumn("_a", F.struct(anchor, "_i"))
    got = select_rows(each, rows, anchor="_a", on=on, time="_t", query=query, start=start, end=end, text=text, row=row, within=within, limit=limit)
    once = got.groupBy(F.col(f"_a.{anchor}").alias(anchor), start, end, text).agg(F.min(row).alias(row))
    return once.withColumn("place", F.row_number().over(W.partitionBy(anchor).orderBy(start, text, row))).where(F.col("place") <= limit)


def best_claim_rows(scored: DataFrame, *, by: list[str], row: str) -> DataFrame:
    """Per claim and modality the row with the highest score that reaches the claim's threshold, ties to the lower row."""
    ok = scored.where("score >= threshold")
    return ok.groupBy(*by).agg(F.max(F.struct("score", (-F.col(row)).alias("o"))).alias("b")).select(*by, F.col("b.score").alias("score"), (-F.col("b.o")).alias(row))


def verify_claims(answers: DataFrame, claims_met: DataFrame, evidence: DataFrame, *, id: str, answer: str) -> DataFrame:
    """(id, verdict): claims_open, answer_unsupported (no row beside the claims' own speaks for it) or verified. ``claims_met``: (id, met); ``evidence``: (id, text, is_claim)."""
    s = evidence.join(answers.select(id, answer), id).withColumn("s", F.when(~F.col("is_claim"), answer_score(F.col(answer), F.col("text"))).otherwise(0.0)).groupBy(id).agg(F.max("s").alias("s"))
    open_ = claims_met.groupBy(id).agg(F.bool_and("met").alias("met"))
    j = answers.join(open_, id, "left").join(s, id, "left")
    return j.select(id, F.when(~F.coalesce("met", F.lit(True)), "claims_open").when(F.coalesce("s", F.lit(0.0)) == 0, "answer_unsupported").otherwise("verified").alias("verdict"))


def context_support(clusters: DataFrame, rows: DataFrame, *, on: str, cluster: str, first: str, last: str, query: str) -> DataFrame:
    """(cluster, support): the best row (pts_time, text, kf_n) within 60 s before or after: direction * (.65 word coverage + .35 nearness), after counts .92."""
    r = rows.withColumn("_e", F.col("pts_time"))
    near = range_join(r, clusters, on=on, time="pts_time", start=first, end=last, within=60.0).where((F.col("pts_time") < F.col(first)) | (F.col("pts_time") > F.col(last)))
    want = F.array_distinct(tokens(query))
    cover = F.size(F.array_intersect(want, F.array_distinct(tokens("text")))) / F.greatest(F.size(want), F.lit(1))
    before = F.col("pts_time") < F.col(first)
    gap = F.when(before, F.col(first) - F.col("pts_time")).otherwise(F.col("pts_time") - F.col(last))
    return near.withColumn("_s", F.when(before, 1.0).otherwise(0.92) * (0.65 * cover + 0.35 * (1 - gap / 60))).groupBy(cluster).agg(F.max("_s").alias("support"))


def verse_events(rows: DataFrame, context: DataFrame, *, query: Column, gap: float = 15.0, per_video: int = 4) -> DataFrame:
    """Clusters of at least two short verse-like lines (video_id, pts_time, text, kf_n) with words of the query near them: score .55 verse, .20 size, .15 density, .10 context."""
    from keyreel.operators.temporal import density, sessions

    words = F.size(tokens("text"))
    verse = F.when(words.between(4, 10) & ~F.col("text").rlike("\\d"), 1.0).when(words.between(3, 12), 0.5).otherwise(0.0)
    lines = rows.where(F.col("pts_time").isNotNull() & F.col("video_id").isNotNull()).withColumn("verse", verse).where("verse > 0")
    c = sessions(lines, by="video_id", time="pts_time", order=["kf_n"], gap=gap).withColumn("cluster", F.concat_ws("#", "video_id", "session"))
    size = c.groupBy("video_id", "cluster").agg(F.count("*").alias("n"), F.avg("verse").alias("verse"), F.min("pts_time").alias("first"), F.max("pts_time").alias("last")).where("n >= 2")
    near = context_support(size.withColumn("_q", query), context, on="video_id", cluster="cluster", first="first", last="last", query="_q")
    j = size.join(density(c, by=["cluster"], time="pts_time", gap=gap), "cluster").join(near, "cluster", "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    scored = j.withColumn("score", 0.55 * F.col("verse") + 0.20 * F.least(F.lit(1.0), F.col("n") / 4.0) + 0.15 * F.col("density") + 0.10 * F.col("support"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc(F.round("score", 9)), "first"))).where(F.col("place") <= per_video)
