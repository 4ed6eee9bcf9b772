"""Ordered alignment of event sequences with frames, as chained window stages, and what belongs to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def align(scores: DataFrame, *, by: list[str], time: str, frame: str, events: list[str], penalty: float, axis: str = "time", max_gap: int | None = None) -> DataFrame:
    """(by, score, path): one strictly later frame per event with the largest sum of scores less ``penalty`` times the time between.

    ``scores`` has a row per frame with a column per event; null means that the frame can't show the event. ``axis`` 'index'
    counts frames instead of seconds. Ties go to the earliest frames. All stages share one partitioning: one shuffle and one
    sort, however many events. Groups without a full alignment have no row. ``max_gap`` bounds the frames between two events.
    """
    order = W.partitionBy(*by).orderBy(time, frame)
    rows = scores.where(F.col(time).isNotNull()).withColumn("_i", F.row_number().over(order).cast("double"))
    t = F.col("_i") if axis == "index" else F.col(time).cast("double")
    before = order.rowsBetween(W.unboundedPreceding if max_gap is None else -max_gap, -1)
    rows = rows.withColumn("_dp", F.col(events[0]).cast("double")).withColumn("_path", F.array(frame))
    for e in events[1:]:
        reach = F.when(F.col("_dp").isNotNull() & ~F.isnan("_dp"), F.struct((F.col("_dp") + penalty * t).alias("x"), (-F.col("_i")).alias("o"), F.col("_path").alias("p")))
        rows = rows.withColumn("_b", F.max(reach).over(before))
        rows = rows.withColumn("_dp", F.col(e) + F.col("_b.x") - penalty * t).withColumn("_path", F.concat("_b.p", F.array(frame))).drop("_b")
    end = rows.where(F.col("_dp").isNotNull() & ~F.isnan("_dp")).groupBy(*by).agg(F.max(F.struct(F.col("_dp").alias("s"), (-F.col("_i")).alias("o"), F.col("_path").alias("p"))).alias("b"))
    return end.select(*by, F.col("b.s").alias("score"), F.col("b.p").alias("path"))


def normalise_events(c: str, by: list[str]) -> Column:
    """z-score of the finite scores, cut at 60, through the logistic function; 0.5 where they don't vary."""
    w = W.partitionBy(*by)
    z = (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)
    return F.when(F.col(c).isNull(), None).when(F.stddev_pop(c).over(w) <= 1e-12, 0.5).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z)))))


def sequence_quality(scores: Column, times: Column, *, coverage: float = 0.25, coherence: float = 0.1) -> Column:
    """Mean + coverage * geometric mean + coherence / (1 + variation of the gaps); gaps that aren't positive give no coherence."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    geo = F.exp(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.log(F.greatest(x, F.lit(1e-12)))) / n)
    gaps = F.zip_with(F.slice(times, 1, F.greatest(n - 1, F.lit(0))), F.slice(times, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a)
    g = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / (n - 1)
    var = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + (x - g) * (x - g)) / (n - 1)
    coh = F.when(n < 2, 1.0).when(F.exists(gaps, lambda x: x <= 0), 0.0).otherwise(1 / (1 + F.sqrt(var) / g))
    return mean + coverage * geo + coherence * coh


def adaptive_penalty(frames: Column, events: int) -> Column:
    """0 where there are more than eight frames per event, else 0.001."""
    return F.when(frames > 8 * events, 0.0).otherwise(0.001)


def lattice(scores: DataFrame, *, by: list[str], event: str, frame: str, score: str, pos: str, top_k: int = 5, radius: int = 1) -> DataFrame:
    """(by, event, frame, kind): the ``top_k`` frames of each event ('seed') and the frames within ``radius`` places ('neighbor')."""
    r = F.row_number().over(W.partitionBy(*by, event).orderBy(F.desc(score), frame))
    seed = scores.withColumn("_r", r).where(F.col("_r") <= top_k).select(*by, event, F.col(pos).alias("_s"), F.explode(F.sequence(F.col(pos) - radius, F.col(pos) + radius)).alias("_p"))
    near = seed.groupBy(*by, event, "_p").agg(F.max((F.col("_p") == F.col("_s")).cast("int")).alias("_own"))
    return scores.join(near.withColumnRenamed("_p", pos), [*by, event, pos]).select(*by, event, frame, score, F.when(F.col("_own") == 1, "seed").otherwise("neighbor").alias("kind"))


def shortlist(scores: DataFrame, *, by: list[str], video: str, event: str, score: str, k: int) -> DataFrame:
    """The ``k`` videos with the largest sum over the events of their best score: an upper bound of any alignment."""
    top = scores.groupBy(*by, video, event).agg(F.max(score).alias("m")).groupBy(*by, video).agg(F.sum("m").alias("bound"))
    w = W.partitionBy(*by).orderBy(F.desc(F.round("bound", 9)), video) if by else W.orderBy(F.desc(F.round("bound", 9)), video)
    return top.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def covering(evidence: DataFrame, *, by: list[str], event: str, needed: int) -> DataFrame:
    """Groups with evidence for every event (relational division)."""
    return evidence.groupBy(*by).agg(F.countDistinct(event).alias("n")).where(F.col("n") == needed).select(*by)


def fuse_modalities(hits: DataFrame, *, by: list[str], modality: str, score: str, weights: dict[str, float]) -> DataFrame:
    """Per group the best score of each modality, weighted and summed, with the evidence."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(modality)], F.lit(1.0))
    best = hits.groupBy(*by, modality).agg(F.max(score).alias(score))
    return best.groupBy(*by).agg(F.sum(w * F.col(score)).alias("fused"), F.array_sort(F.collect_list(F.struct(modality, score))).alias("evidence"))


def event_hit_norm(hits: DataFrame, *, by: list[str], score: str, key: str) -> DataFrame:
    """Half minmax, half (n - rank) / n within (event, modality)."""
    w = W.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    mm = F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0)
    r = F.row_number().over(w.orderBy(F.desc(score), key)) - 1
    return hits.withColumn("norm", 0.5 * (mm + (F.count("*").over(w) - r) / F.count("*").over(w)))


def path_score(quality: Column, support: Column, *, events: int) -> Column:
    """.45 mean + .20 least + .15 min(1, support / 3) + .10 (1 - deviation) + .10 share of supported events, of an array of qualities."""
    n = F.lit(float(events))
    mean = F.aggregate(quality, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(quality, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    held = F.aggregate(support, F.lit(0.0), lambda a, x: a + F.least(F.lit(1.0), x / 3.0)) / n
    multi = F.aggregate(support, F.lit(0.0), lambda a, x: a + F.when(x > 1, 1.0).otherwise(0.0)) / n
    return 0.45 * mean + 0.20 * F.array_min(quality) + 0.15 * held + 0.10 * (1 - F.sqrt(var)) + 0.10 * multi


def valid_path(frames: Column, times: Column, events: int) -> Column:
    """Length, strictly ascending frames and times."""
    from keyreel.operators.temporal import is_ordered

    return (F.size(frames) == events) & (F.size(times) == events) & is_ordered(frames) & is_ordered(times)


def events_of(queries: DataFrame, *, id: str, events: str) -> DataFrame:
    """(id, event, text): 0-based events of an array or of JSON, '|' or line separated text; blank ones are dropped and the rest renumbered."""
    kind = dict(queries.dtypes)[events]
    parts = F.col(events) if kind.startswith("array") else F.coalesce(F.from_json(events, "array<string>"), F.split(events, "\\s*[|\\n]\\s*"))
    clean = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "^\\s*(?:E|event)?\\s*\\d+\\s*[:.)]\\s*", ""))), lambda x: x != "")
    return queries.select(id, F.posexplode(clean).alias("event", "text"))


def relation(first: DataFrame, second: DataFrame, *, by: str, time: str, score: str) -> DataFrame:
    """(by, relation): 'before' or 'after' from the uniquely best evidence of each event; tied or missing evidence gives 'ambiguous'."""

    def unique(d: DataFrame, name: str) -> DataFrame:
        r = F.rank().over(W.partitionBy(by).orderBy(F.desc(score)))
        return d.withColumn("_r", r).where("_r = 1").groupBy(by).agg(F.count("*").alias(f"{name}_n"), F.min(time).alias(f"{name}_t"))

    both = unique(first, "a").join(unique(second, "b"), by, "full")
    said = F.when((F.col("a_n") == 1) & (F.col("b_n") == 1) & (F.col("a_t") != F.col("b_t")), F.when(F.col("a_t") < F.col("b_t"), "before").otherwise("after"))
    return both.select(by, F.coalesce(said, F.lit("ambiguous")).alias("relation"))
