"""Time: intervals, nearest rows, windows, neighbours, sessions, peaks, sampling and word windows."""

from __future__ import annotations


from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two intervals, at least 0."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two intervals; 0 where they touch."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def distance_to_interval(t: Column, start: Column, end: Column) -> Column:
    """0 inside, else the distance to the nearer end; one end missing: to the other; both: infinity."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    return F.when(a.isNull(), float("inf")).when((t >= a) & (t <= b), 0.0).otherwise(F.least(F.abs(t - a), F.abs(t - b)))


def representative(start: Column, end: Column, pts: Column, strategy: str) -> Column:
    """A record's time: start, end, midpoint or pts_time."""
    return {"start": start, "end": end, "midpoint": (start + end) / 2, "pts_time": pts}[strategy]


def _cells(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")))


def range_join(points: DataFrame, intervals: DataFrame, *, on: str, time: str, start: str, end: str, within: float, width: float | None = None) -> DataFrame:
    """Points with the intervals of the same ``on`` that come within ``within`` seconds (both ends included).

    Both sides meet in time cells as wide as the reach, so the join is an equi-join whose keys stay small however long one
    entity's timeline is. Points and intervals with null or disordered times have no partner.
    """
    width = width or max(2 * within, 1.0)
    p = points.where(F.col(time).isNotNull()).withColumn("_cell", F.floor(F.col(time) / width).cast("long"))
    i = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_cell", _cells(F.col(start) - within, F.col(end) + within, width))
    return p.join(i, [on, "_cell"]).drop("_cell").where((F.col(start) - within <= F.col(time)) & (F.col(end) + within >= F.col(time)))


def nearest_row(left: DataFrame, right: DataFrame, *, on: str, time: str, right_time: str, payload: list[str], earlier_on_tie: bool = True, width: float = 600.0) -> DataFrame:
    """Each left row with the nearest right row of the same ``on``, whatever the distance; ties to the earlier (or the lowest payload).

    Both sides lie in one sorted sequence per time cell of ``width``, to which the last right row of the cells before and the
    first of the cells after are added; the last right row before and the first after are taken by windows that only ever run
    on from the row before, so the work is linear and a long timeline is spread over its cells. From a left time that is
    infinite or NaN all right rows are equally far.
    """
    lcols = left.columns
    r = right.where(F.col(right_time).isNotNull()).groupBy(on, right_time).agg(F.min(F.struct(*payload)).alias("_p"))
    at = F.col(time).cast("double")
    u = left.withColumn("_t", F.when(F.isnan(at) | (F.abs(at) == float("inf")), float("-inf")).otherwise(at)).withColumn("_r", F.lit(None).cast(r.select(F.struct(right_time, "_p")).schema[0].dataType)).withColumn("_l", F.lit(1))
    v = r.select(on, F.col(right_time).cast("double").alias("_t"), F.struct(right_time, "_p").alias("_r"), F.lit(0).alias("_l"))
    # NaN comes last in order, as in the last cell.
    cell = F.when(F.isnan("_t"), F.lit(2**63 - 1)).otherwise(F.floor(F.col("_t") / width).cast("long"))
    both = u.unionByName(v, allowMissingColumns=True).withColumn("_cell", cell)
    cells = both.groupBy(on, "_cell").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.max("_l").alias("_l"))
    by, ahead = W.partitionBy(on), (W.unboundedPreceding, -1)
    earlier, later = F.last("_hi", ignorenulls=True).over(by.orderBy("_cell").rowsBetween(*ahead)), F.last("_lo", ignorenulls=True).over(by.orderBy(F.desc("_cell")).rowsBetween(*ahead))
    ends = cells.select(on, "_cell", "_l", F.array(earlier, later).alias("_x")).where("_l = 1 AND _cell IS NOT NULL").select(on, "_cell", F.explode("_x").alias("_r")).where("_r IS NOT NULL")
    both = both.unionByName(ends.select(on, "_cell", F.col(f"_r.{right_time}").cast("double").alias("_t"), "_r", F.lit(0).alias("_l")), allowMissingColumns=True)
    inside, so_far = W.partitionBy(on, "_cell"), (W.unboundedPreceding, 0)
    before = F.last("_r", ignorenulls=True).over(inside.orderBy("_t", "_l").rowsBetween(*so_far))
    after = F.last("_r", ignorenulls=True).over(inside.orderBy(F.desc("_t"), "_l").rowsBetween(*so_far))
    out = both.withColumn("_b", before).withColumn("_a", after).where("_l = 1")
    db, da = F.abs(F.col("_t") - F.col(f"_b.{right_time}")), F.abs(F.col(f"_a.{right_time}") - F.col("_t"))
    first = (db <= da) if earlier_on_tie else ((db < da) | ((db == da) & (F.col("_b._p") <= F.col("_a._p"))))
    pick = F.when(F.col("_t").isNull(), None).when(F.col("_a").isNull() | (F.col("_b").isNotNull() & first), F.col("_b")).otherwise(F.col("_a"))
    return out.withColumn("_n", pick).select(*lcols, *(F.col(f"_n._p.{p}").alias(f"near_{p}") for p in payload), F.abs(F.col(time) - F.col(f"_n.{right_time}")).alias("distance"))


def context_windows(anchors: DataFrame, rows: DataFrame, *, on: str, anchor: str, time: str, start: str, end: str, text: str, order: str, within: float, most_rows: int, most_chars: int, joint: str = " ") -> DataFrame:
    """(anchor, context): the first ``most_rows`` texts in stored order around each anchor, joined and cut."""
    near = range_join(anchors, rows, on=on, time=time, start=start, end=end, within=within)
    top = near.withColumn("_r", F.row_number().over(W.partitionBy(anchor).orderBy(order))).where(F.col("_r") <= most_rows)
    got = top.groupBy(anchor).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))).alias("x"))
    return got.select(anchor, F.substring(F.array_join(F.transform("x", lambda y: y["t"]), joint), 1, most_chars).alias("context"))


def ordinal(df: DataFrame, *, by: str, order: list[str]) -> DataFrame:
    """``pos``: 0-based place in the order of ``by``."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)


def neighbours(seeds: DataFrame, frames: DataFrame, *, by: str, id: str, order: list[str], radius: int) -> DataFrame:
    """(seed, id, offset): the frames 1 to ``radius`` places before and after each seed, every offset included."""
    placed = ordinal(frames, by=by, order=order).select(by, id, "pos")
    at = seeds.select(by, F.col(id).alias("seed")).join(placed.withColumnRenamed(id, "seed"), [by, "seed"])
    steps = F.explode(F.array(*[F.lit(x) for x in range(-radius, radius + 1) if x]))
    asked = at.withColumn("offset", steps).select(by, "seed", "offset", (F.col("pos") + F.col("offset")).alias("pos"))
    return asked.join(placed, [by, "pos"]).select(by, "seed", id, "offset")


def consensus(frames: DataFrame, *, by: list[str], order: list[str], score: str, weight: float = 0.3, radius: int = 2) -> DataFrame:
    """(1 - w) * own score + w * best of the neighbours within ``radius``; a lone frame keeps its score."""
    w = W.partitionBy(*by).orderBy(*order)
    near = F.greatest(*[f(score, i).over(w) for i in range(1, radius + 1) for f in (F.lag, F.lead)])
    return frames.withColumn("consensus", (1 - weight) * F.col(score) + weight * F.coalesce(near, F.col(score)))


def around_peaks(frames: DataFrame, *, by: list[str], time: str, score: str, id: str, peaks: int = 2, radius: int = 3, k: int = 5) -> DataFrame:
    """Frames within ``radius`` seconds of the best ``peaks``; 0.7 * own + 0.3 * best within the radius; the ``k`` best."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), id))
    top = frames.withColumn("_r", r).where(F.col("_r") <= peaks).select(*by, F.col(time).alias("_peak"))
    near = frames.join(top, by).where(F.abs(F.col(time) - F.col("_peak")) <= radius).drop("_peak").distinct()
    local = F.max(score).over(W.partitionBy(*by).orderBy(F.col(time).cast("double")).rangeBetween(-int(radius), int(radius)))
    out = near.withColumn("blended", 0.7 * F.col(score) + 0.3 * local)
    return out.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("blended"), id))).where(F.col("place") <= k)


def sessions(df: DataFrame, *, by: str, time: str, order: list[str], gap: float) -> DataFrame:
    """``session``: 0-based number of the cluster; a new one begins where the gap is strictly larger."""
    w = W.partitionBy(by).orderBy(time, *order)
    new = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def density(df: DataFrame, *, by: list[str], time: str, gap: float = 15.0) -> DataFrame:
    """Per cluster: 1 - mean gap / ``gap``, within [0, 1]; 1 for a single row."""
    g = F.col(time) - F.lag(time).over(W.partitionBy(*by).orderBy(time))
    return df.withColumn("_g", g).groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.avg("_g"), F.lit(0.0)) / gap)).alias("density"))


def smooth(df: DataFrame, *, by: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Moving average with the edge values repeated."""
    half = width // 2
    w = W.partitionBy(*by).orderBy(*order)
    first, last = F.first(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = [F.col(value)] + [F.coalesce(F.lag(value, i).over(w), first) for i in range(1, half + 1)] + [F.coalesce(F.lead(value, i).over(w), last) for i in range(1, half + 1)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("smoothed", total / width)


def is_ordered(times: Column, strict: bool = True) -> Column:
    """Whether an array of times ascends."""
    pairs = F.zip_with(F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: (a < b) if strict else (a <= b))
    return F.forall(pairs, lambda x: x)


def _stream_sorted(df: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """Rows hashed by ``keys`` and sorted by keys and order, handed to ``step`` batch by batch: a task holds a batch and a state, never a group."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(step, schema)


def sample_by_interval(df: DataFrame, *, by: str, time: str, id: str, interval: float, most: int | None = None) -> DataFrame:
    """(by, id, time): a row is kept if it lies at least ``interval`` after the last kept one; then at most ``most`` evenly spaced.

    The greedy walk streams through each timeline in order; its only state is the last kept time.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = None, None
        for pdf in batches:
            keep = []
            for v, t in zip(pdf[by], pdf[time]):
                if v != who:
                    who, last = v, None
                keep.append(last is None or t - last >= interval)
                last = t if keep[-1] else last
            yield pdf[keep]

    types = dict(df.dtypes)
    rows = df.where(F.col(time).isNotNull() & F.col(by).isNotNull()).select(by, id, F.col(time).cast("double").alias(time))
    kept = _stream_sorted(rows, [by], [time, id], walk, f"{by} {types[by]}, {id} {types[id]}, {time} double")
    if not most:
        return kept
    n, at = F.count("*").over(W.partitionBy(by)), F.row_number().over(W.partitionBy(by).orderBy(time, id)) - 1
    kept = kept.withColumn("_n", n).withColumn("_at", at)
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(most - 1, 1))).cast("int"))
    return kept.where((F.col("_n") <= most) | F.array_contains(places, F.col("_at"))).drop("_n", "_at")


def peaks(df: DataFrame, *, by: list[str], kf: str, time: str, score: str, most: int = 5, gap_kf: int = 3, gap_s: float = 2.0) -> DataFrame:
    """Greedy suppression in score order: a frame stays if it is ``gap_kf`` keyframes and ``gap_s`` seconds from all kept; at most ``most``."""
    got = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(kf).alias("k"), F.col(time).alias("t")))).alias("x"))
    far = lambda a, r: F.forall(a, lambda q: (F.abs(q["k"] - r["k"]) >= gap_kf) & (F.abs(q["t"] - r["t"]) >= gap_s))
    walk = F.aggregate("x", F.slice("x", 1, 0), lambda a, r: F.when((F.size(a) < most) & far(a, r), F.concat(a, F.array(r))).otherwise(a))
    return got.select(*by, F.posexplode(walk).alias("place", "r")).select(*by, (F.col("place") + 1).alias("place"), F.col("r.k").alias(kf), F.col("r.t").alias(time), (-F.col("r.s")).alias(score))


def diversify(df: DataFrame, *, by: list[str], id: str, time: str, score: str, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: weight * score + (1 - weight) * distance in time to the nearest chosen frame over the span; ``k`` per group of a shortlist."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id], ascending=[False, True]).reset_index(drop=True)
        span = max(float(pdf[time].max() - pdf[time].min()), 1e-9)
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            gap = pd.Series(1.0, index=pdf.index) if not chosen else pd.concat([(pdf[time] - pdf[time][c]).abs() / span for c in chosen], axis=1).min(axis=1)
            chosen.append(int((weight * pdf[score] + (1 - weight) * gap).drop(chosen).idxmax()))
        out = pdf.loc[chosen, [*by, id, score]]
        return out.assign(place=range(1, len(out) + 1))

    types = dict(df.dtypes)
    return df.select(*by, id, time, score).groupBy(*by).applyInPandas(pick, ", ".join(f"{c} {types[c]}" for c in [*by, id, score]) + ", place int")


def word_windows(words: DataFrame, *, by: str, word: str, start: str, end: str, target: float = 8.0, least: float = 6.0, overlap: float = 2.0, gap: float = 2.0) -> DataFrame:
    """(by, chunk, start, end, text): words gathered until the next would pass ``target`` seconds or lies behind a ``gap``; a window may end at a
    sentence end once it has ``least`` seconds; the next begins at the first word at or after the end less the ``overlap``."""

    def close(w: list, a: list, b: list) -> Iterator[tuple]:
        i = 0
        while i < len(w):
            j = i
            while j + 1 < len(w) and b[j + 1] - a[i] <= target and not (b[j] - a[i] >= least and str(w[j])[-1:] in ".!?…"):
                j += 1
            yield a[i], b[j], " ".join(map(str, w[i : j + 1]))
            if j + 1 >= len(w):
                return
            i = next((n for n in range(i + 1, j + 1) if a[n] >= b[j] - overlap), j + 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, w, a, b = None, [], [], []
        for pdf in batches:
            out = []
            for v, x, s, e in zip(pdf[by], pdf[word], pdf[start], pdf[end]):
                # No window reaches over a gap, so what lies between two gaps is done with at once.
                if w and (v != who or s - b[-1] > gap):
                    out += [(who, *r) for r in close(w, a, b)]
                    w, a, b = [], [], []
                who = v
                w.append(x)
                a.append(s)
                b.append(e)
                if len(w) >= 4096:  # a long stretch: all but its last window are final
                    *done, _ = close(w, a, b)
                    out += [(who, *r) for r in done[:-1]]
                    cut = next(n for n in range(len(a)) if a[n] >= done[-1][0])
                    w, a, b = w[cut:], a[cut:], b[cut:]
            yield pd.DataFrame(out, columns=[by, start, end, "text"])
        if w:
            yield pd.DataFrame([(who, *r) for r in close(w, a, b)], columns=[by, start, end, "text"])

    kind = dict(words.dtypes)[by]
    rows = words.where(F.col(by).isNotNull() & F.col(start).isNotNull() & (F.col(end) >= F.col(start)) & F.col(word).isNotNull()).select(by, word, start, end)
    out = _stream_sorted(rows, [by], [start, end], walk, f"{by} {kind}, {start} double, {end} double, text string")
    return out.withColumn("chunk", F.row_number().over(W.partitionBy(by).orderBy(start, end)) - 1)


def provider_words(payload: DataFrame, *, id: str, json: str) -> DataFrame:
    """(id, word, start, end) of a speech provider's JSON: channels, alternatives, words; punctuated words where there are some."""
    schema = "results struct<channels: array<struct<alternatives: array<struct<words: array<struct<word: string, punctuated_word: string, start: double, `end`: double>>>>>>>"
    w = payload.select(id, F.explode(F.get(F.get(F.from_json(json, schema)["results"]["channels"], F.lit(0))["alternatives"], F.lit(0))["words"]).alias("w"))
    return w.select(id, F.coalesce("w.punctuated_word", "w.word").alias("word"), "w.start", "w.end")


def provider_utterances(payload: DataFrame, *, id: str, json: str) -> DataFrame:
    """(id, text, start, end) of a speech provider's utterances, repeated ones once."""
    schema = "results struct<utterances: array<struct<transcript: string, start: double, `end`: double>>>"
    u = payload.select(id, F.explode(F.from_json(json, schema)["results"]["utterances"]).alias("u"))
    return u.select(id, F.col("u.transcript").alias("text"), "u.start", "u.end").where("text IS NOT NULL").dropDuplicates([id, "start", "end", "text"])


def best_in_reach(frames: DataFrame, scored: DataFrame, *, on: str, frame: str, time: str, start: str, end: str, score: str, within: float = 60.0) -> DataFrame:
    """(frame, score): the best score of the intervals within reach of every frame, 0 where there are none."""
    got = range_join(frames.select(on, frame, time), scored, on=on, time=time, start=start, end=end, within=within).groupBy(frame).agg(F.max(score).alias(score))
    return frames.select(frame).distinct().join(got, frame, "left").withColumn(score, F.coalesce(score, F.lit(0.0)))
