"""References to records that do not exist: pending-orphan state, kept incrementally.

A tracker holds two keyed states as tables to which every period appends: the log of the parents' comings and goings, and
the log of what became of the orphans (references that did not resolve when they arrived). A step takes the references and
the parent events of one period: new references probe the parent index, arriving parents resolve waiting orphans, deletions
close a parent's spell, so that later references are orphans again, and reopen what it had resolved. Only orphans whose key
an event of the period names are judged again; all others keep the state they have.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.session import checkpoint_dir, cut_table, delete_at_exit, state_join, table, tidy_id

KEY = ["ref_field", "video", "val"]
#: What an orphan can be.
NEVER, REMOVED, LATER = "never_there", "removed", "arrived_later"
_FATE = ["status", "resolved_at", "reopened_at"]


def _spells(events: DataFrame) -> DataFrame:
    """(KEY, spells, first_gone): per key its spells (from_t, to_t), and the first going that named none of them.

    A spell ends at the latest end known for it, or at the first later going that names no spell, if that is earlier. Of a
    key there are as many spells as it came, not as many as references name it.
    """
    came = events.where("from_t IS NOT NULL").groupBy(*KEY, "from_t").agg(F.max("to_t").alias("to_t"))
    came = came.select(*KEY, F.struct("from_t", "to_t").alias("s"), F.lit(None).cast("timestamp").alias("g"))
    went = events.where("from_t IS NULL AND to_t IS NOT NULL").select(*KEY, F.lit(None).cast("struct<from_t:timestamp,to_t:timestamp>").alias("s"), F.col("to_t").alias("g"))
    both = came.unionByName(went).groupBy(*KEY).agg(F.collect_list("s").alias("s"), F.collect_set("g").alias("g"))
    ended = F.transform("s", lambda s: F.struct(s["from_t"].alias("from_t"), F.least(s["to_t"], F.array_min(F.filter("g", lambda g: g > s["from_t"]))).alias("to_t")))
    return both.select(*KEY, ended.alias("spells"), F.array_min("g").alias("first_gone"))


@dataclass
class OrphanTracker:
    """State of one kind of reference, in the folder ``folder``, one part per period; a tracker made anew on the folder goes on where the last one ended.

    References are rows (``KEY``, t, ``ids``), parent events rows (``KEY``, from_t, to_t): (from_t, null) a coming, (null,
    to_t) a going, (from_t, to_t) a going that names the spell it ends, whether or not its coming is known. A reference at
    time t resolves if some spell has from_t <= t and to_t null or > t. A going without a spell ends all that are open then. Rows with a null key
    field, and references without a time, are no cases; repeated events change nothing. A step that is run again under its
    number replaces what it had written. The orphans after the last step do not depend on how the log is cut into periods,
    as long as each event is in the period of its time or an earlier one; an event that comes late counts from its own time
    on for the references of its period and later ones, and for all orphans.
    """

    spark: SparkSession
    ids: dict[str, str]
    folder: str = ""
    rows: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.folder:
            self.folder = f"{checkpoint_dir(self.spark).rstrip('/')}/keyreel-orphans-{uuid.uuid4().hex}"
            delete_at_exit(self.spark, self.folder)
        key = "ref_field string, video string, val long"
        self._events = f"{key}, from_t timestamp, to_t timestamp"
        self._orphans = ", ".join([*(f"`{c}` {t}" for c, t in self.ids.items()), key, "t timestamp, status string, resolved_at timestamp, reopened_at timestamp"])

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(conf).exists(where):
            return self.spark.createDataFrame([], f"{schema}, period int")
        rows = self.spark.read.schema(f"{schema}, period int").parquet(path)
        return rows if before is None else rows.where(F.col("period") < before)

    def orphans(self, before: int | None = None) -> DataFrame:
        """(ids, KEY, t, status, resolved_at, reopened_at) of every orphan, as it was judged last."""
        log = self._read("orphans", self._orphans, before)
        kept = [*self.ids, *KEY, "t"]
        return log.groupBy(*kept).agg(F.max_by(F.struct(*_FATE), "period").alias("x")).select(*kept, "x.*")

    def counts(self) -> DataFrame:
        """(period, status, orphans, open): after each period the number of orphans by what became of them, and how many still wait; one row per change is read, not the references."""
        log = self._read("orphans", self._orphans, None)
        last = F.lag(F.struct(*_FATE)).over(W.partitionBy(*self.ids, *KEY).orderBy("period"))
        open_ = lambda s: (s["resolved_at"].isNull() | s["reopened_at"].isNotNull()).cast("long")
        now = F.struct(*_FATE)
        moves = log.withColumn("old", last).withColumn("new", now)
        moves = moves.select("period", F.explode(F.array(F.struct(F.col("new.status").alias("status"), F.lit(1).alias("n"), open_(F.col("new")).alias("o")), F.struct(F.col("old.status").alias("status"), F.lit(-1).alias("n"), (-open_(F.col("old"))).alias("o")))).alias("m")).where("m.status IS NOT NULL")
        change = moves.groupBy("period", "m.status").agg(F.sum("m.n").alias("n"), F.sum("m.o").alias("o"))
        run = W.partitionBy("status").orderBy("period").rowsBetween(W.unboundedPreceding, 0)  # three statuses, a row per period
        return change.select("period", "status", F.sum("n").over(run).alias("orphans"), F.sum("o").over(run).alias("open"))

    def step(self, period: int, refs: DataFrame, events: DataFrame, until: Column) -> DataFrame:
        """Take in the period number ``period``, which ends with ``until``; gives the references of the period that resolved."""
        whole = "ref_field IS NOT NULL AND video IS NOT NULL AND val IS NOT NULL"
        fresh = events.select(*KEY, "from_t", "to_t").where(whole)
        seen = Observation()
        fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.folder}/events/period={period}")
        self.rows[period] = seen.get["n"]
        log = self._read("events", self._events, period + 1).drop("period")
        index = _spells(log)
        rows = sum(self.rows[p] for p in range(period + 1)) if all(p in self.rows for p in range(period + 1)) else log.count()
        cases = refs.drop("spells", "first_gone", "new").where(f"t IS NOT NULL AND {whole}").withColumn("new", F.lit(True))
        if period:
            named = self._read("events", self._events, period + 1).where(F.col("period") == period).select(*KEY).distinct()
            waiting = self.orphans(period).drop(*_FATE).join(named, KEY, "left_semi").withColumn("new", F.lit(False))
            cases = cases.unionByName(waiting, allowMissingColumns=True)
        probed = state_join(cases, index, KEY, "left", count=rows, spread=next(iter(self.ids)))
        here = F.coalesce(F.exists("spells", lambda s: (s["from_t"] <= F.col("t")) & (s["to_t"].isNull() | (s["to_t"] > F.col("t")))), F.lit(False))
        resolved, judged = probed.where(F.col("new") & here), probed.where(~F.col("new") | ~here)
        gone = F.coalesce(F.exists("spells", lambda s: s["to_t"] <= F.col("t")) | (F.col("first_gone") <= F.col("t")), F.lit(False))
        after = F.array_sort(F.filter("spells", lambda s: (s["from_t"] > F.col("t")) & (s["from_t"] <= until)))
        judged = judged.withColumn("back", F.try_element_at(after, F.lit(1)))
        status = F.when(gone, REMOVED).when(F.col("back").isNotNull(), LATER).otherwise(NEVER)
        reopened = F.when(F.col("back.to_t") <= until, F.col("back.to_t"))
        judged = judged.select(*self.ids, *KEY, "t", status.alias("status"), F.col("back.from_t").alias("resolved_at"), reopened.alias("reopened_at"))
        judged.write.mode("overwrite").parquet(f"{self.folder}/orphans/period={period}")
        return resolved.drop("new", "spells", "first_gone")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_table, row_key, video, kf_n, frame_idx, t): each row once, at its earliest arrival."""
    parts = []
    for name, key, when, frames in (("asr_global_merged_v2", "embedding_row", "ingested_at", True), ("search_result", "result_id", "served_at", True), ("global_keyframes", "g", "ingested_at", False)):
        refs = [F.col(c).cast("long") if frames else F.lit(None).cast("long").alias(c) for c in ("kf_n", "frame_idx")]
        rows = table(spark, sf_dir, name).where(F.col("video_id").isNotNull() & F.col(when).isNotNull() & F.col(key).isNotNull())
        rows = rows.select(F.lit(name).alias("ref_table"), F.col(key).cast("long").alias("row_key"), tidy_id("video_id").alias("video"), *refs, F.col(when).alias("t")).where("video IS NOT NULL")
        parts.append(rows.groupBy("row_key", "video", "kf_n", "frame_idx", "ref_table").agg(F.min("t").alias("t")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def orphan_references(spark: SparkSession, sf_dir: str, *, periods: int = 2) -> tuple[DataFrame, OrphanTracker, OrphanTracker]:
    """Orphans (ref_table, row_key, ref_field, t, status, resolved_at, reopened_at) of the three tables that name videos and frames, and the trackers.

    The log of arrivals is replayed in ``periods`` equal spans of time; a video comes when it is registered and goes, as an
    event of its own, when it is removed. ``kf_n`` and ``frame_idx`` are checked only where ``video_id`` resolves. Null or
    blank references are no cases; repeated deliveries count at their earliest arrival.
    """
    refs = _references(spark, sf_dir)
    catalog = table(spark, sf_dir, "videos").select(F.lit("video_id").alias("ref_field"), tidy_id("video_id").alias("video"), F.lit(0).cast("long").alias("val"), "registered_at", "removed_at").where("video IS NOT NULL AND registered_at IS NOT NULL")
    came = catalog.select(*KEY, F.col("registered_at").alias("from_t"), F.lit(None).cast("timestamp").alias("to_t"), F.col("registered_at").alias("at"))
    went = catalog.where("removed_at IS NOT NULL").select(*KEY, F.col("registered_at").alias("from_t"), F.col("removed_at").alias("to_t"), F.col("removed_at").alias("at"))
    kf = table(spark, sf_dir, "global_keyframes").where("ingested_at IS NOT NULL").select(tidy_id("video_id").alias("video"), "kf_n", "frame_idx", F.col("ingested_at").alias("from_t"))
    frames = kf.select("video", "from_t", F.explode(F.array(*(F.struct(F.lit(c).alias("ref_field"), F.col(c).cast("long").alias("val")) for c in ("kf_n", "frame_idx")))).alias("k"))
    frames = frames.select("k.ref_field", "video", "k.val", "from_t").where("video IS NOT NULL AND val IS NOT NULL").groupBy("ref_field", "video", "val").agg(F.min("from_t").alias("from_t"))
    frames = frames.withColumn("to_t", F.lit(None).cast("timestamp"))
    arrivals = [table(spark, sf_dir, n).agg(F.min(F.unix_micros(c)).alias("a"), F.max(F.unix_micros(c)).alias("b")) for n, c in (("asr_global_merged_v2", "ingested_at"), ("search_result", "served_at"), ("global_keyframes", "ingested_at"), ("videos", "registered_at"))]
    reach = arrivals[0]
    for x in arrivals[1:]:
        reach = reach.unionByName(x)
    span = reach.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    low, high = span["a"] or 0, span["b"] or 0
    width = max(1, (high - low) // periods + 1)
    period = lambda c: F.greatest(F.lit(0), F.least(F.floor((F.unix_micros(c) - low) / width), F.lit(periods - 1))).cast("int")
    videos = came.unionByName(went).withColumn("period", period("at"))
    ids = {"row_key": "long", "ref_table": "string"}
    by_video, by_frame = OrphanTracker(spark, ids), OrphanTracker(spark, ids)
    # The frames of one period are tracked while the videos of the next are: neither needs the other's state.
    with ThreadPoolExecutor(1) as side:
        kept = side.submit(cut_table, frames.withColumn("period", period("from_t")), "period")
        log = cut_table(refs.withColumn("period", period("t")), "period")
        frames, steps = kept.result(), []
        for p in range(periods):
            until = F.timestamp_micros(F.lit(low + (p + 1) * width - 1))
            now = log.where(F.col("period") == p)
            names = now.select("ref_table", "row_key", "kf_n", "frame_idx", "t", F.lit("video_id").alias("ref_field"), "video", F.lit(0).cast("long").alias("val"))
            known = by_video.step(p, names, videos.where(F.col("period") == p), until)
            fields = F.explode(F.array(*(F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("val")) for c in ("kf_n", "frame_idx"))))
            inner = known.select("ref_table", "row_key", "video", "t", fields.alias("k")).select("ref_table", "row_key", "t", "k.ref_field", "video", "k.val")
            steps.append(side.submit(by_frame.step, p, inner, frames.where(F.col("period") == p), until))
        for s in steps:
            s.result()
    cols = ["ref_table", "row_key", "ref_field", "t", *_FATE]
    return by_video.orphans().select(*cols).unionByName(by_frame.orphans().select(*cols)), by_video, by_frame
