"""Resumable materialisation and streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyreel.operators.orphans import OrphanTracker
from keyreel.session import cut_table


def latest_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """Of an append-only log of attempts (key, attempt, status, ...) the last record of each key."""
    return attempts.groupBy(key).agg(F.max_by(F.struct(*[c for c in attempts.columns if c != key]), "attempt").alias("x")).select(key, "x.*")


def to_do(targets: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Targets without a success: only missing ones and errors are tried again."""
    return targets.join(latest_attempts(attempts, key).where("status = 'success'"), key, "left_anti")


def materialise(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], *, fmt: str = "parquet") -> StreamingQuery:
    """Files of ``source`` through ``transform`` to Parquet at ``out``, each exactly once however often it is started again; ends when all are done."""
    stream = spark.readStream.format(fmt).schema(schema).load(source)

    def write(batch: DataFrame, number: int) -> None:
        # One folder per batch: a batch that runs again replaces what it had written.
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_stream(events: DataFrame, *, by: str, time: str, gap: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """Gap sessions of a stream: (by, start, end, n); late rows within the watermark still count."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(by, s.alias("s")).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_deliveries(events: DataFrame, *, key: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Of a stream with repeated deliveries the first of each key, with state bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def track_orphans(refs: DataFrame, events: DataFrame, tracker: OrphanTracker, checkpoint: str) -> StreamingQuery:
    """A stream of references (ref_field, video, val, t, ids) through an orphan tracker; ``events`` is the log of parent events with their time of arrival ``at``.

    A batch takes in the events that arrived after those of the last one and up to its own latest reference. All state is
    in the tracker's folder under the batch's number: a batch that runs again replaces what it had written, and a stream
    started again with a tracker on the same folder goes on from there.
    """
    spark, folder = tracker.spark, f"{tracker.folder}/until"

    def step(batch: DataFrame, number: int) -> None:
        rows = cut_table(batch)
        until = rows.agg(F.max("t")).first()[0]
        if until is None:
            return
        spark.createDataFrame([(until,)], "until timestamp").write.mode("overwrite").parquet(f"{folder}/period={number}")
        before = spark.read.schema("until timestamp, period int").parquet(folder).where(F.col("period") < number).agg(F.max("until")).first()[0]
        fresh = events.where(F.col("at") <= F.lit(until))
        tracker.step(number, rows, fresh if before is None else fresh.where(F.col("at") > F.lit(before)), F.lit(until))

    return refs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
