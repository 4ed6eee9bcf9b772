"""Pairing records of two tables by nearest time.

Both sides are hash-partitioned into Arrow groups by (entity, time cell); inside a group DuckDB runs a backward and a
forward ASOF join, and the nearer candidate within the tolerance wins. A right row is copied into every cell it may
serve, so an entity that holds a third of all rows is spread over as many tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a time cell in seconds.
CELL_SECONDS = 300.0

_ASOF = """
WITH c AS (SELECT * FROM rows WHERE NOT is_right), k AS (SELECT * FROM rows WHERE is_right),
back AS (SELECT c.id, k.t AS kt, abs(k.t - c.t) AS d, k.payload AS p FROM c ASOF LEFT JOIN k ON c.entity = k.entity AND c.cell = k.cell AND c.t >= k.t),
ahead AS (SELECT c.id, k.t AS kt, abs(k.t - c.t) AS d, k.payload AS p FROM c ASOF LEFT JOIN k ON c.entity = k.entity AND c.cell = k.cell AND c.t <= k.t)
SELECT back.id AS id,
       CASE WHEN back.d <= $tol AND (ahead.d IS NULL OR back.d <= ahead.d) THEN back.p WHEN ahead.d <= $tol THEN ahead.p END AS payload,
       CASE WHEN back.d <= $tol AND (ahead.d IS NULL OR back.d <= ahead.d) THEN back.d WHEN ahead.d <= $tol THEN ahead.d END AS distance
FROM back JOIN ahead ON back.id = ahead.id
"""


def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    left_entity: str,
    left_time: Column,
    right_entity: str,
    right_time: str,
    payload: str,
    tolerance: float,
    cell_seconds: float = CELL_SECONDS,
) -> DataFrame:
    """Rows (``left_id``, ``payload``, ``distance``): each left row with the nearest right row of its entity, or nulls.

    A left id counts once. Left rows with a null id are left out; those without a usable entity or time come out with
    nulls. Right rows with a null, NaN or infinite time or a null entity take no part; of right rows with equal times the
    smallest payload wins, of two equally near the earlier one. Columns beside the named ones play no part, whatever
    their names. Empty tables give no rows or all nulls.
    """
    lt = left.select(F.col(left_id).cast("long").alias("id"), F.col(left_entity).alias("entity"), left_time.cast("double").alias("t")).where("id IS NOT NULL")
    lt = lt.groupBy("id").agg(F.min(F.struct(F.col("t").isNull().alias("none"), "entity", "t")).alias("x")).select("id", "x.entity", "x.t")
    ok = _usable(F.col("t")) & F.col("entity").isNotNull()
    cell = lambda t: F.floor(t / F.lit(cell_seconds)).cast("long")
    asked = lt.where(ok).select(F.lit(False).alias("is_right"), "entity", cell(F.col("t")).alias("cell"), "t", "id", F.lit(None).cast("long").alias("payload"))
    rt = right.select(F.col(right_entity).alias("entity"), F.col(right_time).cast("double").alias("t"), F.col(payload).cast("long").alias("payload"))
    rt = rt.where(_usable(F.col("t")) & F.col("entity").isNotNull() & F.col("payload").isNotNull()).groupBy("entity", "t").agg(F.min("payload").alias("payload"))
    reach = tolerance * (1 + 1e-9) + 1e-6
    cells = F.explode(F.sequence(cell(F.col("t") - reach), cell(F.col("t") + reach)))
    there = rt.select(F.lit(True).alias("is_right"), "entity", cells.alias("cell"), "t", F.lit(None).cast("long").alias("id"), "payload")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        with duckdb.connect(config={"threads": 1}) as con:
            con.register("rows", rows)
            yield from con.sql(_ASOF, params={"tol": tolerance}).to_arrow_table().cast(out).to_batches()

    out = pa.schema([("id", pa.int64()), ("payload", pa.int64()), ("distance", pa.float64())])
    found = asked.unionByName(there).repartition("entity", "cell").mapInArrow(join, "id long, payload long, distance double")
    found = found.unionByName(lt.where(~ok | ok.isNull()).select("id", F.lit(None).cast("long").alias("payload"), F.lit(None).cast("double").alias("distance")))
    return found.select(F.col("id").alias(left_id), F.col("payload").alias(payload), "distance")
