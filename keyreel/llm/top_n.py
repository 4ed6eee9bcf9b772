"""The N best rows of every group by simultaneous bisection of order-preserving codes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyreel.session import HOT_ROWS, cut_table, state_join

#: Parts into which a pass cuts the open interval of a group: 63 midpoints are six levels of bisection at once.
SLOTS = 64
_LAST = (1 << 62) - 1


def _code(score: Column) -> Column:
    """A whole number that orders finite doubles as they are ordered: 2**52 steps for each power of two, as in their bits."""
    a = F.abs(score)
    e = F.floor(F.log2(a)).cast("int")
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    e = F.greatest(e, F.lit(-1022))
    half = F.floor(e / 2).cast("int")
    frac = a / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), e - half)
    code = (e.cast("long") + 1023) * F.lit(1 << 52) + ((frac - 1.0) * float(1 << 52)).cast("long")
    return F.when(score == 0, F.lit(0).cast("long")).when(score < 0, -code).otherwise(code)


def _tree(code: Column, bounds: list[int], low: int, high: int) -> Column:
    """The number of ``bounds`` (ascending) that are above ``code``, between low and high, as nested comparisons: no array is walked."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(code < F.lit(bounds[len(bounds) - 1 - mid]), _tree(code, bounds, mid + 1, high)).otherwise(_tree(code, bounds, low, mid))


def top_n_per_group(df: DataFrame, *, group: str, score: str, n: int, ties: list[str], row_id: str) -> DataFrame:
    """Rows (``group``, ``score``, *``ties``, ``row_id``): the ``n`` first of each group by score descending, then each of ``ties`` and ``row_id`` ascending.

    In a pass every unfinished group cuts the open interval of its code (score, then ``ties``, then ``row_id``: the first of
    them in which its open rows differ) into ``SLOTS`` parts and counts its rows in each with map-side combination; in the
    first pass all groups cut at the same quantiles of the score. Rows above the part in which the n-th lies are kept,
    those below are dropped, those inside go on with that part's bounds; a group is done once it holds exactly ``n``, and
    one with no more than ``n`` rows in the first pass. Rows carry their interval, so that a pass joins them once, with a
    cutoff for each group. No group is ever gathered: tasks exchange counts, never rows of a group.

    Rows with a null group, id or score and NaN or infinite scores are left out; null ties sort last; equal rows count
    once. An empty table gives an empty result. ``ties`` and ``row_id`` must be whole numbers; other columns play no part.
    """
    s = F.col(score).cast("double")
    fine = F.col(group).isNotNull() & F.col(row_id).isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))
    codes = [_code(s), *(-F.coalesce(F.col(t).cast("long"), F.lit(_LAST)) for t in ties), -F.col(row_id).cast("long")]
    parts = range(len(codes))
    rows = df.where(fine).select(F.col(group).alias("g"), F.col(row_id).alias("k_id"), *(c.alias(f"c{i}") for i, c in zip(parts, codes)), s.alias("score"))
    rows = cut_table(rows.dropDuplicates(["k_id", "g", *(f"c{i}" for i in parts)]))
    bounds = sorted(set(rows.agg(F.percentile_approx("c0", [i / SLOTS for i in range(1, SLOTS)], 1000).alias("q")).first()["q"] or []))
    slot = _tree(F.col("c0"), bounds, 0, len(bounds))
    active = rows.withColumn("need", F.lit(n).cast("long"))
    kept = []
    while True:
        placed = active.withColumn("slot", slot)
        edges = [f(f"c{i}").alias(f"{a}{i}") for i in parts for f, a in ((F.min, "lo"), (F.max, "hi"))]
        counts = placed.groupBy("g", "slot").agg(F.count("*").alias("n"), F.max("need").alias("need"), *edges)
        held = F.struct("slot", "n", *(f"{a}{i}" for i in parts for a in ("lo", "hi")))
        cutoffs = counts.groupBy("g").agg(F.array_sort(F.collect_list(held)).alias("h"), F.max("need").alias("wanted"), F.sum("n").alias("size"))  # SLOTS entries a group at most
        walk = F.aggregate(
            F.transform("h", lambda x: x["n"]),
            F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("inside")),
            lambda a, x: F.when(a["above"] + a["inside"] >= F.col("wanted"), a).otherwise(F.struct((a["at"] + 1).alias("at"), (a["above"] + a["inside"]).alias("above"), x.alias("inside"))),
        )
        at = cutoffs.withColumn("w", walk).withColumn("x", F.element_at("h", F.col("w.at") + 1))
        differ = lambda make: F.coalesce(*(F.when(F.col(f"x.lo{i}") < F.col(f"x.hi{i}"), make(i)) for i in parts), make(len(codes) - 1))
        at = at.select("g", "size", F.col("x.slot").alias("at"), F.col("w.above").alias("above"), F.col("w.inside").alias("inside"), differ(F.lit).cast("int").alias("part"), differ(lambda i: F.col(f"x.lo{i}")).alias("lo"), differ(lambda i: F.col(f"x.hi{i}")).alias("hi"))
        at = cut_table(at)
        hot = at.where(F.col("size") > HOT_ROWS).select("g")
        joined = state_join(placed.select("g", "k_id", *(f"c{i}" for i in parts), "score", "need", "slot"), at.drop("size"), ["g"], "inner", count=at.count(), hot=hot, spread="k_id")
        full = (F.col("slot") < F.col("at")) | (F.col("above") + F.col("inside") <= F.col("need"))
        judged = cut_table(joined.where("slot <= at").withColumn("full", full), "full")
        kept.append(judged.where("full").select("g", "score", "k_id", *(f"c{i}" for i in parts)))
        active = judged.where("NOT full").select(*rows.columns, (F.col("need") - F.col("above")).alias("need"), "part", "lo", "hi")
        if active.isEmpty():
            break
        code = F.coalesce(*(F.when(F.col("part") == i, F.col(f"c{i}")) for i in parts)).cast("decimal(20,0)")
        slot = F.floor((F.col("hi") - code) * SLOTS / (F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1)).cast("int")
    found = functools.reduce(DataFrame.unionByName, kept)
    names = dict(zip((f"c{i}" for i in range(1, len(codes) - 1)), ties))
    back = [F.when(F.col(c) != -_LAST, -F.col(c)).alias(t) for c, t in names.items()]
    return found.select(F.col("g").alias(group), F.col("score").alias(score), *back, F.col("k_id").alias(row_id))
