"""Runs of identical or nearly identical consecutive events, by optimal segmentation.

Rows are range-partitioned and sorted by (entity, time, order). Each partition streams through a pruned dynamic program
that minimises within-run dissimilarity plus a penalty per run; only the runs at the edges of a partition can go on in the
next one, and those - two per partition - are stitched from a table as long as there are partitions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyreel.session import cut_table

_OUT = "part int, seq long, edge boolean, entity string, first_row long, last_row long, n long, t_first double, t_last double, lead string, tail string, solid boolean"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("edge", pa.bool_()), ("entity", pa.string()), ("first_row", pa.int64()), ("last_row", pa.int64()), ("n", pa.int64()), ("t_first", pa.float64()), ("t_last", pa.float64()), ("lead", pa.string()), ("tail", pa.string()), ("solid", pa.bool_())])


class _Plain(dict):
    """Characters to their letters and digits without accents (d with stroke as d), filled as they occur: at most one entry per code point."""

    def __missing__(self, code: int) -> str:
        s = "".join(c for c in unicodedata.normalize("NFD", "d" if code == 0x111 else chr(code)) if c.isalnum())
        self[code] = s
        return s


_PLAIN = _Plain()


def fold(text: str) -> str:
    """Lower case, without accents (d with stroke as d), letters and digits only."""
    return text.lower().translate(_PLAIN)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 once it is larger; bit-parallel over whole numbers, so long texts stay cheap."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    peq: dict[str, int] = {}
    for k, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << k
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, d = mask, 0, len(a)
    for k, c in enumerate(b):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        if d - (len(b) - 1 - k) > most:
            return most + 1
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
    return min(d, most + 1)


def dissimilarity(a: str, b: str, share: float) -> float:
    """Edit distance as a share of the longer text, or infinity once it is beyond ``share``; two texts that fold to nothing are alike."""
    longer = max(len(a), len(b))
    most = int(longer * share + 1e-9)
    d = edit_distance(a, b, most)
    return float("inf") if d > most else d / max(longer, 1)


@dataclass
class _Run:
    """The last run of the cheapest segmentation of the rows so far."""

    entity: str
    lead: str | None
    tail: str | None
    raw: str | None
    first: int
    last: int
    t0: float
    t1: float
    n: int = 1


class Segmenter:
    """The segmentation with the least sum of neighbour dissimilarities inside runs plus ``penalty`` for each run, row by row.

    best[t] = min over starts s of best[s] + C(s, t) + penalty, where C(s, t) adds up the dissimilarities of neighbours from
    s to t. What a later row adds is the same for every start at or before it, so of two starts the dearer one stays dearer
    for good: pruning leaves a single start, the cheaper of going on with the last run (+ dissimilarity) and beginning anew
    (+ penalty); equal costs go on. So a run is final once a start after it is cheaper, the program is linear in the rows
    and holds one run, however long it is. Another entity, and a row in no run (``text`` None), begin anew in any case.
    """

    def __init__(self, penalty: float) -> None:
        self.penalty, self.run, self.cost = penalty, None, 0.0

    def add(self, entity: str, t: float, row: int, raw: str | None) -> _Run | None:
        """Takes in the next row; gives the run that has become final, if one has."""
        run = self.run
        if run is not None and run.entity == entity and raw is not None and run.tail is not None:
            if raw == run.raw:
                step, folded = 0.0, run.tail
            else:
                folded = fold(raw)
                step = dissimilarity(run.tail, folded, self.penalty)
            if step <= self.penalty:
                self.cost += step
                run.last, run.t1, run.n, run.tail, run.raw = row, t, run.n + 1, folded, raw
                return None
        else:
            folded = None if raw is None else fold(raw)
        self.cost += self.penalty
        self.run = _Run(entity, folded, folded, raw, row, row, t, t)
        return run


def _segments(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq, first = TaskContext.get().partitionId(), 0, True
    program, held = Segmenter(share), []
    for batch in batches:
        for entity, t, row, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            done = program.add(entity, t, row, text)
            if done is not None:
                held.append(done)
        if len(held) > 1:
            yield _batch(part, seq, held, first, False)
            seq, held, first = seq + len(held), [], False
    if program.run is not None:
        yield _batch(part, seq, [*held, program.run], first, True)


def _batch(part: int, seq: int, runs: list[_Run], first: bool, last: bool) -> pa.RecordBatch:
    """Runs as rows; those at an edge of the partition with their first and last text."""
    edge = [(first and i == 0) or (last and i == len(runs) - 1) for i in range(len(runs))]
    rows = [(part, seq + i, e, r.entity, r.first, r.last, r.n, r.t0, r.t1, r.lead if e else None, r.tail if e else None, r.tail is not None) for i, (r, e) in enumerate(zip(runs, edge))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def collapse_runs(df: DataFrame, *, row: str, entity: str, time: str, order: str, text: str, usable: str | None = None, share: float = 0.1) -> DataFrame:
    """(entity, first_row, last_row, n, t_first, t_last, duration): the maximal runs of rows of one entity, single rows as runs of one.

    Rows are ordered by ``time``, ``order`` (nulls first), then ``row``; two neighbours belong together if the edit
    distance of their folded texts is at most ``share`` of the longer one. Rows with a null entity, row id or a null or NaN
    time are left out first; a row id counts once. A null or blank text, or a false ``usable`` flag, ends a run and is in
    none. An empty table has no runs. Columns beside the named ones play no part.
    """
    ok = F.coalesce(F.trim(F.regexp_replace(text, "\\s+", " ")) != "", F.lit(False)) & (F.col(usable) if usable else F.lit(True))
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(time).cast("double").alias("t"), F.col(order).cast("long").alias("o"), F.col(row).cast("long").alias("row"), F.col(text).alias("text"), ok.alias("ok"))
    rows = rows.where("entity IS NOT NULL AND row IS NOT NULL AND t IS NOT NULL AND NOT isnan(t)").dropDuplicates(["row"])
    rows = rows.repartitionByRange("entity", "t", "o", "row").sortWithinPartitions("entity", "t", "o", "row")
    found = cut_table(rows.select("entity", "t", "row", F.when(F.col("ok"), F.col("text"))).mapInArrow(lambda it: _segments(it, share), _OUT))
    edges = sorted(found.where("edge").collect(), key=lambda r: (r["part"], r["seq"]))  # at most two per partition
    merged: list[list] = []
    for r in edges:
        m = merged[-1] if merged else None
        if m and m[6] != r["part"] and m[0] == r["entity"] and m[7] is not None and r["lead"] is not None and dissimilarity(m[7], r["lead"], share) <= share:
            m[2], m[3], m[5], m[6], m[7] = r["last_row"], m[3] + r["n"], r["t_last"], r["part"], r["tail"]
        else:
            merged.append([r["entity"], r["first_row"], r["last_row"], r["n"], r["t_first"], r["t_last"], r["part"], r["tail"], r["solid"]])
    schema = "entity string, first_row long, last_row long, n long, t_first double, t_last double"
    stitched = df.sparkSession.createDataFrame([tuple(m[:6]) for m in merged if m[8]], schema)
    inner = found.where("NOT edge AND solid").select("entity", "first_row", "last_row", "n", "t_first", "t_last")
    return inner.unionByName(stitched).withColumn("duration", F.col("t_last") - F.col("t_first"))
