"""Cutting oversized items into pieces at natural boundaries, range by range.

An item is never handled as a whole after it has been read: workers take ranges of it with a halo, normalise them, report
their lengths, a prefix sum gives every range its offset, boundaries found in the ranges are stitched to one table per cut,
and pieces are put together from cells of the ranges by offset.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters (of a column) or bytes (of a file) in a range.
RANGE = 8192
#: Normalised characters in a cell of the emission join.
CELL = 512
#: Ranges in a block of the two-level prefix sum.
BLOCK = 256
WHITE = " \t\r\n"
_RUN = re.compile("[ \t\r\n]+")
#: Boundary kinds, best first; a cut lies after the match.
_KINDS = [re.compile(r"[.!?…]+[\"'”’»)\]]* "), re.compile(r"[,;:–—|]+ "), re.compile(" ")]
_HARD = len(_KINDS)
_RANGES = "id long, rno long, body string, nlen long, tail string"


def collapsed_length(text: Column) -> Column:
    """Code points of a text once runs of spaces, tabs, CRs and LFs are one space and those at both ends are dropped."""
    return F.length(F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " ")))


def _normal(core: str, before: str) -> str:
    """The part of the normalised text that stems from one range; ``before`` is the halo on its left."""
    s = _RUN.sub(" ", core)
    return s[1:] if s[:1] == " " and (not before or before[-1] in WHITE) else s


def _column_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            out: list[tuple] = []
            for r, at in enumerate(range(0, len(text), RANGE)):
                before = text[max(0, at - 64) : at]
                body = _normal(text[at : at + RANGE], before)
                out.append((i, r, body, len(body), _RUN.sub(" ", before)[-8:]))
                if len(out) == 512:
                    yield _ranges(out)
                    out = []
            if out:
                yield _ranges(out)


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], ["id", "rno", "body", "nlen", "tail"])


def file_ranges(spark: SparkSession, files: list[tuple[int, str]], *, range_bytes: int = 1 << 20) -> DataFrame:
    """Ranges of UTF-8 files given as (id, uri), each read by one task with a halo, never a whole file.

    A character belongs to the range in which its first byte lies. Broken bytes become U+FFFD. An empty file has no ranges.
    """
    from pyarrow import fs

    sizes = []
    for i, uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        sizes.append((i, uri, system.get_file_info(path).size))
    parts = spark.createDataFrame(sizes, "id long, uri string, size long")
    parts = parts.where("size > 0").select("id", "uri", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {range_bytes})")).alias("rno")).repartition("id", "rno")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["uri"])
                at, end = row["rno"] * range_bytes, min((row["rno"] + 1) * range_bytes, row["size"])
                low = max(0, at - 256)
                with system.open_input_file(path) as f:
                    f.seek(low)
                    raw = f.read(min(end + 4, row["size"]) - low)
                a, b = at - low, end - low
                while a < len(raw) and raw[a] & 0xC0 == 0x80 and a - (at - low) < 4:
                    a += 1
                while b < len(raw) and raw[b] & 0xC0 == 0x80 and b - (end - low) < 4:
                    b += 1
                before = raw[max(0, a - 256) : a].decode("utf-8", "replace")
                body = _normal(raw[a:b].decode("utf-8", "replace"), before)
                yield _ranges([(row["id"], row["rno"], body, len(body), _RUN.sub(" ", before)[-8:])])

    return parts.mapInArrow(read, _RANGES)


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cut whose window touches a range, the best boundary inside that range."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            off, body, step, slack = row["off"], row["body"], row["step"], row["slack"]
            text, shift = row["tail"] + body, off - len(row["tail"])
            k0, k1 = max(1, int((off - slack) / step)), min(row["n"] - 1, int((off + len(body) + slack) / step) + 1)
            for k in range(k0, k1 + 1):
                c = k * step
                lo, hi = max(off, int(-(-(c - slack) // 1))), min(off + len(body), int(c + slack))
                if lo > hi:
                    continue
                best = None
                for kind, pattern in enumerate(_KINDS):
                    a = max(0, lo - shift - 4)
                    for m in pattern.finditer(text, a, hi - shift):
                        p = m.end() + shift
                        if lo <= p <= hi and 0 < p < row["total"]:
                            x = (kind, abs(p - c), p)
                            best = x if best is None or x < best else best
                    if best:
                        break
                if best:
                    out.append((row["id"], k, *best))
        if out:
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.int64())], ["id", "k", "kind", "dist", "pos"])


def pieces_of(ranges: DataFrame, items: DataFrame, *, max_chars: int, max_seconds: float, overlap_chars: int, overlap_seconds: float) -> DataFrame:
    """Pieces (id, piece, pieces, from_char, to_char, t_from, t_to, cut_kind, text) of the items (id, t0, dur) whose ranges are given.

    ``dur`` null or not positive means that only the length limits. A step is at most 0.7 of the limit, a cut may move by a
    seventh of a step, so that step, both moves and the overlap stay within the limit. Each cut depends on its own window
    only: no pass over the item from its start is needed, and any number of tasks can work on one item.
    """
    step_chars, step_seconds = (max_chars - overlap_chars) * 7 / 9, (max_seconds - overlap_seconds) * 7 / 9
    inner = ranges.groupBy("id", F.expr(f"rno div {BLOCK}").alias("block")).agg(F.sum("nlen").alias("blen"))
    from pyspark.sql import Window as W

    blocks = inner.withColumn("boff", F.sum("blen").over(W.partitionBy("id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    totals = inner.groupBy("id").agg(F.sum("blen").alias("raw_total"))
    placed = ranges.withColumn("block", F.expr(f"rno div {BLOCK}")).join(blocks.select("id", "block", F.coalesce("boff", F.lit(0)).alias("boff")), ["id", "block"])
    in_block = F.sum("nlen").over(W.partitionBy("id", "block").orderBy("rno").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("off", F.col("boff") + F.coalesce(in_block, F.lit(0)))
    # The one space that may end the normalised text is dropped.
    last = placed.where("nlen > 0").groupBy("id").agg(F.max_by(F.substring("body", -1, 1), "rno").alias("end"))
    plan = items.join(totals, "id", "left").join(last, "id", "left")
    total = F.coalesce(F.col("raw_total"), F.lit(0)) - F.when(F.col("end") == " ", 1).otherwise(0)
    plan = plan.select("id", "t0", F.when(F.col("dur") > 0, F.col("dur")).alias("dur"), total.cast("long").alias("total"))
    over_chars, over_time = F.col("total") > max_chars, F.coalesce(F.col("dur") > max_seconds, F.lit(False))
    n_of = lambda over, x, step: F.when(over, F.ceil(x / F.lit(step))).otherwise(1)
    plan = plan.withColumn("n", F.greatest(n_of(over_chars, F.col("total"), step_chars), n_of(over_time, F.col("dur"), step_seconds)).cast("long")).where("n > 1")
    # Positions run over the text; an item without text is cut by time alone, in thousandths.
    plan = plan.withColumn("span", F.when(F.col("total") > 0, F.col("total").cast("double")).otherwise(F.lit(1000.0)))
    plan = plan.withColumn("step", F.col("span") / F.col("n")).withColumn("slack", F.col("step") / 7)
    per_second = F.when(F.col("dur").isNotNull(), F.col("span") / F.col("dur"))
    plan = plan.withColumn("overlap", F.when(F.col("total") > 0, F.least(F.lit(float(overlap_chars)), F.coalesce(per_second * overlap_seconds, F.lit(float(overlap_chars))))).otherwise(per_second * overlap_seconds))
    plan = plan.persist()
    asked = placed.join(plan.select("id", "n", "step", "slack", "total"), "id").select("id", "off", "body", "tail", "n", "step", "slack", "total")
    found = asked.mapInArrow(_boundaries, "id long, k long, kind int, dist double, pos long").groupBy("id", "k").agg(F.min(F.struct("kind", "dist", "pos")).alias("b"))
    wanted = plan.select("id", "n", "t0", "dur", "span", "total", "overlap", "step", F.explode(F.expr("sequence(0L, n)")).alias("k"))
    at = F.when(F.col("k") == 0, 0.0).when(F.col("k") == F.col("n"), F.col("span")).when(F.col("b").isNotNull(), F.col("b.pos").cast("double")).otherwise(F.col("k") * F.col("step"))
    cuts = wanted.join(found, ["id", "k"], "left").select("id", "k", "n", "t0", "dur", "span", "total", "overlap", at.alias("x"), F.coalesce("b.kind", F.lit(_HARD)).alias("kind"))
    ends = cuts.where("k > 0").select("id", (F.col("k") - 1).alias("k"), F.col("x").alias("x_to"), F.col("kind").alias("kind_to"))
    x0 = F.when(F.col("k") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("x") - F.col("overlap")))
    pieces = cuts.where("k < n").withColumn("x_from", x0).join(ends, ["id", "k"])
    time = lambda x: F.when(F.col("dur").isNotNull(), F.col("t0") + F.col(x) / F.col("span") * F.col("dur"))
    char = lambda x: F.when(F.col("total") > 0, F.floor(x)).otherwise(0).cast("long")
    pieces = pieces.select("id", F.col("k").alias("piece"), F.col("n").alias("pieces"), char("x_from").alias("from_char"), char("x_to").alias("to_char"), time("x_from").alias("t_from"), time("x_to").alias("t_to"), F.when(F.col("k") == F.col("n") - 1, None).otherwise(F.col("kind_to")).alias("cut_kind"))
    cells = F.explode(F.expr(f"sequence(off div {CELL}, (off + nlen - 1) div {CELL})")).alias("cell")
    slices = placed.where("nlen > 0").join(plan.select("id"), "id", "left_semi").select("id", "off", "nlen", "body", cells)
    slices = slices.withColumn("s_from", F.greatest("off", F.col("cell") * CELL)).withColumn("s_to", F.least(F.col("off") + F.col("nlen"), (F.col("cell") + 1) * CELL))
    slices = slices.select("id", "cell", "s_from", "s_to", F.expr("substring(body, cast(s_from - off + 1 AS int), cast(s_to - s_from AS int))").alias("s"))
    reach = pieces.where("to_char > from_char").select("id", "piece", "from_char", "to_char", F.explode(F.expr(f"sequence(from_char div {CELL}, (to_char - 1) div {CELL})")).alias("cell"))
    parts = reach.join(slices, ["id", "cell"]).where("s_from < to_char AND s_to > from_char")
    part = F.expr("substring(s, cast(greatest(from_char - s_from, 0) + 1 AS int), cast(least(to_char, s_to) - greatest(from_char, s_from) AS int))")
    texts = parts.groupBy("id", "piece").agg(F.array_sort(F.collect_list(F.struct("s_from", part.alias("t")))).alias("p")).select("id", "piece", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
    return pieces.join(texts, ["id", "piece"], "left")


def split_oversized(df: DataFrame, *, id: str, text: str, start: str, end: str, max_chars: int = 480, max_seconds: float = 30.0, overlap_chars: int = 48, overlap_seconds: float = 3.0) -> DataFrame:
    """Pieces of the rows whose ``text`` is longer than ``max_chars`` once white space is collapsed or whose span is wider than ``max_seconds``.

    Columns: ``id``, piece, pieces, from_char, to_char, t_from, t_to, cut_kind (0 sentence, 1 clause, 2 word, 3 none, null
    at the item's end), text. A null text limits nothing (a wide item without text is cut in time, its pieces have a null
    text); null, NaN or disordered times limit nothing and give null times. Rows with a null id are left out, an id counts
    once. Rows within both limits have no pieces. Other columns play no part.
    """
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    dur = F.when(~F.isnan(s) & ~F.isnan(e) & (e > s) & (F.abs(s) < float("inf")) & (F.abs(e) < float("inf")), e - s)
    big = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), s.alias("t0"), dur.alias("dur"))
    big = big.where(F.col("id").isNotNull() & ((collapsed_length(F.col("text")) > max_chars) | (F.col("dur") > max_seconds))).dropDuplicates(["id"]).persist()
    ranges = big.select("id", "text").mapInArrow(_column_ranges, _RANGES).persist()
    out = pieces_of(ranges, big.select("id", "t0", "dur"), max_chars=max_chars, max_seconds=max_seconds, overlap_chars=overlap_chars, overlap_seconds=overlap_seconds)
    return out.withColumnRenamed("id", id)
