"""Data-quality gates: canonical agreement, coverage, inventories and preflight codes. Nothing is repaired silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["video_id", "kf_n"]
#: Scopes in ascending order.
SCOPES = ["missing", "diagnostic", "partial", "global"]


def counted(df: DataFrame, code: str, where: Column) -> DataFrame:
    """(code, n): rows that violate a rule."""
    return df.where(where).agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")


def together(parts: list[DataFrame]) -> DataFrame:
    """Reports one below the other."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def mapping_report(rows: DataFrame, canonical: DataFrame, *, tolerance: float = 0.01) -> DataFrame:
    """Rows with ``mapping``: unmapped (no key), unknown_key, frame_mismatch, time_mismatch or ok. ``canonical`` has one row per (video, kf_n)."""
    c = canonical.select(*KEY, F.col("frame_idx").alias("c_frame"), F.col("pts_time").alias("c_time"))
    j = rows.join(c, KEY, "left")
    said = F.when(F.col("video_id").isNull() | F.col("kf_n").isNull(), "unmapped").when(F.col("c_frame").isNull(), "unknown_key").when(F.col("frame_idx") != F.col("c_frame"), "frame_mismatch").when(F.abs(F.col("pts_time") - F.col("c_time")) > tolerance, "time_mismatch").otherwise("ok")
    return j.withColumn("mapping", said)


def conflicting(canonical: DataFrame) -> DataFrame:
    """Keys that name more than one (frame, time)."""
    return canonical.groupBy(*KEY).agg(F.countDistinct(F.struct("frame_idx", "pts_time")).alias("n")).where("n > 1")


def coverage(canonical: DataFrame, rows: DataFrame, silent: DataFrame | None = None) -> DataFrame:
    """(pack, video_id, frames, with_rows, share) per video, per pack (video null) and in all (both null): one rollup."""
    seen = rows.select(*KEY).distinct().withColumn("_has", F.lit(1))
    j = canonical.select("pack", *KEY).join(seen, KEY, "left")
    if silent is not None:
        j = j.join(silent.select("video_id").distinct().withColumn("_silent", F.lit(1)), "video_id", "left").withColumn("_has", F.coalesce("_has", "_silent"))
    out = j.rollup("pack", "video_id").agg(F.count("*").alias("frames"), F.sum(F.coalesce("_has", F.lit(0))).alias("with_rows"))
    return out.withColumn("share", F.col("with_rows") / F.col("frames"))


def both_silent_and_seen(rows: DataFrame, silent: DataFrame) -> DataFrame:
    """Videos that are listed as without rows but have some: a contradiction."""
    return silent.select("video_id").distinct().join(rows.select("video_id"), "video_id", "left_semi")


def identity_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(video_id, kf_n, frame_idx, side): identities that only one of two row-aligned tables has."""
    ids = [*KEY, "frame_idx"]
    x, y = a.select(*ids).distinct(), b.select(*ids).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, videos, repeated_keys) of tables with (video_id, kf_n)."""
    parts = []
    for name, df in tables.items():
        keys = df.groupBy(*KEY).agg(F.count("*").alias("n"))
        parts.append(keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.countDistinct("video_id").alias("videos"), F.count_if(F.col("n") > 1).alias("repeated_keys")).select(F.lit(name).alias("name"), "rows", "videos", "repeated_keys"))
    return together(parts)


def artifact_scope(rows: Column, videos: Column, all_videos: Column) -> Column:
    """missing, diagnostic (under a tenth), partial or global."""
    return F.when(F.coalesce(rows, F.lit(0)) == 0, "missing").when(videos >= all_videos, "global").when(videos * 10 < all_videos, "diagnostic").otherwise("partial")


def at_least_scope(scope: Column, needed: str) -> Column:
    """Whether a scope reaches another one."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(SCOPES) for x in (s, i)])
    return order[scope] >= SCOPES.index(needed)


def contiguous(df: DataFrame, row: str) -> DataFrame:
    """(rows, lowest, highest, distinct_rows, contiguous) of a row-id column that should run from 0 without holes."""
    a = df.agg(F.count("*").alias("rows"), F.min(row).alias("lowest"), F.max(row).alias("highest"), F.countDistinct(row).alias("distinct_rows"))
    return a.withColumn("contiguous", (F.col("lowest") == 0) & (F.col("highest") == F.col("rows") - 1) & (F.col("distinct_rows") == F.col("rows")))


def timeline_report(canonical: DataFrame) -> DataFrame:
    """(code, n) of a canonical map: negatives, nulls, times or frames that go back."""
    from pyspark.sql import Window as W

    w = W.partitionBy("video_id").orderBy("kf_n")
    d = canonical.withColumn("_pt", F.lag("pts_time").over(w)).withColumn("_pf", F.lag("frame_idx").over(w))
    codes = {"null_time": F.col("pts_time").isNull(), "negative": (F.col("kf_n") < 0) | (F.col("frame_idx") < 0) | (F.col("pts_time") < 0), "time_goes_back": F.col("pts_time") < F.col("_pt"), "frame_goes_back": F.col("frame_idx") < F.col("_pf"), "same_frame": F.col("frame_idx") == F.col("_pf")}
    one = d.agg(*[F.count_if(c).alias(k) for k, c in codes.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("n")) for k in codes])).alias("x")).select("x.*")


def preflight(speech: DataFrame, screen: DataFrame, canonical: DataFrame) -> DataFrame:
    """(modality, code, n): one pass per modality over all its rules."""
    c = canonical.select(*KEY, F.col("frame_idx").alias("c_frame"), F.col("pts_time").alias("c_time")).dropDuplicates(KEY)
    blank = lambda t: F.coalesce(F.trim(F.col(t)) == "", F.lit(True))
    common = {"null_video": F.col("video_id").isNull(), "null_kf": F.col("kf_n").isNull(), "null_frame": F.col("frame_idx").isNull(), "unknown_key": F.col("video_id").isNotNull() & F.col("kf_n").isNotNull() & F.col("c_frame").isNull(), "frame_mismatch": F.col("frame_idx") != F.col("c_frame"), "time_mismatch": F.abs(F.col("pts_time") - F.col("c_time")) > 0.01}
    rules = {
        "asr": (speech, common | {"blank_text": blank("text"), "null_interval": F.col("start").isNull() | F.col("end").isNull(), "reversed_interval": F.col("end") < F.col("start"), "negative_start": F.col("start") < 0, "long_chunk": F.col("end") - F.col("start") > 30, "replacement": F.col("text").contains("�")}),
        "ocr": (screen, common | {"blank_text": blank("ocr_text"), "null_time": F.col("pts_time").isNull(), "replacement": F.col("ocr_text").contains("�")}),
    }
    parts = []
    for name, (df, codes) in rules.items():
        one = df.join(c, KEY, "left").agg(*[F.count_if(x).alias(k) for k, x in codes.items()])
        parts.append(one.select(F.lit(name).alias("modality"), F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("n")) for k in codes])).alias("x")).select("modality", "x.*"))
    return together(parts)


def unknown_ids(provided: DataFrame, expected: DataFrame, id: str) -> DataFrame:
    """(id, problem): ids a provider gave that weren't asked for, and the ones it left out."""
    a = provided.select(id).distinct().join(expected, id, "left_anti").select(id).withColumn("problem", F.lit("unexpected"))
    return a.unionByName(expected.select(id).distinct().join(provided, id, "left_anti").withColumn("problem", F.lit("missing")))


def identity_checksum(df: DataFrame, cols: list[str]) -> DataFrame:
    """(rows, checksum): an order-free checksum of the identities, summed without gathering them."""
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sha2(F.coalesce(F.sum(h).cast("string"), F.lit("")), 256).alias("checksum"))


def far_rows(rows: DataFrame, canonical: DataFrame, *, most: float = 10.0) -> DataFrame:
    """Chunks whose nearest keyframe is farther than ``most`` seconds from their middle."""
    from keyreel.operators.temporal import nearest_row

    mid = rows.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    near = nearest_row(mid, canonical.select("video_id", F.col("pts_time").alias("_c"), F.col("kf_n").alias("_k")), on="video_id", time="_mid", right_time="_c", payload=["_k"])
    return near.where(F.col("distance") > most).drop("_mid", "near__k")


def check(report: DataFrame, fatal: list[str]) -> None:
    """Raise if a (code, n) report has any of the fatal codes; nothing is repaired."""
    found = {r["code"]: r["n"] for r in report.where(F.col("code").isin(fatal) & (F.col("n") > 0)).collect()}
    if found:
        raise ValueError(f"data quality: {found}")


def compatible(mine: dict, other: dict, names: tuple[str, ...] = ("dim", "metric", "normalised", "model")) -> list[str]:
    """Names of model metadata in which two indexes differ."""
    return [n for n in names if mine.get(n) != other.get(n)]


def readiness(reports: dict[str, DataFrame], fatal: dict[str, list[str]]) -> DataFrame:
    """(part, ready, problems) of several (code, n) reports."""
    parts = [r.agg(F.coalesce(F.sum(F.when(F.col("code").isin(fatal.get(name, [])), F.col("n")).otherwise(0)), F.lit(0)).alias("problems")).select(F.lit(name).alias("part"), (F.col("problems") == 0).alias("ready"), "problems") for name, r in reports.items()]
    return together(parts)
