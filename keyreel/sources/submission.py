"""Ranked answers: checks, rows, JSON, CSV and ZIP packages."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.functions.text import is_non_answer

MOST_ANSWERS = 100
#: Queries of one package; their answers are what the driver gathers: at most MOST_QUERIES x MOST_ANSWERS rows.
MOST_QUERIES = 5_000


def whole_frame(c: Column) -> Column:
    """A frame number given as text or number: a whole one that isn't negative, else null."""
    d = c.cast("string").try_cast("double")
    return F.when((d >= 0) & (d == F.floor(d)) & (d < float("inf")) & ~c.cast("string").rlike("(?i)true|false"), d.cast("long"))


def audit(answers: DataFrame, canonical: DataFrame, *, task: str) -> DataFrame:
    """(query_id, code, n) of the problems of answers (query_id, rank, video_id, frame_idx[, answer]); no rows if there are none."""
    frames = canonical.select("video_id", "frame_idx").distinct().withColumn("_known", F.lit(True))
    j = answers.join(frames, ["video_id", "frame_idx"], "left").withColumn("_dup", F.row_number().over(W.partitionBy("query_id", "video_id", "frame_idx").orderBy("rank")))
    codes = {"unknown_frame": F.col("_known").isNull(), "repeated": F.col("_dup") > 1, "beyond_limit": F.col("rank") > MOST_ANSWERS, "bad_frame": whole_frame(F.col("frame_idx")).isNull()}
    if task == "qa":
        codes["unsafe_answer"] = is_non_answer("answer")
    one = j.groupBy("query_id").agg(*[F.count_if(c).alias(k) for k, c in codes.items()])
    return one.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("n")) for k in codes])).alias("x")).select("query_id", "x.*").where("n > 0")


def audit_sequences(answers: DataFrame, canonical: DataFrame, *, events: int) -> DataFrame:
    """(query_id, code, n) for answers (query_id, rank, video_id, frame_ids)."""
    frames = canonical.select("video_id", "frame_idx").distinct()
    lone = answers.select("query_id", "rank", "video_id", F.explode("frame_ids").alias("frame_idx")).join(frames, ["video_id", "frame_idx"], "left_anti").groupBy("query_id").agg(F.count("*").alias("n")).withColumn("code", F.lit("unknown_frame"))
    rows = answers.withColumn("_dup", F.row_number().over(W.partitionBy("query_id", "video_id", "frame_ids").orderBy("rank")))
    ascending = F.forall(F.zip_with(F.slice("frame_ids", 1, F.greatest(F.size("frame_ids") - 1, F.lit(0))), F.slice("frame_ids", 2, F.greatest(F.size("frame_ids") - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)
    codes = {"event_count": F.size("frame_ids") != events, "not_ascending": ~ascending, "repeated": F.col("_dup") > 1, "beyond_limit": F.col("rank") > MOST_ANSWERS}
    one = rows.groupBy("query_id").agg(*[F.count_if(c).alias(k) for k, c in codes.items()])
    flat = one.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("n")) for k in codes])).alias("x")).select("query_id", "x.*").where("n > 0")
    return flat.unionByName(lone.select("query_id", "code", "n"))


def submission_rows(answers: DataFrame, *, order: list) -> DataFrame:
    """(query_id, rank, video_id, frame_idx): repeats dropped, 1-based ranks, at most MOST_ANSWERS per query."""
    first = answers.withColumn("_d", F.row_number().over(W.partitionBy("query_id", "video_id", "frame_idx").orderBy(*order))).where("_d = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= MOST_ANSWERS).select("query_id", "rank", "video_id", "frame_idx")


def as_json(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, answers): a JSON array per query, in rank order."""
    got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("a"))
    return got.select("query_id", F.to_json(F.transform("a", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias("answers"))


def flatten_paths(results: DataFrame) -> DataFrame:
    """Results with ``path`` array<struct<frame_idx>> as frame_ids."""
    return results.withColumn("frame_ids", F.transform("path", lambda p: p["frame_idx"])).drop("path")


def csv_text(task: str, rows: list[tuple]) -> str:
    """Lines without a header: video,frame | video,frame,answer (100 characters) | video,f1,...,fn."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for r in rows:
        w.writerow([r[0], *r[1]] if task == "trake" else [r[0], r[1], r[2][:100]] if task == "qa" else r[:2])
    return out.getvalue()


def write_zip(task: str, answers: DataFrame, path: str) -> list[str]:
    """A package with one CSV per query, byte for byte the same for the same answers; returns the members.

    The driver gathers the answers: their number is checked against MOST_QUERIES * MOST_ANSWERS first.
    """
    cols = {"kis": ["video_id", "frame_idx"], "qa": ["video_id", "frame_idx", "answer"], "trake": ["video_id", "frame_ids"]}[task]
    kept = answers.where(F.col("rank") <= MOST_ANSWERS).select("query_id", "rank", *cols)
    most = MOST_QUERIES * MOST_ANSWERS
    if kept.limit(most + 1).count() > most:
        raise ValueError("too many answers for one package")
    by: dict[str, list] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(tuple(r[c] for c in cols))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for q in sorted(by):
            info = zipfile.ZipInfo(f"query-{q}-{task}.csv", date_time=(2024, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, csv_text(task, by[q]))
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        if len(names) != len(set(names)):
            raise ValueError("repeated members")
    return names


def ranked_rows(payload: DataFrame, *, json: str, task: str) -> DataFrame:
    """Rows (query_id, rank, video_id, frame...) of JSON {"queries": {id: [answers]}}; sequences keep their frames as JSON."""
    item = {"kis": "struct<video_id: string, frame_id: long>", "qa": "struct<video_id: string, frame_id: long, answer: string>", "trake": "struct<video_id: string, frame_ids: array<long>>"}[task]
    q = payload.select(F.explode(F.from_json(json, f"queries map<string, array<{item}>>")["queries"]).alias("query_id", "a"))
    flat = q.select("query_id", F.posexplode("a").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.*")
    return flat.withColumn("frame_ids", F.to_json("frame_ids")) if task == "trake" else flat


def summary(answers: DataFrame, problems: DataFrame) -> DataFrame:
    """(query_id, answers, videos, problems) per query."""
    a = answers.groupBy("query_id").agg(F.count("*").alias("answers"), F.countDistinct("video_id").alias("videos"))
    return a.join(problems.groupBy("query_id").agg(F.sum("n").alias("problems")), "query_id", "left").na.fill(0, ["problems"])
