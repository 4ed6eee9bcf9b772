"""Queries of the operators of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyreel.llm.garbled import find_garbled, garbled_flags, train_whole, validate_whole
from keyreel.llm.mixing import mix_sources
from keyreel.llm.nearest_time import nearest_in_time
from keyreel.llm.runs import collapse_runs
from keyreel.llm.similar_vectors import nearest_of_queries, similar_neighbours
from keyreel.llm.split_items import split_oversized
from keyreel.llm.subjects import assign_subjects, train_subjects
from keyreel.llm.tokens import count_tokens, encode_corpus
from keyreel.llm.top_n import top_n_per_group
from keyreel.session import table, tidy_id


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one modality with cosine of at least 0.90 of which one is among the ten most similar of the other."""
    near = similar_neighbours(table(spark, sf_dir, "text_vectors"), space="modality", row="embedding_row", vec="vec", dim=64, k=10, at_least=0.9)
    return near.select(F.col("space").alias("modality"), F.least("row", "neighbour").alias("row_a"), F.greatest("row", "neighbour").alias("row_b")).distinct()


def p1_ten_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors, however far, of every vector whose row is divisible by 20, against all rows."""
    near = nearest_of_queries(table(spark, sf_dir, "text_vectors"), space="modality", row="embedding_row", vec="vec", dim=64, k=10, query=F.col("embedding_row") % 20 == 0)
    return near.select(F.col("space").alias("modality"), F.col("row").alias("embedding_row"), "neighbour", "place")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every over-long or over-wide speech chunk."""
    return split_oversized(table(spark, sf_dir, "asr_global_merged_v2"), id="embedding_row", text="text", start="start", end="end")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech chunks that had to be cut."""
    return p2_pieces(spark, sf_dir).where("piece = 0").select("embedding_row")


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speech chunk with its nearest keyframe and the distance, or nulls."""
    asr = table(spark, sf_dir, "asr_global_merged_v2").withColumn("entity", tidy_id("video_id"))
    kf = table(spark, sf_dir, "global_keyframes").withColumn("entity", tidy_id("video_id"))
    middle = F.when(F.col("end") >= F.col("start"), (F.col("start") + F.col("end")) / 2)
    return nearest_in_time(asr, kf, left_id="embedding_row", left_entity="entity", left_time=middle, right_entity="entity", right_time="pts_time", payload="kf_n", tolerance=3.0)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech chunks with a keyframe within three seconds."""
    return p3_nearest(spark, sf_dir).where("kf_n IS NOT NULL").select("embedding_row", "kf_n")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of screen text that stays the same or nearly so, with count and duration; single rows are runs of one."""
    ocr = table(spark, sf_dir, "ocr_global_merged_v2").select(F.col("video_id"), "embedding_row", "pts_time", "kf_n", F.col("ocr_text").alias("text"))
    model, folds = train_whole(ocr)
    flagged = garbled_flags(ocr, "text", model, validate_whole(ocr, folds)).select("*", (~F.col("garbled")).alias("clean"), tidy_id("video_id").alias("entity"))
    return collapse_runs(flagged, row="embedding_row", entity="entity", time="pts_time", order="kf_n", text="text", usable="clean")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more rows."""
    return p4_runs(spark, sf_dir).where("n >= 2").select(F.col("entity").alias("video_id"), "first_row", "last_row")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled rows with the restored text where there is one."""
    names = {"asr_global_merged_v2": "text", "ocr_global_merged_v2": "ocr_text"}
    return find_garbled({n: (table(spark, sf_dir, n), "embedding_row", c) for n, c in names.items()})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled rows."""
    return p5_restored(spark, sf_dir).select("src_table", F.col("row_id").alias("embedding_row"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best results of every video."""
    rows = table(spark, sf_dir, "search_result").withColumn("entity", tidy_id("video_id"))
    top = top_n_per_group(rows, group="entity", score="score", n=5, ties=["rank"], row_id="result_id")
    return top.select(F.col("entity").alias("video_id"), "result_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document; doc_id is a key, so nothing is shuffled."""
    return encode_corpus(table(spark, sf_dir, "documents"), id="doc_id", text="text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = count_tokens(table(spark, sf_dir, "documents"), id="doc_id", text="text", keep=["source"])
    return mix_sources(docs, table(spark, sf_dir, "mix_targets"), id="doc_id", source="source", size="n_tokens")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of documents, in shuffled order."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mixed(spark, sf_dir)[1]


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_subjects(docs, table(spark, sf_dir, "doc_labels"), id="doc_id", text="text", subject="subject")
    return assign_subjects(docs, model, id="doc_id", text="text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that at least a third of a document's sentences deal with."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents and their part of all documents."""
    docs = table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("all"))
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents")).join(F.broadcast(docs)).select("subject", "documents", (F.col("documents") / F.col("all")).alias("part"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_ten_nearest": p1_ten_nearest,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p4_found": p4_found,
    "p4_runs": p4_runs,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_NEAREST = """
WITH k AS (SELECT upper(trim(video_id)) AS v, pts_time, min(kf_n) AS kf_n FROM global_keyframes WHERE pts_time IS NOT NULL AND trim(video_id) <> '' GROUP BY ALL),
a AS (SELECT DISTINCT embedding_row, upper(trim(video_id)) AS v, CASE WHEN "end" >= start THEN (start + "end") / 2 END AS m FROM asr_global_merged_v2),
n AS (SELECT embedding_row, arg_min(kf_n, (abs(pts_time - m), pts_time)) AS kf_n, min(abs(pts_time - m)) AS distance FROM a JOIN k USING (v) WHERE abs(pts_time - m) <= 3.0 GROUP BY 1)
"""

_VECTORS = """
WITH u AS (SELECT DISTINCT modality, embedding_row, vec::DOUBLE[] AS vec FROM text_vectors WHERE len(vec) = 64),
v AS (SELECT modality, embedding_row, vec, sqrt(list_dot_product(vec, vec)) AS norm FROM u WHERE isfinite(list_dot_product(vec, vec)) AND list_dot_product(vec, vec) > 0)
"""

SQL: dict[str, str] = {
    "p1_found": _VECTORS + """,
s AS (SELECT a.modality, a.embedding_row AS r, b.embedding_row AS o, list_dot_product(a.vec, b.vec) / (a.norm * b.norm) AS sim FROM v a JOIN v b ON a.modality = b.modality AND a.embedding_row <> b.embedding_row),
n AS (SELECT * FROM s WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY modality, r ORDER BY sim DESC, o) <= 10)
SELECT DISTINCT modality, least(r, o) AS row_a, greatest(r, o) AS row_b FROM n""",
    "p1_ten_nearest": _VECTORS + """,
s AS (SELECT a.modality, a.embedding_row AS r, b.embedding_row AS o, list_dot_product(a.vec, b.vec) / (a.norm * b.norm) AS sim FROM v a JOIN v b ON a.modality = b.modality AND a.embedding_row <> b.embedding_row WHERE a.embedding_row % 20 = 0)
SELECT modality, r AS embedding_row, o AS neighbour, row_number() OVER (PARTITION BY modality, r ORDER BY sim DESC, o) AS place FROM s QUALIFY place <= 10""",
    "p2_found": """SELECT DISTINCT embedding_row FROM asr_global_merged_v2 WHERE length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) > 480 OR "end" - start > 30""",
    "p3_found": _NEAREST + "SELECT embedding_row, kf_n FROM n",
    "p3_nearest": _NEAREST + "SELECT DISTINCT a.embedding_row, n.kf_n, n.distance FROM a LEFT JOIN n USING (embedding_row)",
    "p6_found": """
WITH r AS (SELECT DISTINCT upper(trim(video_id)) AS video_id, result_id, score, rank FROM search_result WHERE trim(video_id) <> '' AND isfinite(score))
SELECT video_id, result_id FROM r QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, rank, result_id) <= 5""",
}
