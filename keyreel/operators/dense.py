"""Exact dense search: matrix products of blocks of items and blocks of queries, k best per task, k best overall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a block of queries and in a block of items; their scores are held at once.
QUERY_BLOCK, ITEM_BLOCK = 512, 2048


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, inside the JVM; for pairs that are already together."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(c: Column) -> Column:
    """The unit vector; null for an all-zero or non-finite one."""
    n = F.sqrt(dot(c, c))
    return F.when((n > 0) & (n < float("inf")), F.transform(c, lambda x: x.cast("double") / n))


def valid_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has the dimension and is finite and not zero."""
    n = dot(F.col(vec), F.col(vec))
    return df.where((F.size(vec) == dim) & (n > 0) & (n < float("inf")))


def _pack(size: int, dim: int):
    """Batches of columns and a last column of vectors, as blocks of ``size``: the columns in Arrow's format, the vectors as doubles; null ones and those of another dimension are NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vecs = part.column(part.num_columns - 1)
                good = np.array([n == dim for n in pc.list_value_length(vecs).to_pylist()])
                v = np.full((part.num_rows, dim), np.nan)
                if good.any():
                    v[good] = vecs.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (rest := part.select(range(part.num_columns - 1))).schema) as w:
                    w.write_batch(rest)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([good.tobytes()], pa.binary())], ["cols", "vecs", "good"])

    return run


def _blocks(items: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """Every block of items beside every block of queries (last columns: arrays of doubles). Queries are few to an item block's many and are brought together first."""
    schema = "cols binary, vecs binary, good binary"
    i = items.mapInArrow(_pack(ITEM_BLOCK, dim), schema)
    q = queries.repartition(queries.columns[0]).mapInArrow(_pack(QUERY_BLOCK, dim), schema)
    return i.crossJoin(q.select(*(F.col(c).alias(f"q_{c}") for c in ("cols", "vecs", "good"))))


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    """(columns, vectors, usable) of the items and the same of the queries, for every pair of blocks in a batch."""
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        sides = []
        for cols, vecs, good in (row[:3], row[3:]):
            with pa.ipc.open_stream(cols) as r:
                sides += [r.read_all().combine_chunks(), np.frombuffer(vecs).reshape(-1, dim), np.frombuffer(good, bool)]
        yield (*sides, row[3])


def search(items: DataFrame, queries: DataFrame, *, id: str, vec: str, query_id: str, query_vec: str, k: int, normalise: bool = True, dim: int = 64) -> DataFrame:
    """(query, id, score, rank): the ``k`` items with the highest inner product (to nine places) for every query, ties by id ascending.

    Blocks of items meet blocks of queries, as many as there are; a task keeps the k best of each query while the blocks
    stream by. Items and queries that are null, of another dimension, zero or not finite take no part.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for cols, v, _, asked, q, _, key in _unpacked(batch, dim):
                if normalise:
                    v, q = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
                s = q @ v.T
                ids = np.broadcast_to(cols.column(0).to_numpy(), s.shape)
                if key in kept:
                    s, ids = np.hstack([kept[key][1], s]), np.hstack([kept[key][2], ids])
                top = np.lexsort((ids, -np.round(s, 9)), axis=1)[:, :k]
                kept[key] = (asked.column(0), np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1))
        for names, s, ids in kept.values():
            m = s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names.to_pylist(), dtype=object), m), pa.string()), pa.array(ids.ravel(), pa.int64()), pa.array(s.ravel()), pa.array(np.round(s, 9).ravel())], ["query", "id", "score", "_o"])

    i = valid_vectors(items, vec, dim).select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    q = valid_vectors(queries, query_vec, dim).select(F.col(query_id).cast("string").alias("query"), F.col(query_vec).cast("array<double>").alias("vec"))
    found = _blocks(i, q, dim).mapInArrow(best, "query string, id long, score double, _o double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("_o"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query", F.col("id").alias(id), "score", "rank")


def score_all(items: DataFrame, queries: DataFrame, *, vec: str, query_id: str, query_vec: str, keep: list[str], dim: int = 64) -> DataFrame:
    """(query, the item's columns ``keep``, score): every item with every query and their inner product to twelve places, block by block; null where a vector is null or of another dimension."""
    kinds = dict(items.dtypes)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols, v, fine, asked, q, asked_fine, _ in _unpacked(batch, dim):
                s = np.round(v @ q.T, 12)
                of_item, of_query = np.repeat(np.arange(len(v)), len(q)), np.tile(np.arange(len(q)), len(v))
                score = pa.array(s.ravel(), mask=~(fine[:, None] & asked_fine[None, :]).ravel(), from_pandas=False)
                got = [asked.column(0).take(pa.array(of_query)), *(c.take(pa.array(of_item)) for c in cols.columns), score]
                yield from pa.Table.from_arrays(got, ["query", *keep, "score"]).to_batches(max_chunksize=50_000)

    i = items.select(*keep, F.col(vec).cast("array<double>").alias("_vec"))
    q = queries.select(F.col(query_id).alias("query"), F.col(query_vec).cast("array<double>").alias("_vec"))
    return _blocks(i, q, dim).mapInArrow(product, ", ".join([f"query {dict(queries.dtypes)[query_id]}", *(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def per_video(scored: DataFrame, *, video: str, frame: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best frames of every (query, video), ties by frame."""
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query", video).orderBy(F.desc(score), frame))).where(F.col("place") <= k)


def clip_scores(scored: DataFrame, *, video: str, frame: str, order: str, alpha: float = 0.5, shortlist: int = 20) -> DataFrame:
    """(video, frame, top3, best, smooth5, hybrid) of a clip's frames as queries: mean of the three best queries, best query, the best smoothed over five
    places with the edge values repeated, and their blend; only in the ``shortlist`` videos with the largest top3."""
    from keyreel.operators.temporal import smooth

    got = scored.groupBy(video, frame, order).agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3).alias("_x"))
    got = got.select(video, frame, order, (F.aggregate("_x", F.lit(0.0), lambda a, x: a + x) / F.size("_x")).alias("top3"), F.get("_x", F.lit(0)).alias("best"))
    keep = got.groupBy(video).agg(F.max("top3").alias("m")).orderBy(F.desc(F.round("m", 9)), video).limit(shortlist)
    out = smooth(got.join(F.broadcast(keep.select(video)), video, "left_semi"), by=[video], order=[order, frame], value="best", width=5)
    return out.select(video, frame, "top3", "best", F.col("smoothed").alias("smooth5"), (alpha * F.col("top3") + (1 - alpha) * F.col("smoothed")).alias("hybrid"))
