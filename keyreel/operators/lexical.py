"""Lexical scoring of batches of queries: postings, BM25, weighted coverage, quote matches and multi-view search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.functions.text import tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """(doc, term, tf): one row per document and distinct token."""
    return docs.select(F.col(id).alias("doc"), F.explode(tokens(text)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """(doc, len): token counts, empty documents included."""
    return docs.select(F.col(id).alias("doc"), F.size(tokens(text)).alias("len"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, *, id: str, text: str) -> DataFrame:
    """(query, term, qtf)."""
    return queries.select(F.col(id).alias("query"), F.explode(tokens(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, *, doc_id: str, doc_text: str, query_id: str, query_text: str) -> DataFrame:
    """(query, doc, bm25, coverage): documents that share a term with the query; all others score 0 and have no row.

    k1 1.2, b 0.75, idf log1p((N - df + .5) / (df + .5)), times the query's term frequency; the mean length runs over all
    documents. Coverage is the idf of the matched distinct terms over that of the query's terms known to the corpus. The
    query side joins the postings before anything is aggregated, so only matching postings are shuffled.
    """
    post = postings(docs, id=doc_id, text=doc_text)
    length = lengths(docs, id=doc_id, text=doc_text)
    asked = query_terms(queries, id=query_id, text=query_text)
    stats = length.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    hit = post.join(asked.select("term").distinct(), "term", "left_semi")
    idf = document_frequency(hit).crossJoin(F.broadcast(stats)).select("term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    weighed = asked.join(idf, "term")
    whole = weighed.groupBy("query").agg(F.sum("idf").alias("all_idf"))
    scored = hit.join(weighed, "term").join(length, "doc")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    sums = scored.groupBy("query", "doc").agg(F.sum(F.col("idf") * F.col("qtf") * tf).alias("bm25"), F.sum("idf").alias("matched"))
    return sums.join(whole, "query").select("query", "doc", "bm25", (F.col("matched") / F.col("all_idf")).alias("coverage"))


def top_ranked(scored: DataFrame, k: int, *, by: str, score: str, id: str) -> DataFrame:
    """The ``k`` best of each ``by`` by score descending, id ascending, with their rank."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), F.asc(id)))).where(F.col("rank") <= k)


def lexical_blend(scored: DataFrame) -> DataFrame:
    """Adds ``lexical`` = coverage + 0.05 * bm25 / (the query's best bm25)."""
    return scored.withColumn("lexical", F.col("coverage") + 0.05 * F.col("bm25") / F.max("bm25").over(W.partitionBy("query")))


def _longest_run(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> int:
        best, last = 0, {}
        for u in x:
            row = {}
            for j, v in enumerate(y):
                if u == v:
                    row[j] = last.get(j - 1, 0) + 1
                    best = max(best, row[j])
            last = row
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")


def longest_run(anchor: Column, document: Column) -> Column:
    """Length of the longest common contiguous run of two token arrays."""
    return F.pandas_udf(_longest_run, "long")(anchor, document)


def quote_score(a: Column, d: Column) -> Column:
    """Of the token arrays of an anchor and a document: 1 where the document's token string contains the anchor's, else the share of
    the anchor's tokens (as a multiset) that the document has. A common run is never longer than what is covered, so it needs no
    term of its own. Give columns that already hold the tokens: both sides are then tokenised once, before they are joined."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    covered = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(d, t)))
    phrase = F.instr(F.array_join(d, " "), F.array_join(a, " ")) > 0
    return F.when((F.size(a) == 0) | ~F.arrays_overlap(a, d), F.when((F.size(a) > 0) & phrase, 1.0).otherwise(0.0)).when(phrase, 1.0).otherwise(covered / F.size(a))


def multi_view(ranked: DataFrame, *, k: int, rrf_k: int = 60, lexical_weight: float = 1.25) -> DataFrame:
    """Reciprocal-rank fusion of ranked views (query, view, kind, doc, rank); kind 'lexical' weighs more; keeps the views as provenance."""
    w = F.when(F.col("kind") == "lexical", lexical_weight).otherwise(1.0) / (rrf_k + F.col("rank"))
    fused = ranked.groupBy("query", "doc").agg(F.sum(w).alias("rrf"), F.array_sort(F.collect_list(F.struct("view", "kind", "rank"))).alias("views"))
    return top_ranked(fused, k, by="query", score="rrf", id="doc")


def localise(ranked: DataFrame, *, per_video: int = 3, rrf_k: int = 60, lexical_weight: float = 1.25, quote_weight: float = 0.25) -> DataFrame:
    """Evidence inside shortlisted videos: rows (query, video_id, view, kind, doc, score, quote, pts_time, kf_n) ranked per (query, video, view, kind), fused, plus a
    quarter of the best quote score; the ``per_video`` best of each video by score, time, keyframe."""
    r = F.row_number().over(W.partitionBy("query", "video_id", "view", "kind").orderBy(F.desc("score"), "doc"))
    w = F.when(F.col("kind") == "lexical", lexical_weight).otherwise(1.0)
    fused = ranked.withColumn("_r", r).groupBy("query", "video_id", "doc", "pts_time", "kf_n").agg((F.sum(w / (rrf_k + F.col("_r"))) + quote_weight * F.coalesce(F.max("quote"), F.lit(0.0))).alias("score"))
    place = F.row_number().over(W.partitionBy("query", "video_id").orderBy(F.desc(F.round("score", 9)), "pts_time", "kf_n", "doc"))
    return fused.withColumn("place", place).where(F.col("place") <= per_video)
