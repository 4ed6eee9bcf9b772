"""Queries: text expressions, lexical search, claims, verification, evaluation and submission rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyreel.functions import text as T
from keyreel.operators import evaluate, evidence, lexical, temporal
from keyreel.plans.base import CANON, HITS, SCREEN, SPEECH, canonical, fold_sql, hits, screen, speech, tokens_sql
from keyreel.session import table
from keyreel.sources import submission

#: The queries put to the corpus.
ASKED = {1: "hội đồng xét xử", 2: "the cold front", 3: "cổ phiếu ngành thép", 4: "goalkeeper saved the home side", 5: "đèn tín hiệu giao thông"}


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASKED.items()), "query int, asked string")


_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in ASKED.items()) + ") t(query, asked))"


def token_df(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and total frequency of every token of the speech texts."""
    p = lexical.postings(speech(spark, d), id="embedding_row", text="text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and coverage of five queries over all speech chunks, twenty each."""
    s = lexical.bm25(speech(spark, d), _asked(spark), doc_id="embedding_row", doc_text="text", query_id="query", query_text="asked")
    s = s.withColumn("bm25", F.round("bm25", 6)).withColumn("coverage", F.round("coverage", 6))
    return lexical.top_ranked(s, 20, by="query", score="bm25", id="doc")


def lexical_blend(spark: SparkSession, d: str) -> DataFrame:
    """Coverage with a little BM25, twenty each."""
    s = lexical.bm25(screen(spark, d), _asked(spark), doc_id="embedding_row", doc_text="ocr_text", query_id="query", query_text="asked")
    return lexical.top_ranked(lexical.lexical_blend(s).select("query", "doc", F.round("lexical", 6).alias("lexical")), 20, by="query", score="lexical", id="doc")


def multiview_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Speech chunks ranked by BM25 and by coverage, fused with weights."""
    s = lexical.bm25(speech(spark, d), _asked(spark), doc_id="embedding_row", doc_text="text", query_id="query", query_text="asked").withColumn("bm25", F.round("bm25", 6)).withColumn("coverage", F.round("coverage", 6))
    a = lexical.top_ranked(s, 50, by="query", score="bm25", id="doc").select("query", F.lit("bm25").alias("view"), F.lit("dense").alias("kind"), "doc", "rank")
    b = lexical.top_ranked(s, 50, by="query", score="coverage", id="doc").select("query", F.lit("coverage").alias("view"), F.lit("lexical").alias("kind"), "doc", "rank")
    out = lexical.multi_view(a.unionByName(b), k=20)
    return out.select("query", "doc", F.round("rrf", 6).alias("rrf"), "rank")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """(query, embedding_row, a, d): token arrays of every text and every quote, each tokenised once."""
    s = speech(spark, d).where("text IS NOT NULL").select("embedding_row", T.tokens("text").alias("d"))
    return s.join(F.broadcast(_asked(spark).select("query", T.tokens("asked").alias("a"))))


def quote_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold at least eight tenths of a quote."""
    return _quotes(spark, d).select("query", "embedding_row", F.round(lexical.quote_score(F.col("a"), F.col("d")), 6).alias("score")).where("score >= 0.8")


def quote_match(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold at least half of a quote, with their longest common run."""
    q = _quotes(spark, d).withColumn("score", F.round(lexical.quote_score(F.col("a"), F.col("d")), 6)).where("score >= 0.5")
    return q.select("query", "embedding_row", "score", lexical.longest_run(F.col("a"), F.col("d")).alias("run"))


def asr_search(spark: SparkSession, d: str) -> DataFrame:
    """Best chunk per query and video by BM25, with its keyframe's frame."""
    s = bm25(spark, d).select("query", F.col("doc").alias("embedding_row"), "bm25")
    j = s.join(speech(spark, d), "embedding_row").where("video_id IS NOT NULL")
    best = j.withColumn("r", F.row_number().over(W.partitionBy("query", "video_id").orderBy(F.desc("bm25"), "embedding_row"))).where("r = 1")
    return best.join(canonical(spark, d).select("video_id", "kf_n", F.col("frame_idx").alias("frame")), ["video_id", "kf_n"], "left").select("query", "video_id", "embedding_row", "bm25", "frame")


def folded_text(spark: SparkSession, d: str) -> DataFrame:
    """Folded document texts: length and number of distinct tokens."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    return t.select("doc_id", F.length(T.fold("text")).alias("folded_length"), F.size(F.array_distinct(T.tokens("text"))).alias("distinct_tokens"))


def question_types(spark: SparkSession, d: str) -> DataFrame:
    """Question types of the documents of query logs and answers."""
    t = table(spark, d, "documents").where("lower(trim(source)) IN ('query_log', 'qa_answer') AND text IS NOT NULL").select("doc_id", "text").distinct()
    return t.select("doc_id", T.question_type("text").alias("kind"), T.plan_of(T.question_type("text")).alias("plan"), F.array_join(T.specialist_routes("text"), ",").alias("routes"), T.tool_class("text").alias("tool"))


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality flags of the screen texts, counted per pack."""
    q = screen(spark, d).select("source_pack", T.quality_flags("ocr_text").alias("q"))
    return q.groupBy("source_pack").agg(*[F.count_if(F.col(f"q.{c}")).alias(c) for c in ("blank", "replacement", "long")])


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Quoted spans, acronyms, numbers, names and query views of the queries in the corpus."""
    t = table(spark, d, "documents").where("lower(trim(source)) = 'query_log' AND text IS NOT NULL").select("doc_id", "text").distinct()
    return t.select("doc_id", T.quote_atoms("text").alias("quotes"), T.acronyms("text").alias("acronyms"), T.numeric_anchors("text").alias("numeric"), T.spoken_numbers("text").alias("spoken"), T.query_views(F.col("text"), F.lit("where")).alias("views"))


def claim_division(spark: SparkSession, d: str) -> DataFrame:
    """Videos in which every claim of a query is met by some chunk."""
    asked = spark.createDataFrame([(1, '"hội đồng xét xử" tuyên'), (2, 'Upper Tarnfold and "the cold front"'), (3, "Dunmere Quay")], "query int, asked string")
    c = evidence.claims(asked, id="query", text="asked")
    s = speech(spark, d).where("video_id IS NOT NULL AND text IS NOT NULL").select("video_id", "text").distinct().join(F.broadcast(c))
    scored = s.withColumn("score", evidence.claim_score(F.col("kind"), F.col("claim"), F.col("text")))
    return evidence.claim_division(scored, c, query="query", video="video_id")


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Five speech rows around every keyframe by word overlap, then distance."""
    a = canonical(spark, d).where("pts_time IS NOT NULL").select(F.col("g").alias("anchor"), "video_id", F.col("pts_time").alias("at"), F.lit(ASKED[2]).alias("query"))
    s = speech(spark, d).where("text IS NOT NULL").select("video_id", "start", "end", "text", "embedding_row")
    out = evidence.select_rows(a, s, anchor="anchor", on="video_id", time="at", query="query", start="start", end="end", text="text", row="embedding_row", within=15.0, limit=5)
    return out.select("anchor", "embedding_row", "overlap", F.round("distance", 6).alias("distance"), "place")


def answer_support(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that support a given answer."""
    s = speech(spark, d).where("text IS NOT NULL")
    a = F.lit("cold front")
    return s.select("embedding_row", F.round(evidence.answer_score(a, F.col("text")), 6).alias("score"), evidence.support(a, F.col("text")).alias("support")).where("score > 0")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of queries whose most frequent video comes up within k."""
    return evaluate.recall_at(_first_rank(spark, d), [1, 5, 10, 20]).withColumn("recall", F.round("recall", 6))


def _first_rank(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d)
    truth = h.groupBy("query_id", "video_id").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.max(F.struct("n", "video_id")).alias("t")).select("query_id", F.col("t.video_id").alias("truth"))
    return h.join(truth, "query_id").groupBy("query_id", "channel").agg(F.min(F.when(F.col("video_id") == F.col("truth"), F.col("rank"))).alias("rank"))


def rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Failure taxonomy of the first relevant rank per kind of query."""
    return evaluate.failure_taxonomy(_first_rank(spark, d).withColumn("rank", F.col("rank") * 3), rank="rank", stage="channel")


def paired_selection(spark: SparkSession, d: str) -> DataFrame:
    """Two scores per video, the second chosen where it leads by 0.05."""
    h = hits(spark, d)
    a = h.where("channel = 'kis'").groupBy("video_id").agg(F.max("score").alias("score"))
    b = h.where("channel = 'vkis'").groupBy("video_id").agg(F.max("score").alias("score"))
    return evaluate.paired(a, b, query="video_id", score="score")


def percentile_latency(spark: SparkSession, d: str) -> DataFrame:
    """95th percentile of the last thousand values per event type."""
    return evaluate.latest_percentile(table(spark, d, "events").withColumn("o", F.struct("ts", "event_id")), by="event_type", time="o", value="value")


def submission_rows(spark: SparkSession, d: str) -> DataFrame:
    """Ranked rows of every query, repeats dropped."""
    h = hits(spark, d).where("frame_idx IS NOT NULL")
    return submission.submission_rows(h, order=[F.desc("score"), F.asc("result_id")])


def submission_audit(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the served rows as they stand."""
    h = hits(spark, d).where("frame_idx IS NOT NULL").select("query_id", F.col("result_id").alias("rank"), "video_id", "frame_idx")
    return submission.audit(h.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))), canonical(spark, d), task="kis")


def submission_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a JSON array per query."""
    return submission.as_json(submission_rows(spark, d), ["video_id", "frame_idx"])


def localised_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Three speech rows per query and video, ranked by BM25 and by coverage inside each video and fused."""
    s = lexical.bm25(speech(spark, d), _asked(spark), doc_id="embedding_row", doc_text="text", query_id="query", query_text="asked")
    s = s.join(speech(spark, d).select(F.col("embedding_row").alias("doc"), "video_id", "pts_time", "kf_n"), "doc").where("video_id IS NOT NULL")
    views = F.explode(F.array(F.struct(F.lit("bm25").alias("view"), F.lit("dense").alias("kind"), F.round("bm25", 6).alias("score")), F.struct(F.lit("coverage").alias("view"), F.lit("lexical").alias("kind"), F.round("coverage", 6).alias("score"))))
    rows = s.select("query", "video_id", "doc", "pts_time", "kf_n", views.alias("v"), F.lit(0.0).alias("quote")).select("query", "video_id", "doc", "pts_time", "kf_n", "v.*", "quote")
    return lexical.localise(rows).select("query", "video_id", "doc", F.round("score", 6).alias("score"), "place")


def local_speech_score(spark: SparkSession, d: str) -> DataFrame:
    """Best length of a chunk within 60 seconds of every keyframe, 0 without one."""
    f = canonical(spark, d).where("pts_time IS NOT NULL")
    s = speech(spark, d).where("text IS NOT NULL").select("video_id", "start", "end", F.length("text").cast("double").alias("score"))
    return temporal.best_in_reach(f, s, on="video_id", frame="g", time="pts_time", start="start", end="end", score="score")


def verse_events(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of verse-like screen lines with words of a query near them."""
    rows = screen(spark, d).where("ocr_text IS NOT NULL").select("video_id", "pts_time", "kf_n", F.col("ocr_text").alias("text"))
    context = speech(spark, d).where("text IS NOT NULL AND video_id IS NOT NULL AND pts_time IS NOT NULL").select("video_id", "pts_time", "kf_n", "text")
    return evidence.verse_events(rows, context, query=F.lit(ASKED[1])).select("video_id", "cluster", "n", F.round("score", 6).alias("score"), "place")


def repaired_text(spark: SparkSession, d: str) -> DataFrame:
    """Screen texts that a plain repair of wrong decodings changes."""
    s = screen(spark, d).where("ocr_text IS NOT NULL").select("embedding_row", "ocr_text", T.repair_mojibake("ocr_text").alias("repaired"))
    return s.where("repaired <> ocr_text").select("embedding_row", "repaired")


_IDX = f"""t AS (SELECT embedding_row AS doc, @tok AS toks FROM @src), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM t) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({tokens_sql('asked')}) AS term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT query, term, qtf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM q JOIN df USING (term), st),
al AS (SELECT query, sum(idf) AS al FROM w GROUP BY query),
sc AS (SELECT w.query, p.doc, sum(idf * qtf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))) AS bm25, sum(idf) / any_value(al) AS coverage FROM p JOIN w USING (term) JOIN t USING (doc) JOIN al ON al.query = w.query GROUP BY ALL)"""
_SPEECH_IDX = f"{SPEECH}, {_ASKED}, " + _IDX.replace("@tok", tokens_sql("text")).replace("@src", "speech")
_SCREEN_IDX = f"{SCREEN}, {_ASKED}, " + _IDX.replace("@tok", tokens_sql("ocr_text")).replace("@src", "screen")
_BM = f"{_SPEECH_IDX}, b AS (SELECT query, doc, round(bm25, 6) AS bm25, round(coverage, 6) AS coverage FROM sc), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc) AS rank FROM b)"
_FIRST = f"{HITS}, c AS (SELECT query_id, video_id, count(*) AS n FROM hits GROUP BY ALL), tr AS (SELECT query_id, arg_max(video_id, (n, video_id)) AS truth FROM c GROUP BY query_id), f AS (SELECT query_id, channel, min(CASE WHEN video_id = truth THEN rank END) AS rank FROM hits JOIN tr USING (query_id) GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (token_df, bm25, lexical_blend, multiview_rrf, quote_coverage, quote_match, asr_search, folded_text, question_types, text_quality, anchors, claim_division, evidence_rows, answer_support, recall_at_k, rank_buckets, paired_selection, percentile_latency, submission_rows, submission_audit, submission_json, localised_evidence, local_speech_score, verse_events, repaired_text)}
SQL = {
    "token_df": f"WITH {SPEECH}, t AS (SELECT embedding_row, unnest({tokens_sql('text')}) AS term FROM speech), p AS (SELECT embedding_row, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "bm25": f"WITH {_BM} SELECT query, doc, bm25, coverage, rank FROM r WHERE rank <= 20",
    "lexical_blend": f"WITH {_SCREEN_IDX}, b AS (SELECT query, doc, round(coverage + 0.05::DOUBLE * bm25 / max(bm25) OVER (PARTITION BY query), 6) AS lexical FROM sc) SELECT query, doc, lexical, row_number() OVER (PARTITION BY query ORDER BY lexical DESC, doc) AS rank FROM b QUALIFY rank <= 20",
    "multiview_rrf": f"""WITH {_BM}, v AS (SELECT query, doc, rank, 1.0::DOUBLE AS w FROM r WHERE rank <= 50 UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY coverage DESC, doc) AS rank, 1.25::DOUBLE FROM b QUALIFY rank <= 50),
f AS (SELECT query, doc, sum(w / (60 + rank)) AS rrf FROM v GROUP BY ALL) SELECT query, doc, round(rrf, 6) AS rrf, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, doc) AS rank FROM f QUALIFY rank <= 20""",
    "quote_coverage": f"""WITH {SPEECH}, {_ASKED}, j AS (SELECT query, embedding_row, {tokens_sql('asked')} AS a, {tokens_sql('text')} AS d FROM speech, asked WHERE text IS NOT NULL),
s AS (SELECT query, embedding_row, CASE WHEN contains(array_to_string(d, ' '), array_to_string(a, ' ')) THEN 1.0 ELSE list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(d, lambda y: y = x))))) / len(a) END AS score FROM j)
SELECT query, embedding_row, round(score, 6) AS score FROM s WHERE score >= 0.8""",
    "asr_search": f"""WITH {CANON}, {_BM}, j AS (SELECT query, doc AS embedding_row, bm25 FROM r WHERE rank <= 20), k AS (SELECT j.*, s.video_id, s.kf_n FROM j JOIN speech s USING (embedding_row) WHERE s.video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query, s.video_id ORDER BY bm25 DESC, embedding_row) = 1)
SELECT query, k.video_id, embedding_row, bm25, c.frame_idx AS frame FROM k LEFT JOIN canon c ON c.video_id = k.video_id AND c.kf_n = k.kf_n""",
    "folded_text": f"SELECT DISTINCT doc_id, length({fold_sql('text')})::INTEGER AS folded_length, len(list_distinct({tokens_sql('text')}))::INTEGER AS distinct_tokens FROM documents WHERE text IS NOT NULL",
    "text_quality": f"WITH {SCREEN} SELECT source_pack, count(*) FILTER (coalesce(trim(regexp_replace(ocr_text, '\\s+', ' ', 'g')) = '', true)) AS blank, count(*) FILTER (contains(ocr_text, chr(65533))) AS replacement, count(*) FILTER (length(ocr_text) > 480) AS long FROM screen GROUP BY source_pack",
    "evidence_rows": f"""WITH {CANON}, {SPEECH}, a AS (SELECT g AS anchor, video_id, pts_time AS t FROM canon WHERE pts_time IS NOT NULL),
j AS (SELECT anchor, embedding_row, start, len(list_intersect(list_distinct({tokens_sql("'" + ASKED[2] + "'")}), list_distinct({tokens_sql('text')})))::INTEGER AS overlap, CASE WHEN t BETWEEN start AND "end" THEN 0.0 ELSE least(abs(t - start), abs(t - "end")) END AS distance
FROM a JOIN speech s ON a.video_id = s.video_id AND "end" >= start AND start - 15 <= t AND "end" + 15 >= t WHERE text IS NOT NULL),
r AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY overlap DESC, distance, embedding_row) <= 5)
SELECT anchor, embedding_row, overlap, round(distance, 6) AS distance, row_number() OVER (PARTITION BY anchor ORDER BY start, embedding_row) AS place FROM r""",
    "recall_at_k": f"WITH {_FIRST}, k AS (SELECT unnest([1, 5, 10, 20]) AS k) SELECT k, count(*) AS queries, round(avg(CASE WHEN rank <= k THEN 1 ELSE 0 END), 6) AS recall FROM f, k GROUP BY k",
    "rank_buckets": f"WITH {_FIRST} SELECT channel, CASE WHEN rank IS NULL THEN 'unavailable' WHEN rank * 3 <= 5 THEN 'r1_5' WHEN rank * 3 <= 20 THEN 'r6_20' WHEN rank * 3 <= 100 THEN 'r21_100' ELSE 'gt_not_in_r100' END AS bucket, count(*) AS queries FROM f GROUP BY ALL",
    "paired_selection": f"""WITH {HITS}, x AS (SELECT video_id, max(score) FILTER (channel = 'kis') AS a, max(score) FILTER (channel = 'vkis') AS b FROM hits WHERE channel IN ('kis', 'vkis') GROUP BY video_id)
SELECT video_id, a, b, CASE WHEN a IS NULL OR b IS NULL THEN 'unpaired' WHEN b - a >= 0.05 THEN 'b' ELSE 'a' END AS chosen FROM x""",
    "percentile_latency": """WITH r AS (SELECT * FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000), i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, value AS percentile, n FROM i WHERE i = floor(0.95 * (n - 1))""",
    "submission_rows": f"""WITH {HITS}, d AS (SELECT * FROM hits WHERE frame_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame_idx ORDER BY score DESC, result_id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS rank, video_id, frame_idx FROM d QUALIFY rank <= 100""",
    "submission_audit": f"""WITH {CANON}, {HITS}, c AS (SELECT DISTINCT video_id, frame_idx FROM canon), h AS (SELECT query_id, h.video_id, h.frame_idx, row_number() OVER (PARTITION BY query_id ORDER BY result_id) AS rank FROM hits h WHERE frame_idx IS NOT NULL),
j AS (SELECT h.*, c.video_id IS NULL AS unknown, row_number() OVER (PARTITION BY query_id, h.video_id, h.frame_idx ORDER BY rank) AS dup FROM h LEFT JOIN c ON h.video_id = c.video_id AND h.frame_idx = c.frame_idx),
x AS (SELECT query_id, unnest(['unknown_frame', 'repeated', 'beyond_limit', 'bad_frame']) AS code, unnest([count(*) FILTER (unknown), count(*) FILTER (dup > 1), count(*) FILTER (rank > 100), count(*) FILTER (frame_idx < 0)]) AS n FROM j GROUP BY query_id) SELECT * FROM x WHERE n > 0""",
    "localised_evidence": f"""WITH {_SPEECH_IDX}, b AS (SELECT query, doc, round(bm25, 6) AS bm25, round(coverage, 6) AS coverage, s.video_id, s.pts_time, s.kf_n FROM sc JOIN speech s ON s.embedding_row = sc.doc WHERE s.video_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query, video_id ORDER BY bm25 DESC, doc) AS r1, row_number() OVER (PARTITION BY query, video_id ORDER BY coverage DESC, doc) AS r2 FROM b),
f AS (SELECT *, 1.0::DOUBLE / (60 + r1) + 1.25::DOUBLE / (60 + r2) AS score FROM r)
SELECT query, video_id, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query, video_id ORDER BY round(score, 9) DESC, pts_time NULLS FIRST, kf_n NULLS FIRST, doc) AS place FROM f QUALIFY place <= 3""",
    "local_speech_score": f"""WITH {CANON}, {SPEECH}, f AS (SELECT * FROM canon WHERE pts_time IS NOT NULL)
SELECT f.g, coalesce(max(length(text)), 0)::DOUBLE AS score FROM f LEFT JOIN speech s ON f.video_id = s.video_id AND s.text IS NOT NULL AND s."end" >= s.start AND s.start - 60 <= f.pts_time AND s."end" + 60 >= f.pts_time GROUP BY f.g""",
}
