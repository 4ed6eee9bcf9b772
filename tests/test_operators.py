"""Behaviour of core operators on small fixtures: ties, nulls, empty tables, repeated rows, clashing columns."""

import datetime as dt
import time as clock
import zipfile

import pytest
from pyspark.sql import functions as F

from keyreel.functions import text as T
from keyreel.operators import align, evaluate, evidence, fusion, lexical, quality, select, temporal
from keyreel.operators.orphans import LATER, NEVER, REMOVED, OrphanTracker, orphan_references
from keyreel.sources import ingest, submission
from keyreel.streaming import resume


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


REF = "ref_field string, video string, val long, t timestamp, name string"
PAR = "ref_field string, video string, val long, from_t timestamp, to_t timestamp"


def tracked(spark, refs, parents, cuts):
    """The orphans after a replay that is cut at the given days."""
    tracker, low = OrphanTracker(spark, {"name": "string"}), -1
    for n, until in enumerate(cuts):
        r = [x for x in refs if x[3] is None or low < (x[3] - day(0)).days <= until]
        p = [x[:5] for x in parents if low < ((x[5] if len(x) > 5 else x[4] or x[3]) - day(0)).days <= until]
        tracker.step(n, spark.createDataFrame(r, REF), spark.createDataFrame(p, PAR), F.lit(day(until)))
        low = until
    return tracker


def test_orphans_do_not_depend_on_periods(spark):
    refs = [("v", "A", 0, day(1), "early"), ("v", "A", 0, day(5), "fine"), ("v", "B", 0, day(9), "gone"), ("v", "C", 0, day(2), "never"), ("v", None, 0, day(2), "null"), ("v", "A", 0, None, "no time"), ("v", "A", 0, day(5), "fine again")]
    parents = [("v", "A", 0, day(3), None), ("v", "A", 0, day(3), None), ("v", "B", 0, day(0), None), ("v", "B", 0, day(0), day(7))]
    for cuts in ([20], [1, 4, 8, 20], [2, 9, 20]):
        got = rows(tracked(spark, refs, parents, cuts).orphans(), "name", "status")
        assert got == [("early", LATER), ("gone", REMOVED), ("never", NEVER)], cuts


def test_orphans_reopen_on_deletion(spark):
    refs = [("v", "A", 0, day(1), "x")]
    for going in (("v", "A", 0, day(3), day(6)), ("v", "A", 0, None, day(6))):
        tracker = tracked(spark, refs, [("v", "A", 0, day(3), None), going], [2, 4, 8])
        r = tracker.orphans().first()
        assert (r["status"], r["resolved_at"], r["reopened_at"]) == (LATER, day(3), day(6))
        assert rows(tracker.counts(), "period", "status", "orphans", "open") == [(0, NEVER, 1, 1), (1, LATER, 1, 0), (1, NEVER, 0, 0), (2, LATER, 1, 1)]


def test_a_deletion_in_a_later_period_makes_orphans(spark):
    for going in (("v", "A", 0, day(1), day(5)), ("v", "A", 0, None, day(5))):
        refs = [("v", "A", 0, day(2), "before"), ("v", "A", 0, day(6), "after"), ("v", "A", 0, day(9), "back")]
        tracker = tracked(spark, refs, [("v", "A", 0, day(1), None), going, ("v", "A", 0, day(8), None)], [3, 7, 20])
        assert rows(tracker.orphans(), "name", "status", "resolved_at") == [("after", REMOVED, day(8))]


def test_only_named_keys_are_judged_again(spark):
    refs = [("v", k, 0, day(1), k) for k in "ABC"]
    tracker = tracked(spark, refs, [("v", "A", 0, day(3), None)], [2, 4, 6])
    log = spark.read.parquet(f"{tracker.folder}/orphans")
    assert rows(log.groupBy("period").count()) == [(0, 3), (1, 1)]


def test_hot_keys_of_a_large_parent_index(spark, monkeypatch):
    from keyreel import session

    refs = [("v", "A", 0, day(5), f"a{i}") for i in range(50)] + [("v", "B", 0, day(1), "b"), ("v", "C", 0, day(1), "c")]
    parents = [("v", "A", 0, day(3), None), ("v", "B", 0, day(2), None)]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session, "HOT_ROWS", 10)
    assert rows(tracked(spark, refs, parents, [20]).orphans(), "name", "status") == [("b", LATER), ("c", NEVER)]


def test_a_stream_of_references_goes_on_after_a_restart(spark, tmp_path):
    events = spark.createDataFrame([("v", "A", 0, day(1), None, day(1)), ("v", "A", 0, None, day(5), day(5)), ("v", "C", 0, day(4), None, day(4))], f"{PAR}, at timestamp")
    files = [[("v", "A", 0, day(2), "before"), ("v", "C", 0, day(2), "c")], [("v", "A", 0, day(6), "after"), ("v", "B", 0, day(6), "b")]]
    for n, part in enumerate(files):
        spark.createDataFrame(part, REF).coalesce(1).write.mode("append").parquet(f"{tmp_path}/refs")
        stream = spark.readStream.schema(REF).parquet(f"{tmp_path}/refs")
        tracker = OrphanTracker(spark, {"name": "string"}, f"{tmp_path}/state")  # nothing is kept but the folder
        assert resume.track_orphans(stream, events, tracker, f"{tmp_path}/check").awaitTermination(60)
        assert len(tracker.orphans().collect()) == [1, 3][n]
    want = [("after", REMOVED), ("b", NEVER), ("c", LATER)]
    assert rows(tracker.orphans(), "name", "status") == want
    tracker.step(1, spark.createDataFrame(files[1], REF), events.where(F.col("at") > F.lit(day(2))).drop("at"), F.lit(day(6)))
    assert rows(tracker.orphans(), "name", "status") == want  # a batch that runs again changes nothing


def test_orphans_of_empty_tables(spark):
    tracker = OrphanTracker(spark, {"name": "string"})
    tracker.step(0, spark.createDataFrame([], REF), spark.createDataFrame([], PAR), F.lit(day(1)))
    assert tracker.orphans().count() == 0 and tracker.counts().count() == 0


def test_orphan_tables_with_nulls_repeats_and_extra_columns(spark, tmp_path):
    key = "ingested_at timestamp, t string, period int, val long"
    asr = [(1, " l1 ", 1, 10, day(2), "x", 1, 1), (1, " l1 ", 1, 10, day(9), "x", 1, 1), (2, None, 1, 10, day(2), None, None, None), (3, "L1", None, 99, day(2), "", 0, 0), (4, "L9", 1, 1, day(2), "", 0, 0), (5, "  ", 1, 1, day(2), "", 0, 0)]
    spark.createDataFrame(asr, f"embedding_row long, video_id string, kf_n long, frame_idx long, {key}").write.parquet(f"{tmp_path}/asr_global_merged_v2.parquet")
    spark.createDataFrame([], "result_id long, video_id string, kf_n long, frame_idx long, served_at timestamp").write.parquet(f"{tmp_path}/search_result.parquet")
    spark.createDataFrame([(7, "L1", 1, 10, day(1), None, None, None)], f"g long, video_id string, kf_n long, frame_idx long, {key}").write.parquet(f"{tmp_path}/global_keyframes.parquet")
    spark.createDataFrame([("l1", day(0), None), ("l1", day(0), None)], "video_id string, registered_at timestamp, removed_at timestamp").write.parquet(f"{tmp_path}/videos.parquet")
    for periods in (1, 4):
        got = orphan_references(spark, str(tmp_path), periods=periods)[0]
        assert rows(got, "ref_table", "row_key", "ref_field") == [("asr_global_merged_v2", 3, "frame_idx"), ("asr_global_merged_v2", 4, "video_id")]


def test_fold_and_tokens(spark):
    df = spark.createDataFrame([("Đường-DÂY số 5",), (None,), ("",)], "t string")
    got = [(r[0], r[1]) for r in df.select(T.fold("t"), T.tokens("t")).collect()]
    assert got == [("duong-day so 5", ["duong", "day", "so", "5"]), (None, []), ("", [])]
    assert df.select(T.fold_nfkc("t").alias("x")).first()[0] == "duong-day so 5"


def test_number_words():
    assert T.spoken_number("hai muoi lam".split()) == 25
    assert T.spoken_number("three hundred and five".split()) == 305
    assert T.spoken_number("hai nghin linh bon".split()) == 2004
    assert T.spoken_number(["xe"]) is None
    assert T.calculate("2 * (3 + 4) / 7") == 2.0 and T.calculate("__import__('os')") is None


def test_number_words_and_answers_that_are_none(spark):
    df = spark.createDataFrame([("seventy people and nineteen cars", "Unavailable"), ("hai mươi tư", "N/A"), ("x", "cannot be determined"), ("x", "seventy")], "t string, a string")
    assert [(r[0], r[1]) for r in df.select(T.spoken_numbers("t"), T.is_non_answer("a")).collect()] == [([70, 19], True), ([24], True), ([], True), ([], False)]


def test_text_decisions(spark):
    df = spark.createDataFrame([("Biển báo ghi chữ gì?",), ("How many cars?",), ("xin chào",), (None,)], "q string")
    assert [r[0] for r in df.select(T.question_type("q")).collect()] == ["screen_text", "count", "action", None]
    a = spark.createDataFrame([("unknown",), ("  ",), (None,), ("Hà Nội",), ('{"answer": "ba"}',)], "a string")
    assert [r[0] for r in a.select(T.is_non_answer("a")).collect()] == [True, True, True, False, False]
    assert a.select(T.answer_text("a")).collect()[-1][0] == "ba"
    one = spark.createDataFrame([('Tìm "cầu vượt mới" của UBND với 12 xe tải lớn',)], "q string")
    r = one.select(T.quoted_spans("q").alias("a"), T.acronyms("q").alias("b"), T.numeric_anchors("q").alias("c")).first()
    assert (r.a, r.b, r.c) == (["cầu vượt mới"], ["UBND"], ["12 xe tai lon"])
    assert T.leak_in({"a": [{"Answer": 1}]}) and not T.leak_in({"a": 1})


def test_bm25_counts_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, ""), (4, None)], "id int, t string")
    q = spark.createDataFrame([(1, "a zz")], "q int, s string")
    got = {r["doc"]: r["bm25"] for r in lexical.bm25(docs, q, doc_id="id", doc_text="t", query_id="q", query_text="s").collect()}
    assert set(got) == {1, 2} and got[2] > got[1]


def test_quote_score(spark):
    df = spark.createDataFrame([("cầu vượt", "trên CẦU VƯỢT mới"), ("a b c d", "x b c y"), ("", "x")], "a string, d string")
    df = df.select(T.tokens("a").alias("a"), T.tokens("d").alias("d"))
    assert [r[:] for r in df.select(lexical.quote_score(F.col("a"), F.col("d")), lexical.longest_run(F.col("a"), F.col("d"))).collect()] == [(1.0, 2), (0.5, 2), (0.0, 0)]


def test_repeated_hits_use_up_ranks(spark):
    h = spark.createDataFrame([(1, "c", "a", 3.0), (1, "c", "a", 2.0), (1, "c", "b", 1.0)], "query int, channel string, item string, score double")
    assert rows(fusion.ranked_hits(h, item="item", score="score"), "item", "rank") == [("a", 1), ("b", 3)]


def test_constant_scores(spark):
    h = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "query int, item int, s double")
    assert [r[0] for r in h.select(fusion.minmax("s", ["query"])).collect()] == [1.0, 1.0]
    assert [r["reranked"] for r in fusion.hard_negative(h, base="s", features={"s": 5.0}, item="item").orderBy("item").collect()] == [2.0, 2.0 - 1e-9]


def test_guard_blocks_lone_specialists(spark):
    r = [(1, "visual", f"v{i}", i) for i in range(1, 4)] + [(1, "asr", "weak", 9), (1, "asr", "strong", 2), (1, "asr", "both", 15), (1, "ocr", "both", 16)]
    ranks = spark.createDataFrame(r, "query int, channel string, video_id string, rank int")
    got = dict(rows(fusion.guarded_rrf(ranks, video="video_id", weights={}), "video_id", "guard"))
    assert got == {"v1": "visual", "v2": "visual", "v3": "visual", "strong": "strong", "both": "support"}
    saved = spark.createDataFrame([(1, "weak")], "query int, video_id string")
    assert "weak" in dict(rows(fusion.guarded_rrf(ranks, video="video_id", weights={}, rescued=saved), "video_id", "guard"))


def test_alignment_uses_the_real_timeline(spark):
    m = spark.createDataFrame([("v", 0.0, 1, 1.0, -1.0), ("v", 100.0, 2, 0.999, -1.0), ("v", 101.0, 3, -1.0, 0.997)], "v string, t double, f int, a double, b double")
    run = lambda axis: align.align(m, by=["v"], time="t", frame="f", events=["a", "b"], penalty=0.001, axis=axis).first()["path"]
    assert run("index") == [1, 3] and run("time") == [2, 3]


def test_alignment_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    data = [(v, float(t), t, *(rng.choice([None, *range(4)]) for _ in range(3))) for v in range(12) for t in sorted(rng.sample(range(30), 6))]
    df = spark.createDataFrame([(v, t, f, *(None if x is None else float(x) for x in s)) for v, t, f, *s in data], "v int, t double, f int, a double, b double, c double")
    got = {r["v"]: (r["score"], r["path"]) for r in align.align(df, by=["v"], time="t", frame="f", events=["a", "b", "c"], penalty=0.25).collect()}
    for v in range(12):
        mine = [x for x in data if x[0] == v]
        best = None
        for path in itertools.combinations(mine, 3):
            s = [p[3 + i] for i, p in enumerate(path)]
            if None not in s:
                total = sum(s) - 0.25 * (path[-1][1] - path[0][1])
                best = total if best is None else max(best, total)
        assert (v in got) == (best is not None)
        if best is not None:
            assert got[v][0] == pytest.approx(best)


def test_no_alignment_with_fewer_frames_than_events(spark):
    m = spark.createDataFrame([("v", 0.0, 1, 1.0, 1.0)], "v string, t double, f int, a double, b double")
    assert align.align(m, by=["v"], time="t", frame="f", events=["a", "b"], penalty=0.0).count() == 0


def test_nearest_row_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([("v", 5.0, 1), ("v", None, 2), ("w", 1.0, 3)], "v string, t double, id int")
    right = spark.createDataFrame([("v", 4.0, 9), ("v", 6.0, 8), ("v", None, 7)], "v string, u double, k int")
    got = rows(temporal.nearest_row(left, right, on="v", time="t", right_time="u", payload=["k"]), "id", "near_k")
    assert got == [(1, 9), (2, None), (3, None)]


def test_nearest_row_of_one_long_timeline(spark):
    n, inf, nan = 60_000, float("inf"), float("nan")
    left = spark.range(n).selectExpr("'v' AS v", "CAST(id AS DOUBLE) * 1.5 AS t", "id")
    right = spark.range(n).selectExpr("'v' AS v", "CAST(id AS DOUBLE) * 2 + 0.25 AS u", "id AS k")
    began = clock.time()
    got = temporal.nearest_row(left, right, on="v", time="t", right_time="u", payload=["k"]).agg(F.count("near_k"), F.max("distance")).first()
    assert got[0] == n and got[1] == 0.75
    assert clock.time() - began < 60  # windows that begin anew at each row take minutes
    far = spark.createDataFrame([("v", -1e7, 1), ("v", 5e6, 2), ("v", 9e6, 3), ("v", inf, 4), ("v", nan, 5), ("w", 700.0, 6)], "v string, t double, id int")
    few = spark.createDataFrame([("v", 0.0, 1), ("v", 1e7, 2), ("v", nan, 3), ("w", 5000.0, 4)], "v string, u double, k int")
    for earlier in (True, False):
        near = temporal.nearest_row(far, few, on="v", time="t", right_time="u", payload=["k"], earlier_on_tie=earlier)
        assert rows(near, "id", "near_k") == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (6, 4)]


def test_range_join_bounds_are_inclusive(spark):
    p = spark.createDataFrame([("v", 15.0)], "v string, t double")
    i = spark.createDataFrame([("v", 0.0, 0.0, 1), ("v", 30.0, 31.0, 2), ("v", 31.0, 32.0, 3), ("v", None, 1.0, 4), ("v", 20.0, 19.0, 5)], "v string, s double, e double, id int")
    assert rows(temporal.range_join(p, i, on="v", time="t", start="s", end="e", within=15.0), "id") == [(1,), (2,)]


def test_sessions_split_on_strictly_larger_gaps(spark):
    df = spark.createDataFrame([("v", float(t), i) for i, t in enumerate((0, 15, 30.5))], "v string, t double, id int")
    assert rows(temporal.sessions(df, by="v", time="t", order=["id"], gap=15.0), "id", "session") == [(0, 0), (1, 0), (2, 1)]


def test_neighbours_have_every_offset(spark):
    f = spark.createDataFrame([("v", i, float(i)) for i in range(9)], "v string, g int, t double")
    got = rows(temporal.neighbours(f.where("g = 4"), f, by="v", id="g", order=["t"], radius=3), "offset", "g")
    assert got == [(o, 4 + o) for o in (-3, -2, -1, 1, 2, 3)]


def test_sampling_and_peaks(spark):
    f = spark.createDataFrame([("v", i, float(i)) for i in range(30)], "v string, g int, t double")
    assert [r[0] for r in rows(temporal.sample_by_interval(f, by="v", time="t", id="g", interval=10.0), "g")] == [0, 10, 20]
    s = f.withColumn("s", F.when(F.col("g") == 5, 9.0).when(F.col("g") == 6, 8.0).when(F.col("g") == 20, 7.0).otherwise(0.0))
    got = [r["g"] for r in temporal.peaks(s, by=["v"], kf="g", time="t", score="s", most=2).orderBy("place").collect()]
    assert got == [5, 20]


def test_word_windows_overlap_and_break_at_gaps(spark):
    w = spark.createDataFrame([("v", f"w{i}", float(i), i + 0.9) for i in range(12)] + [("v", "far", 60.0, 61.0)], "v string, w string, s double, e double")
    got = [(r["s"], r["e"]) for r in temporal.word_windows(w, by="v", word="w", start="s", end="e").orderBy("chunk").collect()]
    assert got[0] == (0.0, 7.9) and got[1][0] <= 7.0 and got[-1] == (60.0, 61.0)
    assert all(e - s <= 8 for s, e in got)
    long = spark.createDataFrame([("v", f"w{i}", i * 0.5, i * 0.5 + 0.4) for i in range(9000)], "v string, w string, s double, e double")
    many = [(r["s"], r["e"]) for r in temporal.word_windows(long, by="v", word="w", start="s", end="e").orderBy("chunk").collect()]
    assert all(b[0] - a[0] == pytest.approx(many[1][0] - many[0][0]) for a, b in zip(many, many[1:-1])) and many[-1][1] == 4499.9


def test_relation_is_ambiguous_on_ties(spark):
    a = spark.createDataFrame([("v", 1.0, 5.0), ("w", 1.0, 5.0), ("w", 2.0, 5.0)], "v string, t double, s double")
    b = spark.createDataFrame([("v", 3.0, 5.0), ("w", 3.0, 5.0)], "v string, t double, s double")
    assert rows(align.relation(a, b, by="v", time="t", score="s")) == [("v", "before"), ("w", "ambiguous")]


def test_coverage_comes_before_depth(spark):
    c = [(1, 10 * v + k, f"v{v}", v, "visual" if k else "asr", 1.0 / (v + k + 1)) for v in range(4) for k in range(3)]
    df = spark.createDataFrame(c, "query int, item int, video_id string, video_rank int, source string, score double")
    got = select.allocate_reserved(df, budget=6).toPandas()
    assert set(got.video_id[:4]) == {"v0", "v1", "v2", "v3"} and got.video_id.value_counts().max() <= 2 and len(got) == 6


def test_claims_and_answers(spark):
    q = spark.createDataFrame([(1, 'Theo UBND "ba từ ở đây" có 3 xe tải')], "q int, t string")
    assert {r["kind"] for r in evidence.claims(q, id="q", text="t").collect()} >= {"quote", "acronym", "numeric"}
    e = spark.createDataFrame([("cold front", "The cold front weakens"), ("unknown", "x"), ("snow", "rain"), ("", "")], "a string, d string")
    assert [r[0] for r in e.select(evidence.answer_score(F.col("a"), F.col("d"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    ans = spark.createDataFrame([(1, "cold front", ["asr"]), (2, "cold front", ["ocr"]), (3, "unknown", [])], "id int, answer string, need array<string>")
    ev = spark.createDataFrame([(1, "asr", "a cold front"), (2, "asr", "a cold front")], "id int, source string, text string")
    assert rows(evidence.verify(ans, ev, id="id", answer="answer", required="need"), "id", "verdict") == [(1, "accepted"), (2, "unavailable"), (3, "unsafe")]


def test_evaluation(spark):
    r = spark.createDataFrame([(1,), (7,), (None,), (150,)], "rank int")
    assert [x[0] for x in r.select(evaluate.rank_bucket(F.col("rank"))).collect()] == ["r1_5", "r6_20", "unavailable", "gt_not_in_r100"]
    assert rows(evaluate.recall_at(r, [5, 20]), "k", "recall") == [(5, 0.25), (20, 0.5)]
    t = spark.createDataFrame([([1.0, 5.0], [2.0, 9.0])], "p array<double>, q array<double>")
    assert t.select(evaluate.tolerance_hits(F.col("p"), F.col("q"), 5.0), evaluate.tolerance_hits(F.col("p"), F.col("q"), 2.0)).first()[:] == (True, False)


def test_mapping_report_and_contradictions(spark):
    c = spark.createDataFrame([("v", 1, 10, 0.0)], "video_id string, kf_n long, frame_idx long, pts_time double")
    r = spark.createDataFrame([("v", 1, 10, 0.0), ("v", 1, 11, 0.0), ("v", 2, 1, 0.0), (None, 1, 1, 0.0), ("v", 1, 10, 9.0)], "video_id string, kf_n long, frame_idx long, pts_time double")
    assert sorted(x["mapping"] for x in quality.mapping_report(r, c).collect()) == ["frame_mismatch", "ok", "time_mismatch", "unknown_key", "unmapped"]
    assert quality.both_silent_and_seen(r, c).count() == 1


def test_map_csvs_to_canonical(spark, tmp_path):
    (tmp_path / "L21_V001.csv").write_text("n,frame_idx,pts_time\n1,0,0.0\n2,30,1.0\n")
    (tmp_path / "K01_V001.csv").write_text("n,frame_idx,pts_time\n1,0,0.0\n")
    raw = ingest.read_map_csvs(spark, str(tmp_path))
    assert ingest.repeated_videos(raw).count() == 0
    assert rows(ingest.canonical_map(raw), "g", "video_id", "kf_n") == [(0, "K01_V001", 1), (1, "L21_V001", 1), (2, "L21_V001", 2)]


def test_fill_mapping_and_priority(spark):
    c = spark.createDataFrame([("v", 1, 10, 0.0), ("v", 2, 20, 2.0)], "video_id string, kf_n long, frame_idx long, pts_time double")
    r = spark.createDataFrame([("v", 0.5, 1.5, None, None), ("v", 0.0, 9.0, 7, 70)], "video_id string, start double, `end` double, kf_n long, frame_idx long")
    assert rows(ingest.fill_mapping(r, c), "kf_n", "frame_idx") == [(1, 10), (7, 70)]
    m = ingest.merge_by_priority([(c, "new", 1), (c.withColumn("extra", F.lit(1)), "old", 2)], ["video_id", "kf_n"])
    assert {x["provenance"] for x in m.collect()} == {"new"}


def test_object_index(spark):
    j = '{"detection_scores": [0.9, 0.4, 0.7], "detection_class_entities": ["car", "car", " "]}'
    df = spark.createDataFrame([("v", 1, j), ("v", 2, "broken"), ("v", 3, None)], "video_id string, kf_n long, j string")
    assert [(r["label"], [tuple(h) for h in r["hits"]]) for r in ingest.object_index(df, video="video_id", kf="kf_n", json="j").collect()] == [("car", [(0.9, 1)])]


def test_submission_package(spark, tmp_path):
    a = spark.createDataFrame([("q1", 1, "v", 5), ("q1", 2, "w", 6), ("q2", 1, "v", 5)], "query_id string, rank int, video_id string, frame_idx long")
    names = submission.write_zip("kis", a, f"{tmp_path}/s.zip")
    assert names == ["query-q1-kis.csv", "query-q2-kis.csv"]
    assert zipfile.ZipFile(f"{tmp_path}/s.zip").read("query-q1-kis.csv") == b"v,5\nw,6\n"
    v = spark.createDataFrame([("10",), ("10.0",), ("true",), ("-1",), ("x",), ("1.5",)], "f string")
    assert [r[0] for r in v.select(submission.whole_frame(F.col("f"))).collect()] == [10, 10, None, None, None, None]
    s = spark.createDataFrame([("q", 1, "v", [5, 6]), ("q", 2, "v", [6, 5])], "query_id string, rank int, video_id string, frame_ids array<long>")
    c = spark.createDataFrame([("v", 5), ("v", 6)], "video_id string, frame_idx long")
    assert rows(submission.audit_sequences(s, c, events=2), "code", "n") == [("not_ascending", 1)]


def test_query_files(spark, tmp_path):
    (tmp_path / "query-7-trake.txt").write_text("A long scene\n\n1. first\n2. second\n")
    r = ingest.query_specs(spark, str(tmp_path)).first()
    assert (r["query_id"], r["task"], r["events"]) == ("7", "trake", ["first", "second"])
    (tmp_path / "q.json").write_text('{"queries": [{"query_id": "a", "task": "kis", "query": "x"}]}')
    assert ingest.query_specs(spark, f"{tmp_path}/q.json").first()["task"] == "kis"


def test_resumable_stream_runs_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    df.write.parquet(src)
    for _ in range(2):
        resume.materialise(spark, src, "id long, t string", out, ck, lambda b: b.withColumn("u", F.upper("t"))).awaitTermination()
    assert rows(spark.read.parquet(out), "id", "u") == [(1, "A"), (2, "B")]
    log = spark.createDataFrame([(1, 1, "error"), (1, 2, "success"), (2, 1, "error")], "id long, attempt int, status string")
    assert rows(resume.to_do(df, log, "id"), "id") == [(2,)]


def test_repair_and_gates(spark):
    df = spark.createDataFrame([("HÃ  Ná»™i".replace("Ã ", "Ã "),), ("Hà Nội",), (None,)], "t string")
    assert [r[0] for r in df.select(T.repair_mojibake("t")).collect()] == ["Hà Nội", "Hà Nội", None]
    q = spark.createDataFrame([("Logo của hãng nào?",), ("Bao nhiêu logo?",), ("Bài thơ gì?",), (None,)], "q string")
    assert [r[:] for r in q.select(T.wants_image_grounding("q"), T.is_poetry_question("q")).collect()] == [(True, False), (False, False), (False, True), (False, False)]


def test_stale_and_unknown_frames(spark):
    c = spark.createDataFrame([("v", 1, 10, 0.0), ("v", 2, 20, 2.0)], "video_id string, kf_n long, frame_idx long, pts_time double")
    p = spark.createDataFrame([(1, "v", 1, 10), (2, "v", 1, 99), (3, "v", 9, 1), (4, "v", 2, None)], "item int, video_id string, kf_n long, frame_idx long")
    assert rows(ingest.canonicalise(p, c), "item", "frame_idx", "trace") == [(1, 10, "kept"), (2, 10, "remapped"), (4, 20, "remapped")]
    r = spark.createDataFrame([(1, "v", 1, 0.0), (2, "v", 1, 5.0)], "id int, video_id string, kf_n long, pts_time double")
    assert rows(ingest.unique_evidence(r, c, id="id"), "id") == [(1,)]
    assert ingest.only_videos(p, None) is p and ingest.only_videos(p, c.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ingest.load_modality(p.withColumn("embedding_row", F.col("item").cast("long")).withColumn("pts_time", F.lit(0.0)), c)


def test_conflicting_rows_are_dropped_altogether(spark):
    r = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 9.0)], "k string, f int, s double")
    assert rows(fusion.dedupe_guarded(r, key=["k"], order=[F.desc("s")], place=["f"]), "k", "s") == [("a", 2.0)]


def test_verified_claims(spark):
    a = spark.createDataFrame([(1, "cold front"), (2, "cold front"), (3, "cold front")], "id int, answer string")
    met = spark.createDataFrame([(1, True), (2, True), (2, False), (3, True)], "id int, met boolean")
    ev = spark.createDataFrame([(1, "the cold front", False), (2, "the cold front", False), (3, "the cold front", True)], "id int, text string, is_claim boolean")
    assert rows(evidence.verify_claims(a, met, ev, id="id", answer="answer")) == [(1, "verified"), (2, "claims_open"), (3, "answer_unsupported")]


def test_speech_provider_payload(spark):
    j = '{"results": {"channels": [{"alternatives": [{"words": [{"word": "a", "punctuated_word": "A.", "start": 0.0, "end": 0.5}]}]}], "utterances": [{"transcript": "x", "start": 0.0, "end": 1.0}, {"transcript": "x", "start": 0.0, "end": 1.0}]}}'
    df = spark.createDataFrame([("v", j), ("w", "{}"), ("u", None), ("t", '{"results": {"channels": []}}')], "id string, j string")
    assert rows(temporal.provider_words(df, id="id", json="j")) == [("v", "A.", 0.0, 0.5)]
    assert rows(temporal.provider_utterances(df, id="id", json="j")) == [("v", "x", 0.0, 1.0)]


def test_ranked_json(spark):
    j = '{"queries": {"q": [{"video_id": "v", "frame_ids": [1, 2]}]}}'
    df = spark.createDataFrame([(j,)], "j string")
    assert rows(submission.ranked_rows(df, json="j", task="trake")) == [("q", 1, "v", "[1,2]")]


def test_rescue_needs_rank_and_score(spark):
    p = "array<struct<mode: string, rank: int, score: double, view: string>>"
    df = spark.createDataFrame([([("quote", 2, 0.1, "a")],), ([("soft", 2, 0.5, "a")],), ([("soft", 2, 0.9, "b")],), ([("soft", 9, 0.9, "b")],), (None,)], f"p {p}")
    assert [r[0] for r in df.select(fusion.rescue_reason(F.col("p"), modes=["quote", "soft"])).collect()] == ["quote:a:2", None, "soft:b:2", None, None]
