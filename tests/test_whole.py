"""Queries over all their rows, and operators against the uncut computation."""

import numpy as np
import pytest

from keyreel.operators import dense, select
from keyreel.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.sql()

def test_every_timed_keyframe_has_a_speech_score(spark, sf_dir):
    from keyreel.plans.base import canonical

    want = {r["g"] for r in canonical(spark, sf_dir).where("pts_time IS NOT NULL").select("g").collect()}
    assert {r["g"] for r in QUERIES["local_speech_score"](spark, sf_dir).collect()} == want


def test_sql_names_no_part_of_the_keyframes():
    assert not [n for n, q in SQL.items() if "kf_n %" in q or "vec_id IN" in q]


def test_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "ITEM_BLOCK", 7)
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (60, 64)).astype(float)
    v[10] = v[50] = v[3]
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [1.0])], "id long, v array<double>").repartition(3)
    got = {}
    for r in dense.search(df, df.where("id < 20 OR id >= 60"), id="id", vec="v", query_id="id", query_vec="v", k=4, normalise=False).collect():
        got.setdefault(int(r["query"]), {})[r["rank"]] = (r["id"], r["score"])
    s = v @ v.T
    want = {q: {n + 1: (i, s[q, i]) for n, i in enumerate(sorted((i for i in range(60) if i != 7), key=lambda i: (-s[q, i], i))[:4])} for q in range(20) if q != 7}
    assert got == want
    every = dense.score_all(df, df.where("id IN (3, 61)"), vec="v", query_id="id", query_vec="v", keep=["id"]).collect()
    assert {(r["query"], r["id"]): r["score"] for r in every} == {(q, i): s[3, i] if q == 3 and i < 60 else None for q in (3, 61) for i in range(62)}


def walk(rows, budget, reserve, per_video, adaptive):
    """The walk over all rows (query, item, video_id, video_rank, source, score) of one query."""
    chosen, used = {}, {}

    def take(r, why):
        if len(chosen) < budget and r[1] not in chosen and used.get(r[2], 0) < per_video:
            chosen[r[1]] = (r[0], r[1], len(chosen) + 1, why)
            used[r[2]] = used.get(r[2], 0) + 1

    rows = sorted(rows, key=lambda r: (r[3], -r[5], r[1]))
    floor = budget - max(1, budget // 6) if adaptive else budget
    for r in rows:
        if len(chosen) < floor and not used.get(r[2]):
            take(r, "coverage")
    for s in ("asr", "ocr"):
        for r in [r for r in sorted(rows, key=lambda r: (-r[5], r[1])) if r[4] == s and r[1] not in chosen][:reserve]:
            take(r, f"reserved_{s}")
    for r in rows:
        take(r, "depth")
    return list(chosen.values())


@pytest.mark.parametrize("budget, reserve, per_video, adaptive, videos", [(24, 1, 2, True, 130), (12, 3, 3, True, 60), (6, 1, 1, False, 40), (24, 2, 2, False, 20), (24, 2, 1, True, 90)])
def test_reservations_against_the_uncut_walk(spark, budget, reserve, per_video, adaptive, videos):
    rng = np.random.default_rng(videos)
    rows = [(q, 10_000 * q + 100 * v + i // 2, f"v{v}", v + 1, ("visual", "asr", "ocr")[int(rng.integers(3))], float(rng.integers(40))) for q in range(4) for v in range(videos) for i in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "query int, item int, video_id string, video_rank int, source string, score double")
    got = select.allocate_reserved(df, budget=budget, reserve=reserve, per_video=per_video, adaptive=adaptive).select("query", "item", "place", "why").collect()
    assert sorted(map(tuple, got)) == sorted(x for q in range(4) for x in walk([r for r in rows if r[0] == q], budget, reserve, per_video, adaptive))
