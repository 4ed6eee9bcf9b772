"""The number of windows a vector keeps its recall as the arrays grow in number."""

import numpy as np

from keyreel.llm import similar_vectors as v


def recall(directions, tails):
    need = v.windows_needed(directions, 64, 0.9, pairs=3000, seed=7)
    return np.searchsorted(need, tails, side="right") / len(need)


def test_recall_does_not_fall_with_size():
    want = recall(v.LEAST_DIRECTIONS, v.TAILS)
    assert recall(8192, v.TAILS) < want - 0.005
    assert recall(8192, v.tails_for(8192, 64, 0.9)) > want - 0.003


def test_pairs_with_many_arrays(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.vstack((x, 0.905 * x + (1 - 0.905**2) ** 0.5 * y))
    df = spark.createDataFrame([("asr", i, u.tolist()) for i, u in enumerate(both)], "s string, r long, v array<float>")
    got = v.similar_pairs(df, space="s", row="r", vec="v", dim=64, k=10, at_least=0.9, directions=8192)[0].count()
    assert got >= (recall(v.LEAST_DIRECTIONS, v.TAILS) - 0.005) * 1500
