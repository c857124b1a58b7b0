"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from codeloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, id long, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, 1, 2, "s") for i, x in rows], SCHEMA)


def brute(rows, k):
    ok = [(i, np.array(x, dtype=np.float32).astype(float)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float(v @ x), i) for i, x in ok if i != q))[:k]
    return out


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_recall_order_and_scores(spark, spread):
    rng = np.random.default_rng(int(spread * 10))
    x = rng.normal(size=(3000, 16)) * (1 + spread * rng.random((3000, 1)))
    x[500:900] = x[500]  # copies
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    want, got = brute(rows, 20), {}
    for r in ann.nearest(frame(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        value = {i: -s for s, i in want[q]}
        assert all(i != q for _, i, _ in found) and all(abs(value.get(i, s) - s) < 1e-9 for _, i, s in found)
        hits += len(set(value) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(want)


def test_few_odd_and_no_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0])]
    got = {}
    for r in ann.nearest(frame(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in got.items()} == {0: [(1, 20, 1.0), (2, 3, 0.5)], 20: [(1, 0, 1.0), (2, 3, 0.5)]}
    assert ann.nearest(frame(spark, rows[:0])).count() == 0
    assert ann.nearest(frame(spark, [(1, [1.0])])).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0])])).count() == 0


def test_queries_outside_hot_clusters_get_all_rows(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 6000)] + 0.02 * rng.normal(size=(6000, 16))
    far = rng.random(6000) < 0.02
    x[far] = rng.normal(size=(int(far.sum()), 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    got = {r["query_id"]: r["count"] for r in ann.nearest(frame(spark, rows), per_bucket=6, aim=0.5).groupBy("query_id").count().collect()}
    assert got == {q: 20 for q in range(0, 6000, 20)}
