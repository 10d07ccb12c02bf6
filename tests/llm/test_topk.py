import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlog.llm import topk

MOST = (1 << 63) - 1


def plain(rows, k, is_query, scale=256):
    """Every query against every row, in Python's whole numbers."""
    whole = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            whole.add((i, tuple(math.floor(x * scale) for x in v)))
    out = {}
    for q in {i for i, _ in whole if is_query(i)}:
        best = {}
        for a in (v for i, v in whole if i == q):
            for i, v in whole:
                if i != q:
                    score = max(-MOST - 1, min(MOST, sum(x * y for x, y in zip(a, v))))
                    best[i] = max(best.get(i, score), score)
        if best:
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df, settings=topk.Settings(), k=5, step=50):
    got = topk.top_inner(df, F.col("vec_id") % step == 0, k, settings=settings)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, score string, cell string").repartition(3)


SMALL = topk.Settings(pivots=12, sample=200, queries=7, vectors=30, strip=4, tasks=5)


def clustered(rng, clusters, each, dim, spread):
    centres = rng.standard_normal((clusters, dim))
    return [(i, (centres[i % clusters] + spread * rng.standard_normal(dim)).tolist()) for i in range(clusters * each)]


@pytest.mark.parametrize("settings", [SMALL, topk.Settings()])
def test_equals_all_pairs(spark, settings):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 20, 30, 8, 0.1)
    rows += [(1000 + i, rows[50][1]) for i in range(120)] + [(2000 + i, [100 * x for x in rows[3][1]]) for i in range(5)]
    rows += [(5000, [0.0] * 8), (5050, [0.001] * 8), (5100, (-np.ones(8)).tolist()), rows[0], rows[7]]
    assert found(table(spark, rows), settings, step=10) == plain(rows, 5, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (100, []), (150, None), (200, [nan, 1.0]), (250, [inf]), (300, [None, 1.0]), (None, [1.0, 1.0]), (1, [3.0, -1.0, 9.0]), (2, [1e307, 0.0]), (0, [-5.0, 1.0]), (1, [2.0, 2.0]), (1, [2.0, 2.0])]
    for settings in (SMALL, topk.Settings()):
        assert found(table(spark, rows), settings) == plain(rows, 5, lambda i: i % 50 == 0)
    large = [(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [-1e17, 0.5]), (3, [3e13, 7.0]), (4, [3e13, 7.004]), (50, [12345.678, -1e9]), (5, [1e300, 1e-300])]
    assert found(table(spark, large), SMALL) == plain(large, 5, lambda i: i % 50 == 0)
    assert found(table(spark, [])) == {}
    assert found(table(spark, [(1, [1.0])])) == {}
    assert found(table(spark, [(0, [1.0])])) == {}


def test_bounds_send_less_than_all():
    """Separate clusters: a query cell gets its own surroundings, and the bounds hold for every true neighbour."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.array([v for _, v in clustered(rng, 30, 100, 6, 0.02)]))
    x /= np.sqrt((x * x).sum(axis=1))[:, None] / 256
    unit = np.abs(x).max()
    top = np.sqrt(((x / unit) ** 2).sum(axis=1)).max()
    plan = topk.Plan(6, unit, top, np.zeros((0, 7)))
    plan = topk.Plan(6, unit, top, topk._pivots(plan.data(x), 40, 1))
    data, query = plan.data(x), plan.query(x[::10])
    (dc, df), (qc, qf) = plan.cells(data), plan.cells(query)
    held = {c: (int((dc == c).sum()), df[dc == c].min(), df[dc == c].max()) for c in np.unique(dc)}
    near = {c: sorted(df[dc == c])[:6] for c in held}
    wanted = {c: (int((qc == c).sum()), qf[qc == c].max()) for c in np.unique(qc)}
    sent, blocks = topk._send(plan.pivots, near, held, wanted, 6, len(x), topk.Settings(queries=20))
    place = {c: p for p, cells, _, _ in blocks for c in cells}
    goes = {(c, p): (low, high) for c, p, low, high in sent}
    total = 0
    for p in set(place.values()):
        total += sum(int(((dc == c) & (df >= low) & (df <= high)).sum()) for (c, at), (low, high) in goes.items() if at == p)
    assert total < 0.5 * len(x) * len(set(place.values()))
    scores = x[::10] @ x.T
    for q in range(len(query)):
        for i in np.argsort(-scores[q], kind="stable")[:6]:
            low, high = goes[dc[i], place[qc[q]]]
            assert low <= df[i] <= high
