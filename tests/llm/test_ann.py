import dataclasses
import math

import numpy as np
from pyspark.sql import functions as F

from drawlog.llm import ann


def exact(rows, k, is_query):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in range(len(rows)):
        if is_query(ids[i]):
            s = (x * x[i]).sum(axis=1) / (n * n[i])
            s[ids == ids[i]] = -9
            out[ids[i]] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if s[j] > -5][:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)


def found(df, settings=ann.Settings(), step=50):
    out = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % step == 0, settings=settings).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = exact(rows, 5, lambda i: i % 50 == 0), found(df)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    scores = {q: dict(exact(rows, len(rows), lambda i: i == q)[q]) for q in list(want)[:3]}
    assert all(math.isclose(s, scores[q][i], abs_tol=1e-15) for q in scores for i, s in got[q])


def test_copies_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000 + i, [2 * x for x in rows[0][1]]) for i in range(20)]
    rows += [rows[0], rows[3]]
    full = ann.Settings(success=1.0, unit=16, bucket=64)
    assert found(table(spark, rows), full) == exact(rows, 5, lambda i: i % 50 == 0)


def test_edges(spark):
    nan = float("nan")
    bad = [(0, None), (50, [0.0, 0.0]), (100, [nan, 1.0]), (150, [float("inf"), 1.0]), (200, [None, 1.0]), (None, [1.0, 1.0]), (250, []), (300, [1.0, 2.0, 3.0])]
    assert found(table(spark, bad[:5])) == {}
    assert found(table(spark, [])) == {}
    good = [(350, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])]
    assert found(table(spark, bad + good), ann.Settings(success=1.0)) == {350: [(1, 1 / math.sqrt(2)), (2, 0.0)]} or found(table(spark, bad + good), ann.Settings(success=1.0))[350][0][0] == 1
    assert found(table(spark, [(50, [1.0, 1.0])])) == {}


def test_probes_come_in_order_of_success():
    rng = np.random.default_rng(2)
    index = ann.build_index(rng.standard_normal((200, 16)), 50_000, ann.Settings(success=1.0))
    x = rng.standard_normal(16)
    u = x / np.linalg.norm(x)
    codes = index.probes(u, 0)
    assert len(set(codes.tolist())) == len(codes) == 4 ** index.directions.shape[1]
    near = u + 0.3 * rng.standard_normal((4000, 16)) / 4
    place = {c: n for n, c in enumerate(codes.tolist())}
    ranks = [place[c] for c in index.buckets(near / np.linalg.norm(near, axis=1)[:, None], 0).tolist()]
    assert np.mean(np.array(ranks) < len(codes) // 4) > 0.8


def test_probes_reach_the_target_on_a_large_table():
    rng = np.random.default_rng(4)
    index = ann.build_index(rng.standard_normal((200, 64)), 200_000_000, ann.Settings())
    index = dataclasses.replace(index, likely=0.3)
    assert index.directions.shape[1] == 10
    held = []
    for _ in range(6):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        side = rng.standard_normal((4000, 64))
        side -= (side @ u)[:, None] * u
        near = 0.3 * u + math.sqrt(1 - 0.09) * side / np.linalg.norm(side, axis=1)[:, None]
        held.append(np.isin(index.buckets(near, 0), index.probes(u, 0)).mean())
    assert np.mean(held) >= 0.68


def test_recall_beside_clusters(spark):
    """Tight clusters set the likely cosine; queries that stand alone are found their neighbours as well."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    rows = [(i + 1 + i // 49, (centres[i % 40] + 0.25 * rng.standard_normal(32)).tolist()) for i in range(20_000)]
    alone = [(50 * (i + 1) + 10**6, rng.standard_normal(32).tolist()) for i in range(60)]
    want, got = exact(rows + alone, 5, lambda i: i > 10**6), found(table(spark, rows + alone))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(len(got[q]) == 5 for q in want)


def test_small_tables_whole(spark):
    rng = np.random.default_rng(7)
    for n in (2, 6, 10):
        rows = [(50 * i, rng.standard_normal(8).tolist()) for i in range(n)]
        got = found(table(spark, rows))
        assert {q: len(x) for q, x in got.items()} == {i: min(5, n - 1) for i, _ in rows}
        if n <= 6:
            want = exact(rows, 5, lambda i: True)
            assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_extreme_components(spark):
    """Components whose squares leave the range of a double, against the same vectors at a usual size."""
    usual = [(0, [1.0, 1.0]), (50, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-1.0, 1.0]), (3, [1.0, 1.01])]
    for factor in (1.0, 1e160, 1e-170, 1e300):
        got = found(table(spark, [(i, [factor * x for x in v]) for i, v in usual]))
        want = exact(usual, 5, lambda i: i % 50 == 0)
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for q in want for (_, a), (_, b) in zip(got[q], want[q]))
    mixed = found(table(spark, [(0, [1e160, 1e160]), (50, [1e-170, 1e-170]), (1, [1e160, 2e160]), (2, [1.0, 0.9])]))
    assert [i for i, _ in mixed[0]] == [50, 2, 1] and math.isclose(mixed[0][0][1], 1.0)
