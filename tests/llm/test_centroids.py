"""k-means with ns-bounds against full scans in plain Python integers."""

import hashlib
import math
import random

import pytest

from areascope.llm import centroids


def brute(rows, dim, k, rounds, scale=1024, salt="3"):
    """{position of a kept row: (cluster, distance)}, final centroids."""
    kept = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) == dim and all(e is not None and math.isfinite(e) for e in v):
            kept[i] = [math.floor(scale * e) for e in v]
    key = lambda i: hashlib.sha256(f"{salt}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()
    c = [list(kept[i]) for i in sorted(kept, key=lambda i: (key(i), kept[i]))[:k]]

    def assign():
        return {i: min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c)) for i, x in kept.items()}

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [kept[i] for i in own if own[i][1] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return {i: (j, d) for i, (d, j) in assign().items()}, c


def table(spark, rows, extra=True):
    schema = "vec_id bigint, embedding array<double>" + (", block bigint, state string, x string, cluster string, ids string" if extra else "")
    return spark.createDataFrame([(*r, 1, "s", "x", "c", "i") if extra else tuple(r) for r in rows], schema).repartition(3)


def check(spark, rows, dim, k, rounds):
    got = centroids.cluster(table(spark, rows), dim=dim, k=k, rounds=rounds)
    exp, c = brute(rows, dim, k, rounds)
    count = lambda xs: sorted(xs, key=repr)
    assert count((r["id"], r["cluster"], r["distance"]) for r in got.rows.collect()) == count((rows[i][0], j, d) for i, (j, d) in exp.items())
    assert got.history[-1].tolist() == c
    return got


def test_clusters_equal_full_scans(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(3 * (i % 4), 1.0) for _ in range(5)]) for i in range(400)]
    got = check(spark, rows, 5, 6, 7)
    assert len(got.rescanned) == 6 and got.rescanned[-1] < 400        # the bounds spare rows


def test_clusters_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (None, [0.0, 0.0]), (None, [0.1, 0.0]), (3, None), (4, []), (5, [1.0]),
            (6, [1.0, None]), (7, [nan, 0.0]), (8, [0.0, -inf]), (9, [0.0, 0.0, 0.0]), (10, [-0.0001, 0.0001]), (11, [65536.0, -65536.0]),
            (12, [0.0, 1.0]), (13, [1.0, 0.0]), (14, [0.5, 0.0]), (14, [0.0, 0.5])]
    check(spark, rows, 2, 3, 4)
    check(spark, rows, 2, 30, 3)                       # fewer vectors than clusters, equal centroids


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1, 1, 3, -1, 5, 4, 2, 2, 0])]
    for rounds in (0, 1, 2, 5):
        check(spark, rows, 1, 4, rounds)


def test_empty_and_far_vectors(spark):
    got = centroids.cluster(table(spark, [(1, None)]), dim=2)
    assert got.rows.count() == 0 and centroids.digest(got).columns[-1] == "centroid_sha256" and centroids.digest(got).count() == 0
    with pytest.raises(Exception, match="would not fit 64 bits"):
        centroids.cluster(table(spark, [(1, [1e9, 0.0])]), dim=2).rows.collect()


def test_rounds_move_no_vectors(spark):
    """Vectors and state are bucketed alike: their join has no exchange."""
    import re

    df = table(spark, [(i, [float(i % 7), 1.0]) for i in range(50)], extra=False)
    vectors = centroids.integer_vectors(df, dim=2)
    store = centroids._Store(spark, 4)
    packed = store.put(centroids._pack(vectors, 2).repartition(4, "block"))
    state = store.put(centroids._round(packed, centroids.np.array([[[0, 0], [3000, 0]]]), 2))
    plan = packed.join(state.select("block", "state").hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
    store.close()
    assert not re.search(r"\bExchange\b", plan) and "SortMergeJoin" in plan


def test_bounds_are_safe_over_long_histories():
    rng = centroids.np.random.default_rng(0)
    x = rng.integers(-3000, 3000, (300, 4))
    history = rng.integers(-3000, 3000, (1, 5, 4))
    bounds = centroids.Bounds(300, 5)
    bounds.scan(centroids.np.arange(300), x, history)
    for t in range(40):
        step = rng.integers(-40, 41, (1, 5, 4)) * (t % 7 != 3)
        history = centroids.np.concatenate((history, history[-1:] + step))
        bounds.assign(x, history)
        assert (bounds.own == centroids.distances(x, history[-1]).argmin(axis=1)).all()
        bounds = centroids.Bounds(300, 5, bounds.dump())
