"""The pruning k-NN join against brute force, for each metric, and what it leaves out."""

import numpy as np
import pytest

from lendflow.operators.pivots import pivot_knn, pivot_search


def _frame(spark, X, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(X)], "id long, vec array<double>")


def _brute(Q, C, k, metric, exclude_self):
    if metric == "l2":
        D = ((Q[:, None] - C[None]) ** 2).sum(axis=2)
    elif metric == "inner":
        D = -(Q @ C.T)
    else:
        D = 1 - (Q / np.linalg.norm(Q, axis=1)[:, None]) @ (C / np.linalg.norm(C, axis=1)[:, None]).T
    if exclude_self:
        D[np.arange(len(Q)), np.arange(len(Q))] = np.inf
    return [[(int(j), D[i, j]) for j in np.argsort(D[i], kind="stable")[:k] if np.isfinite(D[i, j])] for i in range(len(Q))]


def _same(hits, want):
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
    assert set(got) == {i for i, w in enumerate(want) if w}
    for i, w in enumerate(want):
        if w:
            assert [n for n, _ in got[i]] == [n for n, _ in w], i
            assert np.allclose([d for _, d in got[i]], [d for _, d in w], atol=1e-9)


def _clustered(rng, n, groups=20, dim=12):
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 5 + rng.normal(size=(n, dim)) * 0.3


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner"])
def test_equals_brute_force_and_leaves_pairs_out(spark, metric):
    X = _clustered(np.random.default_rng(3), 900)
    df = _frame(spark, X)
    hits, pairs = pivot_search(df, df, 7, query_id="id", exclude_self=True, metric=metric, pivots=40, block_rows=100)
    _same(hits, _brute(X, X, 7, metric, True))
    p = pairs.first()
    assert p.pairs_all == 900 * 900
    assert p.pairs_scored < p.pairs_all * {"l2": 0.25, "cosine": 0.25, "inner": 0.9}[metric]


def test_ties_repeats_and_a_cell_that_holds_nearly_all(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([np.zeros((300, 4)), rng.integers(0, 3, (60, 4)).astype(float)])
    df = _frame(spark, X)
    _same(pivot_knn(df, df, 5, query_id="id", exclude_self=True, pivots=8, block_rows=32), _brute(X, X, 5, "l2", True))


def test_few_rows_and_none(spark):
    X = np.array([[0.0, 1.0], [2.0, 0.0], [0.0, 3.0]])
    df = _frame(spark, X)
    _same(pivot_knn(df, df, 5, query_id="id", exclude_self=True), _brute(X, X, 5, "l2", True))
    nulls = df.unionByName(spark.createDataFrame([(9, None)], "id long, vec array<double>"))
    _same(pivot_knn(nulls, nulls, 2, query_id="id", metric="cosine"), _brute(X, X, 2, "cosine", False))
    hits, pairs = pivot_search(df, df.limit(0), 2, query_id="id")
    assert hits.collect() == [] and pairs.first().pairs_all == 0
    assert pivot_knn(df.limit(0), df, 2, query_id="id", metric="inner").collect() == []
    with pytest.raises(ValueError):
        pivot_knn(df, df, 2, query_id="id", metric="manhattan")


@pytest.mark.parametrize("metric", ["cosine", "inner"])
def test_vectors_are_not_copied_for_every_cell(spark, monkeypatch, metric):
    """Each round writes a query once, whatever the number of cells and blocks it meets, and blocks meet without a shuffle."""
    from lendflow.operators import pivots as module
    X = np.random.default_rng(6).normal(size=(150, 6))
    df = _frame(spark, X)
    written, write, met, meet = [], module.materialize, [], module.meet
    monkeypatch.setattr(module, "materialize", lambda d, tag: written.append((tag, write(d, tag))) or written[-1][1])
    monkeypatch.setattr(module, "meet", lambda *x: met.append(meet(*x)) or met[-1])
    hits = pivot_knn(df, df, 4, query_id="id", exclude_self=True, metric=metric, pivots=20, block_rows=5)
    _same(hits, _brute(X, X, 4, metric, True))
    rows = {"query-blocks": "q", "cell-blocks": "c"}
    assert [t.selectExpr(f"sum(size({rows[tag]}))").first()[0] for tag, t in written if tag in rows] == [150] * 3
    plans = [m._jdf.queryExecution().executedPlan().toString() for m in met]
    assert len(plans) == 2 and all("CartesianProduct" in p and "hashpartitioning" not in p for p in plans)


def test_bounds_of_a_block_lose_no_neighbour():
    from lendflow.operators.knn import _nearest
    rng = np.random.default_rng(9)
    Q, C = rng.integers(0, 3, (40, 3)).astype(float), rng.integers(0, 3, (300, 3)).astype(float)
    ids = np.arange(300)
    want = _nearest(np.arange(40), Q, ids, C, 5, True)
    kth = want[2].reshape(40, 5)[:, 4]
    for bound in (kth, kth + 0.5, np.where(np.arange(40) % 2, kth, np.inf)):
        assert all((a == b).all() for a, b in zip(want, _nearest(np.arange(40), Q, ids, C, 5, True, bound), strict=True))
