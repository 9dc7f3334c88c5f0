"""Pairs, neighbours and DBSCAN over many blocks and small batches, against all pairs in NumPy."""

import numpy as np
import pytest

from vecloom.operators import dbscan as db
from vecloom.operators import pairs as prs

N = 700


def clustered(seed: int, n: int = N, groups: int = 12, dim: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + 40] = x[0]  # one vector many times
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain(seed: int, n: int = N, dim: int = 8) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x: np.ndarray):
    rows = [(3 * i + 1, i % 5, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "face_id long, grp int, vector array<double>").repartition(2)


@pytest.fixture(autouse=True)
def small_blocks_and_batches(spark, monkeypatch):
    """About 18 blocks, two partitions to pack them, and batches that end within blocks."""
    monkeypatch.setattr(prs, "BLOCK_ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(params=["clustered", "plain"])
def x(request):
    return {"clustered": clustered, "plain": plain}[request.param](4)


def all_pairs(x):
    d = 1.0 - x @ x.T
    i, j = np.triu_indices(len(x), 1)
    return 3 * i + 1, 3 * j + 1, d[i, j], i % 5 != j % 5


def test_blocks_are_whole(spark, x):
    for near in (False, True):
        packed = prs.blocks(frame(spark, x), near=near)[0].collect()
        assert len({r["block"] for r in packed}) == len(packed) > 10
        ids = np.concatenate([np.frombuffer(r["ids"], dtype="<i8") for r in packed])
        assert sorted(ids.tolist()) == [3 * i + 1 for i in range(N)]
        for r in packed:
            v = np.frombuffer(r["data"]).reshape(-1, x.shape[1])
            assert np.linalg.norm(v - np.array(r["centre"]), axis=1).max() <= r["radius"] + 1e-12


def test_pairs_within(spark, x):
    a, b, d, _ = all_pairs(x)
    for limit, euclidean in ((0.3, True), (0.05, False)):
        e = np.sqrt(2 * np.maximum(d, 0)) if euclidean else d
        hit = e <= limit
        got = prs.pairs_within(frame(spark, x), limit, euclidean).collect()
        assert sorted((r["a"], r["b"]) for r in got) == sorted(zip(a[hit].tolist(), b[hit].tolist(), strict=True))


def test_closest_pairs(spark, x):
    a, b, d, _ = all_pairs(x)
    got = [r["d"] for r in prs.closest_pairs(frame(spark, x), 30).collect()]
    assert np.allclose(got, np.sort(d)[:30], atol=1e-12)


def test_counts_and_histograms(spark, x):
    _, _, d, diff = all_pairs(x)
    counts = prs.pair_counts(frame(spark, x), "grp", [(-0.1, 2.1)], 16).collect()
    assert sum(r["n"] for r in counts) == len(d)
    assert abs(sum(r["total"] for r in counts) - d.sum()) < 1e-6
    assert sum(r["n"] for r in counts if r["is_diff"]) == diff.sum()
    got = {(r["bucket"], r["is_diff"]): r["n"] for r in prs.pair_histogram(frame(spark, x), "grp", 1).collect()}
    key, n = np.unique(np.floor(np.round(d, 9) * 10).astype(int) * 2 + diff, return_counts=True)
    assert got == {(int(k) >> 1, int(k) & 1): int(c) for k, c in zip(key, n, strict=True)}
    assert prs.pairs_in(frame(spark, x), "grp", [(0.2, 0.3)]).count() == ((d >= 0.2) & (d < 0.3)).sum()


def test_drawn_pairs(spark, x):
    _, _, d, _ = all_pairs(x)
    got = [r["d"] for r in prs.drawn_pairs(frame(spark, x), "grp", 10**6, 1).collect()]
    assert np.allclose(np.sort(got), np.sort(d), atol=1e-12)
    assert prs.drawn_pairs(frame(spark, x), "grp", 500, 1).count() == 500


def test_group_minima(spark, x):
    g, d = np.arange(N) % 5, 1.0 - x @ x.T
    want = {(p, q): d[np.ix_(g == p, g == q)].min() for p in range(5) for q in range(p + 1, 5)}
    for limit in (np.inf, 0.02):
        got = {(r["ga"], r["gb"]): r["d"] for r in prs.group_minima(frame(spark, x), "grp", limit).collect()}
        assert got.keys() == {k for k, v in want.items() if v < limit}
        assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("k", [1, 7, 60])
def test_neighbours(spark, x, k):
    """60 is more than a block holds: then everything is met."""
    d = 1.0 - x @ x.T
    np.fill_diagonal(d, np.inf)
    rows = prs.neighbours(frame(spark, x), k, euclidean=False).collect()
    got = {(r["face_id"], r["rank"]): r["d"] for r in rows}
    want = np.sort(d, axis=1)[:, :k]
    assert len(rows) == N * k and len({(r["face_id"], r["neighbour"]) for r in rows}) == N * k
    assert all(abs(got[3 * i + 1, c + 1] - want[i, c]) < 1e-9 for i in range(N) for c in range(k))


def test_few_blocks_meet_where_vectors_cluster(spark):
    assert prs.share_visited(frame(spark, clustered(4)), 0.3) < 0.3
    assert prs.share_visited(frame(spark, clustered(4)), 3.0) == 1.0


@pytest.mark.parametrize("eps,least", [(0.15, 3), (0.3, 5)])
def test_dbscan(spark, x, eps, least):
    near = np.sqrt(2 * np.maximum(1 - x @ x.T, 0)) <= eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    want, label = np.full(N, -1), 0
    for s in range(N):
        if core[s] and want[s] < 0:
            part, todo = {s}, [s]
            while todo:
                for t in np.flatnonzero(near[todo.pop()] & core).tolist():
                    if t not in part:
                        part.add(t)
                        todo.append(t)
            for t in part:
                want[t] = label
            label += 1
    for s in np.flatnonzero(~core):
        reach = want[near[s] & core]
        want[s] = reach.min() if len(reach) else -1
    got = {r["face_id"]: r["cluster_label"] for r in db.dbscan(frame(spark, x).select("face_id", "vector"), eps, least).collect()}
    assert [got[3 * i + 1] for i in range(N)] == want.tolist()
