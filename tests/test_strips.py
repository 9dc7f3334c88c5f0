"""What leaves the tasks that compare blocks, and that blocks are read where they lie."""

import numpy as np
import pytest

from vecloom.operators import dbscan as db
from vecloom.operators import pairs as prs

N, DIM = 400, 6


@pytest.fixture
def x(monkeypatch):
    monkeypatch.setattr(prs, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, DIM))[rng.integers(0, 4, N)] + 0.1 * rng.normal(size=(N, DIM))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture
def left_tasks(monkeypatch):
    """Rows that each comparison of blocks has returned, in order."""
    seen, plain = [], prs.worked

    def counted(*args):
        out = plain(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(prs, "worked", counted)
    return seen


def frame(spark, x):
    return spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "face_id long, grp int, vector array<double>")


def test_blocks_are_not_copied_for_each_pair(spark, x):
    v = frame(spark, x)
    for found in (prs.pairs_within(v, 0.4), prs.neighbours(v, 3), prs.group_sums(v, "grp"), prs.pair_counts(v, "grp", [(-0.5, 2.5)], 64), prs.group_minima(v, "grp")):
        assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_put_together_what_they_find(spark, x, left_tasks):
    v = frame(spark, x)
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    sums = {(r["face_id"], r["grp"]): (r["total"], r["n"]) for r in prs.group_sums(v, "grp").collect()}
    assert len(sums) == 3 * N and all(abs(t - d[i, np.arange(N) % 3 == g].sum()) < 1e-4 and n == (np.arange(N) % 3 == g).sum() - (i % 3 == g) for (i, g), (t, n) in sums.items())
    assert left_tasks.pop() <= 2 * 3 * N  # before: once for each of 8 blocks
    prs.neighbours(v, 3).count()
    assert left_tasks.pop() <= 3 * 3 * N


def test_parts_are_linked_once(spark, x, left_tasks):
    """Four tight groups over many blocks: across blocks only parts are linked, not their vectors."""
    near = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)) <= 0.9
    got = {r["face_id"]: r["cluster_label"] for r in db.dbscan(frame(spark, x).select("face_id", "vector"), 0.9, 3).collect()}
    assert all(got[i] == got[j] >= 0 for i, j in zip(*np.nonzero(near), strict=True))
    assert len(left_tasks) == 4 and left_tasks[2] < N / 4  # counts, links within blocks and across, borders


def test_equal_parts_on_both_sides():
    """Part 1 of one block is linked with part 2 of the other, and with nothing else."""
    near = np.array([[False, True], [False, False]])
    node, root = db.stars(*db._by_part(near, np.array([1, 2]), np.array([1, 2])))
    assert (node.tolist(), root.tolist()) == ([2], [1])
