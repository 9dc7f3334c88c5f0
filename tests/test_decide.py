"""Boundaries and rules of the decisions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import calibrate as cal
from vecloom.operators import centroids as cen
from vecloom.operators import decide as dec
from vecloom.operators import incremental as inc

MEMBER = "run_label string, face_id long, identity string, cluster_label int, vector array<double>"


def at(angle):
    return [math.cos(angle), math.sin(angle), 0.0]


def at_distance(d):
    return at(math.acos(1 - d))


def members(spark, rows):
    return spark.createDataFrame([("default", i, who, c, v) for i, who, c, v in rows], MEMBER)


def faces(spark, m):
    return m.select(F.col("face_id").alias("id"), "identity", F.concat(F.lit("p/"), "face_id").alias("image_path"))


def decide(spark, m, v, t=dec.Thresholds()):
    q = spark.createDataFrame([(99, v)], "face_id long, vector array<double>")
    return dec.recommend(q, m, cen.centroids(m), faces(spark, m), t).head()


@pytest.fixture(scope="module")
def wide(spark):
    return members(spark, [(1, "a", 0, at(0.9)), (2, "a", 0, at(-0.9)), (3, "b", 1, [0.0, 0.0, 1.0]), (4, "b", 1, [0.0, 0.0, 1.0])])


def test_zones(spark, wide):
    assert decide(spark, wide, at_distance(0.29))["status"] == "auto_merge"
    assert decide(spark, wide, at_distance(0.31))["status"] == "ask_user"
    r = decide(spark, wide, at_distance(0.46))
    assert (r["status"], r["nearest_cluster_label"]) == ("new_cluster", 0)


def test_bounds_are_open(spark, wide):
    d = decide(spark, wide, at_distance(0.3))["distance"]
    assert decide(spark, wide, at_distance(0.3), dec.Thresholds(t1=d))["status"] == "ask_user"
    assert decide(spark, wide, at_distance(0.3), dec.Thresholds(t1=0.1, t2=d))["status"] == "new_cluster"


def test_singleton_demotes(spark):
    m = members(spark, [(1, "a", 0, at(0.0))])
    r = decide(spark, m, at_distance(0.05))
    assert (r["status"], r["auto_merge_demoted"]) == ("ask_user", True)


def test_tie_goes_to_the_lowest_label(spark):
    m = members(spark, [(1, "a", 7, at(0.5)), (2, "b", 3, at(-0.5))])
    assert decide(spark, m, at(0.0))["nearest_cluster_label"] == 3


def test_without_centroids(spark, wide):
    none = wide.where("false")
    q = spark.createDataFrame([(99, at(0.0))], "face_id long, vector array<double>")
    r = dec.recommend(q, none, cen.centroids(none), faces(spark, wide)).head()
    assert (r["status"], r["reason"], r["nearest_cluster_label"], r["distance"]) == ("new_cluster", "no_existing_clusters", None, None)


def test_batch_bounds_are_closed_and_new_clusters_have_no_target(spark, wide):
    d = dec.batch_tier(members(spark, [(9, "x", 0, at_distance(0.18))]), wide).head()
    tiers = (d["dist"], 0.4)
    assert dec.batch_tier(members(spark, [(9, "x", 0, at_distance(0.18))]), wide, tiers).head()["action"] == "AUTO_MERGE"
    far = dec.batch_tier(members(spark, [(9, "x", 0, [0.0, -1.0, 0.0])]), wide).head()
    assert (far["action"], far["target"]) == ("NEW_CLUSTER", None)
    none = dec.batch_tier(members(spark, [(9, "x", 0, at(0.0))]), wide.where("false")).head()
    assert (none["action"], none["target"], none["dist"]) == ("NEW_CLUSTER", None, 1.0)


def test_pairs_flagged_by_members_alone(spark):
    m = members(spark, [(1, "a", 0, at(0.0)), (2, "a", 0, at(1.4)), (3, "b", 1, at(1.5)), (4, "b", 1, at(3.0))])
    r = dec.suspicious_pairs(m, cen.centroids(m), faces(spark, m)).head()
    assert r["centroid_distance"] > 0.45 > r["min_member_distance"] and r["auto_mergeable"]


def test_pairs_of_an_empty_run(spark, wide):
    none = wide.where("false")
    assert dec.suspicious_pairs(none, cen.centroids(none), faces(spark, wide)).count() == 0


def test_member_cap(spark):
    m = members(spark, [(i, "a", 0, at(i / 100)) for i in range(70)])
    assert dec.capped_members(m).count() == 50
    assert {r[0] for r in dec.capped_members(m).select("face_id").collect()} == {r[0] for r in dec.capped_members(m).select("face_id").collect()}


def test_merge_keeps_members_and_rejects_nonsense(spark, wide):
    c = cen.centroids(wide)
    moved, cents = cen.merge_clusters(wide, c, 0, 1)
    assert moved.count() == wide.count() and [r["n_members"] for r in cents.collect()] == [4]
    with pytest.raises(ValueError):
        cen.merge_clusters(wide, c, 1, 1)
    with pytest.raises(ValueError):
        cen.merge_clusters(wide, c, 8, 9)


def test_centroids_have_unit_norm(spark, wide):
    for r in cen.centroids(wide).collect():
        assert math.hypot(*r["centroid"]) == pytest.approx(1)


def test_blocked_and_shipped_centroids_agree(spark, wide, monkeypatch):
    q = spark.createDataFrame([(i, at(i / 7)) for i in range(30)], "face_id long, vector array<double>")
    c = cen.centroids(wide)
    a = sorted(map(tuple, cen.nearest_centroid(q, c, 2).collect()))
    monkeypatch.setattr(cen, "SHIP_BYTES", 0)
    b = sorted(map(tuple, cen.nearest_centroid(q, c, 2).collect()))
    assert [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b])


def test_assignment_drifts_and_switches_the_representative(spark):
    m = members(spark, [(1, "a", 0, at(0.0)), (2, "a", 0, at(0.4))])
    c = cen.centroids(m)
    out = inc.assign(c, spark.createDataFrame([(5, at(0.2))], "face_id long, vector array<double>"), m, 0).head()
    assert (out["n_members"], out["representative_face_id"]) == (3, 5)
    again = inc.assign(c, spark.createDataFrame([(5, at(0.2))], "face_id long, vector array<double>"), m, 6)
    assert again.where("cluster_label = 6").head()["n_members"] == 1


def test_frozen_reclamation_changes_nothing_and_the_fold_does(spark):
    m = members(spark, [(1, "a", 0, at(0.7)), (2, "a", 0, at(-0.7)), (3, "a", -1, at(0.75)), (4, "a", -1, at(0.9))])
    c = cen.centroids(m)
    frozen = {r["face_id"]: r["bucket"] for r in dec.reclaim_frozen(m, c, faces(spark, m)).collect()}
    assert frozen == {3: "auto_merged", 4: "suggestions"}
    fold = {r["face_id"]: (r["status"], r["n_members"]) for r in inc.reclaim_sequential(m, c).collect()}
    assert fold[3] == ("auto_merge", 3)


def test_arrivals_start_clusters(spark):
    m = members(spark, [(1, "a", 0, at(0.7)), (2, "a", 0, at(-0.7))])
    q = spark.createDataFrame([("default", 1, 10, [0.0, 0.0, 1.0]), ("default", 2, 11, [0.0, 0.0, 1.0])], "run_label string, seq long, face_id long, vector array<double>")
    got = [(r["status"], r["cluster_label"]) for r in inc.sequential(q, m, cen.centroids(m), grow=True).orderBy("seq").collect()]
    assert got == [("new_cluster", 1), ("auto_merge", 1)]


def clustered(spark, seed, sizes, queued, noise=0.35):
    """Members around random centres, and a queue of vectors around the same centres, some far from all."""
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(len(sizes), 12)))
    rows, face = [], 0
    for label, n in enumerate(sizes):
        for v in unit(centres[label] + noise * unit(rng.normal(size=(n, 12))) * rng.random((n, 1))):
            rows.append(("default", face, "x", label, v.tolist()))
            face += 1
    rows.append(("default", face, "x", len(sizes) + 3, [0.0] * 11 + [1.0]))  # a label that has no centroid
    queue = []
    for seq in range(queued):
        v = centres[seq % len(sizes)] + (0.2 + 0.9 * rng.random()) * unit(rng.normal(size=12)) if seq % 9 else rng.normal(size=12)
        queue.append(("default", seq, 10_000 + seq, (unit(v) * (0.5 + rng.random())).tolist()))
    m = spark.createDataFrame(rows, MEMBER)
    return spark.createDataFrame(queue, "run_label string, seq long, face_id long, vector array<double>"), m, cen.centroids(m.where(f"cluster_label < {len(sizes)}"))


@pytest.mark.parametrize("grow", [False, True])
def test_a_fold_needs_only_the_outermost_members(spark, grow):
    t = dec.Thresholds()
    seen = set()
    for seed, sizes in ((1, [900, 300, 40, 3]), (2, [500, 500, 1])):
        queue, m, c = clustered(spark, seed, sizes, 60)
        outer = inc.outermost(queue, m, c, t)
        whole = inc.sequential(queue, m, c, t, grow).orderBy("seq").collect()
        part = inc.sequential(queue, m, c, t, grow, whole_up_to=0).orderBy("seq").collect()
        assert [tuple(r)[:5] + tuple(r)[6:8] for r in whole] == [tuple(r)[:5] + tuple(r)[6:8] for r in part]
        assert [r["distance"] for r in whole] == pytest.approx([r["distance"] for r in part])
        assert outer.count() < m.count() / 3
        seen |= {r["status"] for r in whole}
    assert seen == {"auto_merge", "ask_user", "new_cluster"}


def test_a_centroid_turns_no_more_than_said(spark):
    queue, m, c = clustered(spark, 5, [400, 60, 2], 80)
    bound = {r["cluster_label"]: (np.array(r["centroid"]), r["turn"]) for r in inc.turns(queue, c, dec.Thresholds()).collect()}
    moved = [r for r in inc.sequential(queue, m, c).collect() if r["status"] == "auto_merge"]
    assert moved and bound[0][1] < 0.3 and bound[2][1] == pytest.approx(math.pi)
    for r in moved:
        old, turn = bound[r["cluster_label"]]
        new = np.array(r["centroid"])
        assert math.acos(min(1.0, float(old @ new / np.linalg.norm(old) / np.linalg.norm(new)))) <= turn + 1e-7


def test_a_fold_is_refused_by_what_it_needs(spark, monkeypatch):
    queue, m, c = clustered(spark, 7, [600, 200], 20)
    need = inc.outermost(queue, m, c, dec.Thresholds()).count()
    monkeypatch.setattr(inc, "FOLD_STATE_LIMIT", need)
    assert inc.sequential(queue, m, c, whole_up_to=0).count() == 20
    monkeypatch.setattr(inc, "FOLD_STATE_LIMIT", need - 1)
    with pytest.raises(ValueError, match="needs"):
        inc.sequential(queue, m, c, whole_up_to=0)


def test_label_after_zero(spark):
    df = spark.createDataFrame([(0,), (-1,)], "cluster_label int")
    assert cen.next_label(df).head()[0] == 1 and cen.next_label(df.where("cluster_label = -1")).head()[0] == 0


def test_suspicious_pairs_equal_brute_force(spark):
    """Clusters close by centroid only, by members only, and one whose members are all capped away into noise."""
    from vecloom.operators.pairs import minima_of

    rng = np.random.default_rng(8)
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate((i % 12, rng.normal(size=3) * 0.5 + np.eye(3)[i % 3] * (1 + i % 4)) for i in range(240))]
    rows = [(i, k, (np.array(v) / np.linalg.norm(v)).tolist()) for i, k, v in rows]
    m = spark.createDataFrame(rows, "face_id long, cluster_label int, vector array<double>").selectExpr("'r' AS run_label", "*")
    c = cen.centroids(m)
    faces = m.selectExpr("face_id AS id", "'p' AS image_path", "'w' AS identity")
    got = {(r["cluster_a"], r["cluster_b"]): (r["centroid_distance"], r["min_member_distance"]) for r in dec.suspicious_pairs(m, c, faces, cap=None).collect()}
    x = {k: np.array([v for _, l, v in rows if l == k]) for k in range(12)}
    mean = {k: v.mean(0) / np.linalg.norm(v.mean(0)) for k, v in x.items()}
    want = {}
    for a in range(12):
        for b in range(a + 1, 12):
            d = (1 - mean[a] @ mean[b], (1 - x[a] @ x[b].T).min())
            if min(d) < 0.45:
                want[a, b] = pytest.approx(d, abs=1e-9)
    assert got == want and len(want) < 66
    pairs = spark.createDataFrame([(0, 1), (2, 7)], "ga long, gb long")
    few = {(r["ga"], r["gb"]): r["d"] for r in minima_of(pairs, m, "cluster_label", rows=6).collect()}
    assert few == {(a, b): pytest.approx((1 - x[a] @ x[b].T).min()) for a, b in ((0, 1), (2, 7))}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "face_id long, identity string, vector array<double>")


def test_calibration_errors_and_exclusion(spark):
    with pytest.raises(ValueError):
        cal.calibrate(vectors(spark, [(1, "a", at(0.0)), (2, "uploaded", at(0.1))]))
    with pytest.raises(ValueError):
        cal.calibrate(vectors(spark, [(1, "a", at(0.0)), (2, "a", at(0.1))]))
    r = cal.calibrate(vectors(spark, [(1, "a", at(0.0)), (2, "a", at(0.1)), (3, "b", at(1.5)), (4, "uploaded", at(0.0))])).head()
    assert (r["n_same"], r["n_diff"], r["n_excluded"], r["clean_separation"], r["no_safe_auto_merge_zone"]) == (1, 2, 1, True, False)


def test_no_safe_zone_when_the_nearest_pair_differs(spark):
    r = cal.calibrate(vectors(spark, [(1, "a", at(0.0)), (2, "b", at(0.01)), (3, "a", at(0.5))])).head()
    assert (r["precision_t1"], r["no_safe_auto_merge_zone"]) == (0.0, True)


@pytest.mark.parametrize("few", [100_000, 4])
def test_cutoff_and_percentiles_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(cal, "FEW", few)
    rng = np.random.default_rng(3)
    for target in (0.0, 0.01, 0.3, 1.0) if few > 4 else (0.01,):
        d = np.round(rng.random(300) ** 2 * 1.9, 2)
        diff = (rng.random(300) < d / 2).astype(int)
        pairs = cal.listed(spark.createDataFrame([(float(a), int(b)) for a, b in zip(d, diff, strict=True)], "d double, is_diff int"))
        hist = pairs.cut([cal.ROOT])[0]
        order = np.lexsort((diff, d))
        ok = np.cumsum(diff[order]) <= target * np.arange(1, 301)
        assert cal.safe_cutoff(pairs, hist, target) == pytest.approx(d[order][ok].max() if ok.any() else 0.0, abs=1e-9)
        got = cal.percentiles(pairs, hist, {"a": (0, 95.0), "b": (1, 5.0), "c": (0, 100.0), "d": (1, 0.0)})
        want = [np.percentile(d[diff == f], p) for f, p in ((0, 95), (1, 5), (0, 100), (1, 0))]
        assert list(got.values()) == pytest.approx(want)


def test_all_pairs_are_counted_where_they_are_made(spark, monkeypatch):
    """Repeated vectors among others, in small blocks of pairs: the same figures as from a list of all pairs."""
    monkeypatch.setattr(cal, "FEW", 10)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    x[40:] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who = rng.integers(0, 4, 60)
    r = cal.calibrate(vectors(spark, [(i, f"p{w}", v.tolist()) for i, (v, w) in enumerate(zip(x, who, strict=True))]), max_pairs=None).head()
    i, j = np.triu_indices(60, 1)
    d, diff = 1 - (x[i] * x[j]).sum(1), who[i] != who[j]
    assert (r["n_same"], r["n_diff"]) == ((~diff).sum(), diff.sum())
    assert (r["t1"], r["t2"], r["mean_same"], r["mean_diff"]) == pytest.approx((np.percentile(d[~diff], 95), np.percentile(d[diff], 5), d[~diff].mean(), d[diff].mean()), abs=1e-9)


def test_drawn_pairs_are_pairs_and_repeatable(spark):
    v = vectors(spark, [(i, f"p{i % 5}", at(i / 40)) for i in range(120)])
    used = v.selectExpr("face_id", "vector", "xxhash64(identity) AS grp")
    from vecloom.operators.pairs import drawn_pairs

    one, two = (sorted(map(tuple, drawn_pairs(used, "grp", 500, s).collect())) for s in (1, 1))
    assert one == two and len(one) == 500
    assert abs(np.mean([f for _, f in one]) - 0.806) < 0.08 and sorted(map(tuple, drawn_pairs(used, "grp", 500, 2).collect())) != one
    assert drawn_pairs(used, "grp", 10**6, 1).count() == 120 * 119 // 2
