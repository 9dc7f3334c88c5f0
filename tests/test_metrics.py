"""Scores against published labellings and by hand."""

import pytest

from vecloom.operators import metrics as met

# Identities with their cluster counts ("cluster:count", -1 is noise), and the scores published for them.
GOLDEN = {
    "hdbscan": (["-1:2 0:8", "-1:1 3:10", "-1:1 1:14", "-1:2 7:10", "-1:1 5:9", "-1:5 3:1 6:8", "-1:1 4:10", "2:13"], 0.771270, 0.847496, 0.854167, 0.869737, 0.826364),
    "kmeans": (["1:2 5:8", "2:10 5:1", "0:14 1:1", "1:12", "1:10", "1:14", "1:1 3:10", "4:13"], 0.533224, 0.787915, 0.718750, 0.700380, 0.900456),
    "dbscan": (["0:1 1:8 2:1", "3:10 4:1", "5:10 6:1 7:1 8:1 9:1 10:1", "11:9 12:1 13:1 14:1", "15:3 16:1 17:1 18:1 19:1 20:1 21:2", "22:1 23:1 24:1 25:8 26:1 27:1 28:1", "29:9 30:1 31:1", "32:9 33:1 34:1 35:1 36:1"], 0.617313, 0.805049, 1.0, 1.0, 0.673709),
    "direct": (["-1:2 0:8", "-1:2 1:5"], 0.554196, 0.593792, 0.764706, 0.759270, 0.487537),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_published_scores(spark, name):
    rows, ari, nmi, purity, hom, com = GOLDEN[name]
    cells = [(f"id{i}", int(c.split(":")[0]), int(c.split(":")[1])) for i, r in enumerate(rows) for c in r.split()]
    s = met.scores(spark.createDataFrame(cells, "truth string, pred int, n long")).head()
    assert (s["ari"], s["nmi"], s["purity"]) == pytest.approx((ari, nmi, purity), abs=1e-6)
    assert (s["homogeneity"], s["completeness"]) == pytest.approx((hom, com), abs=1e-6)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "face_id long, identity string, cluster_label int")


def test_identical_labellings(spark):
    s = met.compute_metrics(labelled(spark, [(0, "a", 4), (1, "a", 4), (2, "b", 9), (3, "b", 9)])).head()
    assert (s["ari"], s["nmi"], s["purity"], s["v_measure"]) == pytest.approx((1, 1, 1, 1))


def test_one_cluster_of_one_identity(spark):
    s = met.compute_metrics(labelled(spark, [(0, "a", 1), (1, "a", 1)])).head()
    assert (s["ari"], s["nmi"]) == (1, 1)


def test_all_noise(spark):
    s = met.compute_metrics(labelled(spark, [(0, "a", -1), (1, "b", -1)])).head()
    assert (s["purity"], s["noise_fraction"], s["n_predicted_clusters"]) == (0, 1, 0)


def test_noise_counts_in_the_denominator_of_purity(spark):
    s = met.compute_metrics(labelled(spark, [(0, "a", 0), (1, "a", 0), (2, "a", -1), (3, "b", -1)])).head()
    assert s["purity"] == 0.5


def test_label_permutation(spark):
    rows = [(i, f"id{i % 3}", (i * 7) % 4) for i in range(40)]
    a = met.compute_metrics(labelled(spark, rows)).head()
    b = met.compute_metrics(labelled(spark, [(i, t, (p + 1) % 4 + 5) for i, t, p in rows])).head()
    assert a["ari"] == pytest.approx(b["ari"]) and -1 <= a["ari"] <= 1


def test_silhouette_of_singletons_is_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 1)], "face_id long, vector array<double>, cluster_label int")
    assert met.silhouette(df).head()[0] == 0
