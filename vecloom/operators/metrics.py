"""Scores of a clustering against ground truth, all from one contingency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators.pairs import group_sums
from vecloom.schema import NOISE


def contingency(labelled: DataFrame, truth: str = "identity", pred: str = "cluster_label", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, truth, pred, n."""
    return labelled.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def _xlogx(n: Column) -> Column:
    return F.when(n > 0, n * F.log(n)).otherwise(0.0)


def scores(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, ari, nmi, homogeneity, completeness, v_measure, purity, n_predicted_clusters, n_true_identities,
    noise_fraction of a contingency table.  Noise is a cluster of its own, but is nobody's majority in purity.
    """
    rows = cells.groupBy(*keys, "truth").agg(F.sum("n").alias("n"))
    cols = cells.groupBy(*keys, "pred").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    whole = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(_choose2(F.col("n"))).alias("c_cell"), F.sum(_xlogx(F.col("n"))).alias("x_cell"))
    by_row = rows.groupBy(*keys).agg(F.sum(_choose2(F.col("n"))).alias("c_row"), F.sum(_xlogx(F.col("n"))).alias("x_row"), F.count(F.lit(1)).alias("n_true"))
    noise = F.col("pred") == NOISE
    by_col = cols.groupBy(*keys).agg(
        F.sum(_choose2(F.col("n"))).alias("c_col"),
        F.sum(_xlogx(F.col("n"))).alias("x_col"),
        F.sum(F.when(~noise, F.col("top")).otherwise(0)).alias("majority"),
        F.count_if(~noise).alias("n_pred"),
        F.sum(F.when(noise, F.col("n")).otherwise(0)).alias("noise"),
    )
    if keys:
        s = whole.join(by_row, [*keys]).join(by_col, [*keys])
    else:
        one = F.lit(1)
        s = whole.withColumn("_k", one).join(by_row.withColumn("_k", one), "_k").join(by_col.withColumn("_k", one), "_k").drop("_k")
    n = F.col("n")
    expected = F.col("c_row") * F.col("c_col") / _choose2(n)
    middle = (F.col("c_row") + F.col("c_col")) / 2
    ari = F.when((n < 2) | (middle == expected), 1.0).otherwise((F.col("c_cell") - expected) / (middle - expected))
    h_true, h_pred = F.log(n) - F.col("x_row") / n, F.log(n) - F.col("x_col") / n
    mi = F.greatest(F.lit(0.0), F.log(n) + (F.col("x_cell") - F.col("x_row") - F.col("x_col")) / n)
    tiny = 1e-12
    s = s.select(*keys, "n", ari.alias("ari"), mi.alias("mi"), h_true.alias("ht"), h_pred.alias("hp"), (F.col("majority") / n).alias("purity"), F.col("n_pred").alias("n_predicted_clusters"), F.col("n_true").alias("n_true_identities"), (F.col("noise") / n).alias("noise_fraction"))
    hom = F.when(F.col("ht") < tiny, 1.0).otherwise(F.col("mi") / F.col("ht"))
    com = F.when(F.col("hp") < tiny, 1.0).otherwise(F.col("mi") / F.col("hp"))
    nmi = F.when((F.col("ht") < tiny) & (F.col("hp") < tiny), 1.0).otherwise(F.col("mi") / ((F.col("ht") + F.col("hp")) / 2))
    v = F.when(hom + com < tiny, 0.0).otherwise(2 * hom * com / (hom + com))
    return s.select(*keys, "n", "ari", nmi.alias("nmi"), hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure"), "purity", "n_predicted_clusters", "n_true_identities", "noise_fraction")


def compute_metrics(labelled: DataFrame, truth: str = "identity", pred: str = "cluster_label", keys: tuple[str, ...] = ()) -> DataFrame:
    return scores(contingency(labelled, truth, pred, keys), keys)


def silhouette(labelled: DataFrame, label: str = "cluster_label") -> DataFrame:
    """silhouette: mean over vectors of (b - a) / max(a, b) by euclidean distance; members of singletons count 0."""
    own = labelled.select("face_id", F.col(label).cast("long").alias("own"))
    sums = group_sums(labelled.select("face_id", "vector", label), label).join(own, "face_id")
    a = F.max(F.when((F.col("grp") == F.col("own")) & (F.col("n") > 0), F.col("total") / F.col("n")))
    b = F.min(F.when((F.col("grp") != F.col("own")) & (F.col("n") > 0), F.col("total") / F.col("n")))
    s = sums.groupBy("face_id").agg(a.alias("a"), b.alias("b"))
    return s.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))
