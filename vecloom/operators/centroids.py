"""Centroids, representatives and spreads of clusters; nearest centroids of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.operators.pairs import block_pairs
from vecloom.schema import NOISE
from vecloom.sources.ship import ship

#: Bytes of centroids up to which they travel with the tasks; beyond, blocks of vectors meet blocks of centroids.
SHIP_BYTES = 64 << 20


def mean_vector(column: str = "vector"):
    """Element-wise mean as an aggregate with map-side combination; the rows are not exploded."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column))))


def centroids(members: DataFrame, keys: tuple[str, ...] = ("run_label",)) -> DataFrame:
    """keys, cluster_label, centroid, n_members, representative_face_id of members(face_id, vector, cluster_label, keys).

    Noise has no centroid.  The representative is the member nearest to the centroid, the smallest face_id on a tie.
    """
    by = [*keys, "cluster_label"]
    real = members.where(F.col("cluster_label") != NOISE)
    c = real.groupBy(*by).agg(vec.l2_normalize(mean_vector()).alias("centroid"), F.count(F.lit(1)).alias("n_members"))
    d = real.join(c.select(*by, "centroid"), by).select(*by, "face_id", vec.cosine_distance(F.col("centroid"), F.col("vector")).alias("d"))
    best = d.groupBy(*by).agg(F.min(F.struct("d", "face_id")).alias("m")).select(*by, F.col("m.face_id").alias("representative_face_id"))
    return c.join(best, by)


def spreads(members: DataFrame, cents: DataFrame, keys: tuple[str, ...] = ("run_label",)) -> DataFrame:
    """keys, cluster_label, spread: the largest distance of a present member to the cluster's centroid."""
    by = [*keys, "cluster_label"]
    d = members.where(F.col("cluster_label") != NOISE).join(cents.select(*by, "centroid"), by)
    return d.groupBy(*by).agg(F.max(vec.cosine_distance(F.col("centroid"), F.col("vector"))).alias("spread"))


def next_label(labels: DataFrame) -> DataFrame:
    """next_label: one more than the largest label of a cluster, 0 without clusters."""
    return labels.agg(F.coalesce(F.max(F.when(F.col("cluster_label") != NOISE, F.col("cluster_label"))) + 1, F.lit(0)).alias("next_label"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), vec.EPS)


def nearest_centroid(vectors: DataFrame, cents: DataFrame, top: int = 1) -> DataFrame:
    """face_id, rank, cluster_label, distance of the `top` nearest centroids; the smaller label first on a tie.

    Distances that agree to 12 digits are a tie, so that block sizes cannot decide it.
    """
    ship(vectors.sparkSession)
    size = cents.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).head()
    n, dim = size[0], size[1] or 0
    result = "face_id long, rank int, cluster_label int, distance double"
    if not n:
        return vectors.sparkSession.createDataFrame([], result)
    if n * dim * 8 <= SHIP_BYTES:
        rows = cents.select("cluster_label", "centroid").orderBy("cluster_label").collect()
        labels, m = np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows]))
        k = min(top, n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = 1.0 - _unit(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)) @ m.T
                order = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]
                cols = [np.repeat(batch.column("face_id").to_numpy(), k), np.tile(np.arange(1, k + 1), batch.num_rows), labels[order].ravel(), np.take_along_axis(d, order, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["face_id", "rank", "cluster_label", "distance"])

        return vectors.select("face_id", "vector").mapInArrow(run, result)

    def use(ids, _ga, x, labels_, _gb, y):
        d = 1.0 - _unit(x) @ _unit(y).T
        order = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :top]
        yield {"face_id": np.repeat(ids, order.shape[1]), "cluster_label": labels_[order].ravel(), "distance": np.take_along_axis(d, order, 1).ravel()}

    other = cents.select(F.col("cluster_label").cast("long").alias("face_id"), F.col("centroid").alias("vector"))
    found = block_pairs(vectors.select("face_id", "vector"), use, "face_id long, cluster_label int, distance double", other=other)
    w = Window.partitionBy("face_id").orderBy(F.round("distance", 12), "cluster_label")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("face_id", "rank", "cluster_label", "distance")


def merge_clusters(members: DataFrame, cents: DataFrame, keep: int, merge: int) -> tuple[DataFrame, DataFrame]:
    """Members and centroids after cluster `merge` went into `keep`; only the kept centroid is computed anew."""
    if keep == merge:
        raise ValueError("a cluster cannot be merged with itself")
    moved = members.withColumn("cluster_label", F.when(F.col("cluster_label") == merge, keep).otherwise(F.col("cluster_label")))
    if not moved.where(F.col("cluster_label") == keep).head(1):
        raise ValueError(f"clusters {keep} and {merge} have no members")
    fresh = centroids(moved.where(F.col("cluster_label") == keep))
    rest = cents.where(~F.col("cluster_label").isin(keep, merge))
    return moved, rest.unionByName(fresh.select(rest.columns))
