"""Decisions about new vectors and about pairs of clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.operators.centroids import centroids, mean_vector, nearest_centroid, spreads
from vecloom.operators.pairs import group_minima, minima_of, pairs_within
from vecloom.schema import NOISE
from vecloom.sources.scratch import settled


@dataclass(frozen=True)
class Thresholds:
    """Cosine distances below t1 merge, below t2 ask; a merge must stay within spread_margin of the spread."""

    t1: float = 0.30
    t2: float = 0.45
    spread_margin: float = 1.15


#: Fixed values of the batch decision, whose bounds are inclusive.
BATCH_TIERS = (0.18, 0.40)
MEMBER_CAP, MEMBER_SEED = 50, 42


def recommend(vectors: DataFrame, members: DataFrame, cents: DataFrame, faces: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """face_id, status, reason, nearest_cluster_label, distance, representative_*, auto_merge_demoted of each vector.

    Below t1 a vector merges, unless its cluster never spread that far: then, and up to t2, the user is asked; from t2
    on a new cluster is due.  Without centroids every vector starts a cluster.
    """
    near = nearest_centroid(vectors, cents).drop("rank")
    about = cents.join(spreads(members, cents).drop("run_label"), "cluster_label", "left")
    about = about.join(faces.select(F.col("id").alias("representative_face_id"), F.col("image_path").alias("representative_image_path"), F.col("identity").alias("representative_identity")), "representative_face_id", "left")
    d = near.join(about.select("cluster_label", "spread", "representative_face_id", "representative_image_path", "representative_identity"), "cluster_label")
    demoted = (F.col("distance") < t.t1) & F.coalesce(F.col("distance") > F.col("spread") * t.spread_margin, F.lit(False))
    status = F.when(F.col("distance").isNull(), "new_cluster").when(demoted, "ask_user").when(F.col("distance") < t.t1, "auto_merge").when(F.col("distance") < t.t2, "ask_user").otherwise("new_cluster")
    out = vectors.select("face_id").join(d, "face_id", "left")
    return out.select(
        "face_id",
        status.alias("status"),
        F.when(F.col("distance").isNull(), "no_existing_clusters").alias("reason"),
        F.col("cluster_label").alias("nearest_cluster_label"),
        "distance",
        "representative_face_id",
        "representative_image_path",
        "representative_identity",
        F.coalesce(demoted, F.lit(False)).alias("auto_merge_demoted"),
    )


def reclaim_frozen(members: DataFrame, cents: DataFrame, faces: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """recommend() for the noise of a run against its centroids as they stand, with the bucket each vector falls in."""
    noise = members.where(F.col("cluster_label") == NOISE)
    bucket = F.when(F.col("status") == "auto_merge", "auto_merged").when(F.col("status") == "ask_user", "suggestions").otherwise("left_as_noise")
    return recommend(noise, members, cents, faces, t).withColumn("bucket", bucket)


def rank_zones(vectors: DataFrame, cents: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """face_id, rank, cluster_label, distance, zone of all centroids, nearest first."""
    zone = F.when(F.col("distance") < t.t1, "auto_merge").when(F.col("distance") < t.t2, "ask_user").otherwise("new_cluster")
    return nearest_centroid(vectors, cents, top=max(1, cents.count())).withColumn("zone", zone)


def batch_tier(batch: DataFrame, members: DataFrame, tiers: tuple[float, float] = BATCH_TIERS) -> DataFrame:
    """action, target, dist: the decision for the mean of a batch; target only where it is not a new cluster."""
    cents = centroids(members.select("run_label", "cluster_label", "face_id", "vector"))
    mean = batch.agg(vec.l2_normalize(mean_vector()).alias("vector")).where(F.col("vector").isNotNull()).select(F.lit(0).cast("long").alias("face_id"), "vector")
    near = nearest_centroid(mean, cents)
    action = F.when(F.col("distance") <= tiers[0], "AUTO_MERGE").when(F.col("distance") <= tiers[1], "USER_PROMPT").otherwise("NEW_CLUSTER")
    found = mean.join(near, "face_id", "left").withColumn("action", action)
    return found.select("action", F.when(F.col("action") != "NEW_CLUSTER", F.col("cluster_label")).alias("target"), F.coalesce("distance", F.lit(1.0)).alias("dist"))


def capped_members(members: DataFrame, cap: int | None = MEMBER_CAP, seed: int = MEMBER_SEED) -> DataFrame:
    """At most `cap` members of each cluster, drawn by a seeded hash; None keeps all."""
    if cap is None:
        return members
    w = Window.partitionBy("cluster_label").orderBy(F.xxhash64(F.lit(seed), "face_id"), "face_id")
    return members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def suspicious_pairs(members: DataFrame, cents: DataFrame, faces: DataFrame, t: Thresholds = Thresholds(), cap: int | None = MEMBER_CAP, seed: int = MEMBER_SEED) -> DataFrame:
    """Pairs of clusters whose centroids or nearest members are closer than t2, closest first; 10 fields.

    Only such pairs leave the tasks: blocks of centroids meet, and blocks of members, and no list of all pairs is made.
    """
    paths = faces.select(F.col("id").alias("representative_face_id"), F.col("image_path").alias("path"), F.col("identity").alias("who"))
    c = settled(cents.join(paths, "representative_face_id").select("cluster_label", vec.l2_normalize(F.col("centroid")).alias("centroid"), "path", "who"), "suspects")
    real = settled(capped_members(members.where(F.col("cluster_label") != NOISE), cap, seed).select("face_id", "vector", "cluster_label"), "capped")
    # Pairs that are close by centroid, and pairs that are close by members; the latter bring their distance.
    close = pairs_within(c.select(F.col("cluster_label").cast("long").alias("face_id"), F.col("centroid").alias("vector")), t.t2, euclidean=False).select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    near = settled(group_minima(real, "cluster_label", t.t2), "near-members")
    other = minima_of(close.join(near, ["ga", "gb"], "left_anti"), real, "cluster_label")
    alone = close.join(near, ["ga", "gb"], "left_anti").join(other, ["ga", "gb"], "left").select("ga", "gb", "d")  # without members to compare
    found = near.unionByName(alone).select(F.col("ga").cast("int").alias("cluster_label_a"), F.col("gb").cast("int").alias("cluster_label_b"), F.col("d").alias("min_member_distance"))
    a = c.select(*[F.col(x).alias(f"{x}_a") for x in c.columns])
    b = c.select(*[F.col(x).alias(f"{x}_b") for x in c.columns])
    pairs = found.join(a, "cluster_label_a").join(b, "cluster_label_b").withColumn("centroid_distance", vec.cosine_distance(F.col("centroid_a"), F.col("centroid_b")))
    best = F.least("centroid_distance", "min_member_distance")
    out = pairs.withColumn("distance", best).where(F.col("distance") < t.t2)
    return out.select(
        F.col("cluster_label_a").alias("cluster_a"),
        F.col("cluster_label_b").alias("cluster_b"),
        "distance",
        "centroid_distance",
        "min_member_distance",
        (F.col("distance") < t.t1).alias("auto_mergeable"),
        F.col("path_a").alias("rep_a_image_path"),
        F.col("path_b").alias("rep_b_image_path"),
        F.col("who_a").alias("rep_a_identity"),
        F.col("who_b").alias("rep_b_identity"),
    ).orderBy("distance", "cluster_a", "cluster_b")


def dismissed(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """Suspicious pairs without those that a user dismissed."""
    return pairs.join(gone.select("cluster_a", "cluster_b"), ["cluster_a", "cluster_b"], "left_anti")
