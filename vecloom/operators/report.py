"""Reports over clusterings and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import text
from vecloom.operators.metrics import compute_metrics
from vecloom.operators.ranks import numbered
from vecloom.schema import NOISE


def per_identity(labelled: DataFrame) -> DataFrame:
    """identity, total, noise, n_clusters, assigned, status: how an identity is spread over clusters."""
    real = F.when(F.col("cluster_label") != NOISE, F.col("cluster_label"))
    g = labelled.groupBy("identity").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cluster_label") == NOISE).alias("noise"), F.sort_array(F.collect_set(real)).alias("assigned"))
    g = g.withColumn("n_clusters", F.size("assigned").cast("long"))
    return g.withColumn("status", text.identity_status(F.col("total"), F.col("noise"), F.col("n_clusters")))


def split_identities(labelled: DataFrame) -> DataFrame:
    return per_identity(labelled).where("n_clusters > 1").select("identity", "n_clusters")


def purity_of_clusters(labelled: DataFrame) -> DataFrame:
    """cluster_label, identities, verdict of every cluster but noise."""
    g = labelled.where(F.col("cluster_label") != NOISE).groupBy("cluster_label").agg(F.sort_array(F.collect_set("identity")).alias("identities"))
    return g.withColumn("verdict", F.when(F.size("identities") == 1, "pure").otherwise("mixed"))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("images")).orderBy(F.desc("images"), "cluster_label")


def noise_last(labels: DataFrame) -> DataFrame:
    return labels.orderBy(F.col("cluster_label") == NOISE, "cluster_label")


def browser(labelled: DataFrame, cents: DataFrame, faces: DataFrame) -> DataFrame:
    """cluster_label, n_members, representative_face_id, representative_identity ("?" for noise), noise last."""
    rep = cents.join(faces.select(F.col("id").alias("representative_face_id"), F.col("identity").alias("representative_identity")), "representative_face_id", "left")
    size = labelled.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n_present"))
    out = size.join(rep.select("cluster_label", "representative_face_id", "representative_identity"), "cluster_label", "left")
    return noise_last(out.withColumn("representative_identity", F.coalesce("representative_identity", F.lit("?"))))


def best_detection(d: DataFrame) -> DataFrame:
    """The detection of each image with the highest score, the first on a tie."""
    w = Window.partitionBy("face_id").orderBy(F.desc("det_score"), "face_index")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def face_index(d: DataFrame) -> DataFrame:
    """new_index: position of a detection in its image by score, from 0."""
    w = Window.partitionBy("face_id").orderBy(F.desc("det_score"), "face_index")
    return d.withColumn("new_index", F.row_number().over(w) - 1)


def quality_filter(d: DataFrame, min_score: float = 0.65, min_size: float = 20.0, min_blur: float = 20.0) -> DataFrame:
    """Detections that are sure, large and sharp enough; an unknown sharpness passes; best first."""
    ok = (F.col("det_score") >= min_score) & (F.col("w") >= min_size) & (F.col("h") >= min_size) & (F.col("blur_var").isNull() | (F.col("blur_var") >= min_blur))
    return d.where(ok).orderBy(F.desc("det_score"), "face_id", "face_index")


def reject_reasons(images: DataFrame, d: DataFrame, min_score: float = 0.65, min_size: float = 20.0, min_blur: float = 20.0) -> DataFrame:
    """face_id, status of each image by its best detection, before any filter."""
    reasons = F.concat_ws(", ", F.when(F.col("det_score") < min_score, "LOW_SCORE"), F.when((F.col("w") < min_size) | (F.col("h") < min_size), "SMALL"), F.when(F.col("blur_var") < min_blur, "BLURRY"))
    status = F.when(F.col("det_score").isNull(), "NO DETECTION").when(reasons == "", "OK").otherwise(reasons)
    return images.select("face_id").join(best_detection(d), "face_id", "left").select("face_id", status.alias("status"))


def detector_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """filename, count_a, count_b: two registries(filename, count) side by side, 0 where one has no entry."""
    x, y = a.select("filename", F.col("count").alias("count_a")), b.select("filename", F.col("count").alias("count_b"))
    both = x.join(y, "filename", "full_outer")
    return both.select("filename", F.coalesce("count_a", F.lit(0)).alias("count_a"), F.coalesce("count_b", F.lit(0)).alias("count_b"))


def detector_variance(a: DataFrame, b: DataFrame, default_a: float = 0.005, default_b: float = 0.120) -> DataFrame:
    """One row of totals: images, faces, mismatches, images with several faces, latency and throughput of two detectors.

    A registry without timings has the default latency.
    """
    side = lambda df, s, default: df.agg(F.count(F.lit(1)).alias(f"images_{s}"), F.coalesce(F.sum("count"), F.lit(0)).alias(f"faces_{s}"), F.coalesce(F.avg("latency"), F.lit(default)).alias(f"latency_{s}"))
    both = detector_counts(a, b).agg(F.count_if(F.col("count_a") != F.col("count_b")).alias("mismatched"), F.count_if((F.col("count_a") > 1) | (F.col("count_b") > 1)).alias("multi_face"))
    out = side(a, "a", default_a).join(side(b, "b", default_b), F.lit(True)).join(both, F.lit(True))  # one row each
    return out.withColumns({"per_second_a": 1 / F.col("latency_a"), "per_second_b": 1 / F.col("latency_b")})


def mismatches(a: DataFrame, b: DataFrame, top: int = 10) -> DataFrame:
    return detector_counts(a, b).where("count_a <> count_b").orderBy("filename").limit(top)


def ingest_counters(images: DataFrame, d: DataFrame) -> DataFrame:
    """ok, no_face, multi: images by number of detections."""
    n = images.select("face_id").join(d.groupBy("face_id").agg(F.count(F.lit(1)).alias("n")), "face_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 0).alias("ok"), F.count_if(F.col("n") == 0).alias("no_face"), F.count_if(F.col("n") > 1).alias("multi"))


def model_comparison(labelled: DataFrame) -> DataFrame:
    """The metrics of every model's labelling, one row a model."""
    return compute_metrics(labelled, keys=("model",)).orderBy("model")


METRICS = ("ari", "nmi", "purity", "v_measure")


def melted(table: DataFrame, key: str = "model", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return table.unpivot([key], list(metrics), "metric", "value")


def pivoted(long: DataFrame, key: str = "model", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return long.groupBy(key).pivot("metric", list(metrics)).agg(F.first("value"))


def best_per_metric(table: DataFrame, key: str = "model", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, best, value: the largest value of each metric, the first key on a tie."""
    m = melted(table, key, metrics)
    return m.groupBy("metric").agg(F.min_by(key, F.struct(-F.col("value"), F.col(key))).alias("best"), F.max("value").alias("value"))


def norm_check(vectors: DataFrame) -> DataFrame:
    from vecloom.functions import vec

    n = vectors.select(vec.norm(F.col("vector")).alias("n"))
    return n.agg(F.avg("n").alias("mean_norm"), F.stddev_pop("n").alias("std_norm"))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """code: position of the value among the sorted distinct ones.  Ranked over distinct values, not over rows."""
    values = df.select(column).distinct()
    return df.join(numbered(values, "code", column).withColumn("code", F.col("code").cast("int")), column)


def collated(faces: DataFrame) -> DataFrame:
    """position of faces in the case-insensitive order (identity, path) in which stored label lists are laid out."""
    keyed = faces.withColumns({"_who": F.lower("identity"), "_path": F.lower("image_path")})
    return numbered(keyed, "position", "_who", "_path").drop("_who", "_path").withColumn("position", F.col("position").cast("int"))


def zip_labels(faces: DataFrame, pred_labels: DataFrame) -> DataFrame:
    """faces with the labels of a stored list(pred_labels array<int>) by position; only for importing such lists."""
    labels = pred_labels.select(F.posexplode("pred_labels").alias("position", "cluster_label"))
    return collated(faces).join(labels, "position")


def probe(face_id: int, members: DataFrame, identity: str) -> DataFrame:
    """closest, farthest, mean distance of one face to the photos of an identity, named in any case."""
    from vecloom.functions import vec

    p = members.where(F.col("face_id") == face_id).select(F.col("vector").alias("pv"))
    ref = members.where((F.lower("identity") == identity.lower()) & (F.col("face_id") != face_id))
    d = ref.join(F.broadcast(p)).select(vec.cosine_distance(F.col("vector"), F.col("pv")).alias("d"))  # p is one row
    return d.agg(F.min("d").alias("closest"), F.max("d").alias("farthest"), F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"))
