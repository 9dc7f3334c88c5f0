"""Schemas of the engine's tables, and the views that make labelled embeddings look like them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.sources.ship import ship

FACES = "id LONG, identity STRING, image_path STRING, bbox ARRAY<FLOAT>, landmarks ARRAY<ARRAY<FLOAT>>, det_score FLOAT, created_at TIMESTAMP"
FACES_MULTI = FACES + ", face_index INT, crop_path STRING"
EMBEDDINGS = "face_id LONG, dim INT, vector ARRAY<FLOAT>"
EMBEDDINGS_BY_MODEL = "face_id LONG, model STRING, dim INT, vector ARRAY<FLOAT>"
CLUSTER_RESULTS = "run_label STRING, face_id LONG, cluster_label INT"
CLUSTER_RESULTS_BY_MODEL = "model STRING, " + CLUSTER_RESULTS
CENTROIDS = "run_label STRING, cluster_label INT, centroid ARRAY<DOUBLE>, n_members LONG, representative_face_id LONG"
REGISTRY = "MAP<STRING, STRUCT<total_faces_found: INT, bounding_boxes: ARRAY<STRUCT<box_index: INT, crop_filename: STRING, coordinates: STRUCT<x: INT, y: INT, width: INT, height: INT>>>>>"
NOISE = -1
RUN = "default"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_id, identity, label, vector: the embeddings as they are, in double precision."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("face_id"), F.concat(F.lit("id_"), "label").alias("identity"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As raw, with a direction of its own added for each label, so that labels have geometry; unit norm."""
    alpha = F.lit(0.3) + F.lit(0.1) * (F.col("face_id") % 8)
    bump = F.transform("vector", lambda x, i: F.col("alpha") * x + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    df = raw(spark, sf_dir).withColumn("alpha", alpha).withColumn("vector", bump).drop("alpha")
    return df.withColumn("vector", vec.l2_normalize(F.col("vector")))


def planted_label(face_id: Column, label: Column) -> Column:
    """A labelling with noise, splits and mixed clusters."""
    return F.when(face_id % 10 == 9, NOISE).otherwise((label + face_id % 2) % 8).cast("int")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted view with run_label and cluster_label."""
    return planted(spark, sf_dir).withColumns({"run_label": F.lit(RUN), "cluster_label": planted_label(F.col("face_id"), F.col("label"))})


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """faces: id, identity, image_path, det_score."""
    r = raw(spark, sf_dir)
    return r.select(F.col("face_id").alias("id"), "identity", F.concat("identity", F.lit("/"), "face_id", F.lit(".jpg")).alias("image_path"), ((F.col("face_id") * 37 % 100) / F.lit(100.0)).alias("det_score"))


def cluster_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_results: run_label, face_id, cluster_label, without the vectors."""
    r = raw(spark, sf_dir)
    return r.select(F.lit(RUN).alias("run_label"), "face_id", "identity", planted_label(F.col("face_id"), F.col("label")).alias("cluster_label"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (image, detection): score, box size and blur, nulls included."""
    r = raw(spark, sf_dir).select("face_id", "identity").withColumn("face_index", F.explode(F.sequence(F.lit(0), (F.col("face_id") % 4).cast("int"))))
    v, i = F.col("face_id"), F.col("face_index")
    return r.select(
        "face_id", "identity", "face_index",
        F.concat("identity", F.lit("/"), v, F.lit(".jpg")).alias("image_path"),
        ((v * 37 + i * 11) % 100 / F.lit(100.0)).alias("det_score"),
        (10 + (v * 7 + i) % 60).cast("double").alias("w"),
        (10 + (v * 5) % 60).cast("double").alias("h"),
        F.when(v % 17 != 0, (v * 13) % 90).cast("double").alias("blur_var"),
    )
