"""Sources: image trees, registries and result documents, matrices, relational tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import schema
from vecloom.functions import text
from vecloom.sources.images import image_fault
from vecloom.sources.ship import ship

# Suffixes that scans accept.
SCAN = ("jpg", "jpeg", "png", "JPG", "JPEG", "PNG")
LOADER = ("jpg", "jpeg", "png", "bmp", "webp")
DIRECT = ("jpg", "jpeg", "png", "webp", "avif")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """path, length of all files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def labelled_tree(spark: SparkSession, root: str) -> DataFrame:
    """identity, image_path of root/<identity>/<image> with one of the SCAN suffixes, sorted."""
    base = root.rstrip("/").split("/")[-1]
    found = _files(spark, root).where(F.col("path").rlike(r"\.(" + "|".join(SCAN) + ")$"))
    two = F.element_at(F.split("path", "/"), -3) == base
    return found.where(two).select(text.parent(F.col("path")).alias("identity"), F.col("path").alias("image_path")).distinct().orderBy("identity", "image_path")


def valid_images(spark: SparkSession, root: str, whole: bool = False) -> DataFrame:
    """identity, image_path, length of all files below root with a LOADER suffix and some content.

    Files of a folder named like the root itself are outliers.  whole: files in whose structure something is wrong
    (images.fault) are left out.  That reads every byte, where a scan reads names, so it is off unless asked for.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(image_fault(F.col("content")).isNull()).select("path", "length") if whole else _files(spark, root)
    f = f.where(F.lower("path").rlike(r"\.(" + "|".join(LOADER) + ")$") & (F.col("length") > 0))
    f = f.where(~text.basename(F.col("path")).startswith("."))
    ship(spark)
    name = root.rstrip("/").split("/")[-1].lower()
    return f.select(text.identity_of_folder(F.col("path"), name).alias("identity"), F.col("path").alias("image_path"), "length").orderBy("image_path")


def folder_images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = DIRECT) -> DataFrame:
    """identity, image_path by folders, suffixes in any case; folders with a leading dot are skipped."""
    f = _files(spark, root).where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    return f.where(~text.parent(F.col("path")).startswith(".")).select(text.parent(F.col("path")).alias("identity"), F.col("path").alias("image_path"))


def chips(spark: SparkSession, root: str) -> DataFrame:
    """identity, image_path of a flat folder; the identity is in the file name."""
    f = _files(spark, root).where(F.lower("path").rlike(r"\.(" + "|".join(SCAN[:3]) + ")$"))
    return f.select(text.identity_of_name(text.basename(F.col("path"))).alias("identity"), F.col("path").alias("image_path"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, vector of a two-dimensional .npy file, read through Spark."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf.content:
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pd.DataFrame({"row": np.arange(len(m)), "vector": list(np.atleast_2d(m.astype(float)))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row long, vector array<double>")


def result_document(spark: SparkSession, path: str) -> DataFrame:
    """A sweep's result document; fields that a document lacks are null."""
    kinds = "algorithm STRING, pred_labels ARRAY<INT>, best_params MAP<STRING, DOUBLE>, all_results ARRAY<MAP<STRING, DOUBLE>>, per_identity MAP<STRING, STRUCT<total: INT, noise: INT, n_clusters: INT>>"
    return spark.read.schema(kinds).json(path, multiLine=True).withColumn("all_results", F.coalesce("all_results", F.array()))


def latency(spark: SparkSession, path: str) -> DataFrame:
    """file, faces_aligned, latency_ms of a latency document."""
    return spark.read.schema("file STRING, faces_aligned INT, latency_ms DOUBLE").json(path, multiLine=True)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """filename, total_faces_found, box_index, crop_filename, x, y, width, height of a detection registry document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.REGISTRY).alias("m"))
    return explode_registry(doc, "m")


def explode_registry(docs: DataFrame, column: str) -> DataFrame:
    one = docs.select(F.explode(column).alias("filename", "e"))
    box = one.select("filename", F.col("e.total_faces_found").alias("total_faces_found"), F.explode_outer("e.bounding_boxes").alias("b"))
    return box.select("filename", "total_faces_found", "b.box_index", "b.crop_filename", "b.coordinates.x", "b.coordinates.y", "b.coordinates.width", "b.coordinates.height")


def relational(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None) -> DataFrame:
    """A table of a database; credentials come with `options`, from wherever the caller keeps them."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).load()


def cluster_folders(spark: SparkSession, root: str) -> DataFrame:
    """An exported manifest, with run_label, model and cluster_folder from its partitions."""
    return spark.read.parquet(root)


def face_by_id(faces: DataFrame, face_id: int) -> DataFrame:
    return faces.where(F.col("id") == face_id)


def face_by_path(faces: DataFrame, path: str, index: int | None = None) -> DataFrame:
    hit = faces.where(F.col("image_path") == path)
    return hit if index is None else hit.where(F.col("face_index") == index)


def members_of(results: DataFrame, run: str, label: int) -> DataFrame:
    return results.where((F.col("run_label") == run) & (F.col("cluster_label") == label)).select("face_id").orderBy("face_id")
