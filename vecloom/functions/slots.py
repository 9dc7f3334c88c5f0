"""Slots for models: the engine holds none, and takes detection and extraction as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[bytes], np.ndarray]
Detector = Callable[[bytes], list[dict]]
#: name -> a function without arguments that loads a model and returns its extractor; called once per worker.
EXTRACTORS: dict[str, Callable[[], Extractor]] = {}

#: Model, side of its input in pixels, how a face is brought to it, share of the box added on each side.
INPUT_SPECS = (
    ("arcface", 112, "insightface_norm_crop", None),
    ("dlib_resnet", 150, "dlib_chip", None),
    ("facenet", 160, "bbox_margin_crop", 0.25),
    ("siglip2", 224, "bbox_margin_crop", 0.4),
)

Aligner = Callable[[bytes, list, list], bytes]

DETECTION = "path string, face_index int, bbox array<float>, landmarks array<array<float>>, det_score float"


def register(name: str, load: Callable[[], Extractor]) -> None:
    EXTRACTORS[name] = load


def extract(crops: DataFrame, load: Callable[[], Extractor], column: str = "content") -> DataFrame:
    """crops with `vector`, unit norm: `load` runs once per worker, then the extractor on every row."""

    @F.pandas_udf("array<float>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out = []
            for raw in s:
                v = np.asarray(model(raw), dtype=np.float64)
                out.append((v / max(float(np.linalg.norm(v)), 1e-10)).astype(np.float32))
            yield pd.Series(out)

    return crops.withColumn("vector", udf(F.col(column)))


def input_specs(spark: SparkSession) -> DataFrame:
    """model, size, alignment, margin: which alignment feeds which model.  Join it to say what crops a run needs."""
    return spark.createDataFrame(list(INPUT_SPECS), "model string, size int, alignment string, margin double")


def align(faces: DataFrame, load: Callable[[], Aligner]) -> DataFrame:
    """faces(content, bbox, landmarks, ...) with `crop`: `load` runs once per worker, its aligner on every face."""

    @F.pandas_udf("binary")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        aligner = load()
        for content, boxes, points in batches:
            yield pd.Series([aligner(c, b, p) for c, b, p in zip(content, boxes, points, strict=True)])

    return faces.withColumn("crop", udf("content", "bbox", "landmarks"))


def detect(images: DataFrame, load: Callable[[], Detector]) -> DataFrame:
    """DETECTION rows of images(path, content): one image gives any number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            rows = [{"path": p, "face_index": i, "bbox": f["bbox"], "landmarks": f["landmarks"], "det_score": f["det_score"]} for p, c in zip(pdf.path, pdf.content, strict=True) for i, f in enumerate(model(c))]
            yield pd.DataFrame(rows, columns=["path", "face_index", "bbox", "landmarks", "det_score"])

    return images.select("path", "content").mapInPandas(run, DETECTION)
