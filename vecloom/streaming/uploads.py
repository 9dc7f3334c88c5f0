"""Image files as a stream: what is dropped into a folder is checked, detected, aligned, embedded and decided.

One image may hold any number of faces.  A file that is no whole image, or that a model fails on, becomes a row of the
table `rejected` with the reason, and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.functions.slots import Aligner, Detector, Extractor
from vecloom.operators.decide import Thresholds
from vecloom.operators.ranks import numbered
from vecloom.sources.images import fault
from vecloom.sources.scratch import settled
from vecloom.sources.ship import ship
from vecloom.sources.tables import Store
from vecloom.streaming.arrivals import apply_batch

UPLOADS = "path string, modificationTime timestamp, length long, content binary"
FACES = "path string, arrived timestamp, face_index int, det_score double, vector array<double>, reason string"
REJECTED = "path string, length long, reason string"


@dataclass(frozen=True)
class Models:
    """Functions without arguments that load what a worker needs, once each."""

    detector: Callable[[], Detector]
    aligner: Callable[[], Aligner]
    extractor: Callable[[], Extractor]


def uploads(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The files of a folder as a stream of UPLOADS."""
    return spark.readStream.format("binaryFile").schema(UPLOADS).option("maxFilesPerTrigger", files_per_trigger).load(path)


def faces_of(images: DataFrame, models: Models) -> DataFrame:
    """FACES rows of images(path, modificationTime, content): one for each face, or one with the reason why there is none.

    An image without faces has no row: nothing was found in it, and nothing is wrong with it.
    """
    ship(images.sparkSession)

    def faces(raw: bytes | None, detect: Detector, align: Aligner, extract: Extractor) -> Iterator[tuple]:
        wrong = fault(raw)
        if wrong:
            yield None, None, None, wrong
            return
        try:
            found = []
            for i, f in enumerate(detect(raw)):
                v = np.asarray(extract(align(raw, f["bbox"], f["landmarks"])), dtype=np.float64)
                found.append((i, float(f["det_score"]), (v / max(float(np.linalg.norm(v)), 1e-10)).tolist(), None))
        except Exception as e:  # whatever a model makes of a file is the file's reason, not the stream's end
            yield None, None, None, f"{type(e).__name__}: {e}"
            return
        yield from found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = models.detector(), models.aligner(), models.extractor()
        kinds = pa.schema([("path", pa.string()), ("arrived", pa.timestamp("us", "UTC")), ("face_index", pa.int32()), ("det_score", pa.float64()), ("vector", pa.list_(pa.float64())), ("reason", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):  # one image at a time: they may be large
                path, when, raw = (batch.column(c)[i].as_py() for c in ("path", "modificationTime", "content"))
                rows = [(path, when, *f) for f in faces(raw, *loaded)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return images.select("path", "modificationTime", "content").mapInArrow(run, FACES)


def as_arrivals(faces: DataFrame, run_label: str) -> DataFrame:
    """ARRIVALS of FACES rows: files in the order in which they came, then faces as they were found.

    A face's id is a hash of its path and index, so a file that comes again brings the same ids.
    """
    order = numbered(faces.select("path", "face_index", "arrived", "vector"), "seq", "arrived", "path", "face_index")
    name = F.xxhash64("path", "face_index").bitwiseAND(F.lit(2**63 - 1))
    return order.select(F.lit(run_label).alias("run_label"), F.col("seq").cast("long").alias("seq"), name.alias("face_id"), "vector")


def apply_uploads(store: Store, batch: DataFrame, epoch: int, models: Models, run_label: str, t: Thresholds = Thresholds()) -> None:
    """Decides the faces of one micro-batch of files, and publishes them with the files that were rejected."""
    if epoch <= store.committed()[0]:
        return
    found = settled(faces_of(batch, models), "faces")
    refused = found.where("reason IS NOT NULL").join(batch.select("path", "length").distinct(), "path").select("path", "length", "reason")
    apply_batch(store, as_arrivals(found.where("reason IS NULL"), run_label), epoch, t, also={"rejected": refused})


def start(stream: DataFrame, store: Store, checkpoint: str, models: Models, run_label: str, t: Thresholds = Thresholds(), available_now: bool = False) -> StreamingQuery:
    """Runs apply_uploads on every micro-batch of a stream of UPLOADS; arrivals.prepare comes first."""
    store.create("rejected", REJECTED)
    w = stream.writeStream.foreachBatch(lambda df, epoch: apply_uploads(store, df, epoch, models, run_label, t)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
