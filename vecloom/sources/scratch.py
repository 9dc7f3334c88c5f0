"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from vecloom.sources.ship import ship

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[int, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; where it is unset, a folder of this process, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = id(spark.sparkContext)
        if key not in _own:
            _own[key] = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        base = _own[key]
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, each finished SQL execution deletes its own shuffle files: what it wrote is the only copy kept."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table: lineage ends there, and a lost executor loses nothing of it.

    Operators start here, so this is also where the package is shipped to the workers, whoever calls them.
    """
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/vecloom-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rolled(df: DataFrame, name: str, held: list[str]) -> DataFrame:
    """settled() for rounds that each need only the table before: once this one is written, those in `held` are deleted."""
    out = settled(df, name)
    now = _made[-1]
    while held:
        old = held.pop()
        _made.remove(old)
        delete(df.sparkSession, old)
    held.append(now)
    return out


def cleanup(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process has made so far, and says how many they were.

    All lazy results that still read them fail afterwards: this is for the end of a job, once everything is written.
    `made()` within a job deletes only what that job made.
    """
    count = len(_made)
    while _made:
        delete(spark, _made.pop())
    return count


@contextlib.contextmanager
def made(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables that were made within it; results must be written by then."""
    start = len(_made)
    try:
        yield
    finally:
        while len(_made) > start:
            delete(spark, _made.pop())
