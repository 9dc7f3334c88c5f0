"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: sends the package's sources to the workers, wherever the driver imported them from."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else it was itself imported from an archive, which Spark has shipped
        root = os.path.dirname(package)
        path = os.path.join(tempfile.mkdtemp(prefix="vecloom-"), "vecloom-sources.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in sorted(os.walk(package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
    _done.add(sc.applicationId)
