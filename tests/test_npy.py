"""`.npy` files written and read by stretches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.sources import npy, scan

ROWS = "face_id long, identity string, vector array<double>"


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(11).normal(size=(523, 7))


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(int(i) * 3 + 5, f"someone ünknown {i % 13}😀", vectors[i].tolist()) for i in np.random.default_rng(2).permutation(len(vectors))]
    return spark.createDataFrame(rows, ROWS).repartition(6)


def test_a_matrix_is_what_numpy_saves(spark, table, vectors, tmp_path):
    path = f"{tmp_path}/m.npy"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert npy.write(table, path, "vector", "face_id") == 523
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    np.save(f"{tmp_path}/plain.npy", vectors)
    assert open(path, "rb").read() == open(f"{tmp_path}/plain.npy", "rb").read() and sorted(os.listdir(tmp_path)) == ["m.npy", "plain.npy"]
    got = {r["row"]: r["vector"] for r in scan.matrix(spark, path).collect()}
    assert np.array_equal(np.array([got[i] for i in range(523)]), vectors)


def test_labels_and_single_precision(spark, table, vectors, tmp_path):
    npy.write(table, f"file://{tmp_path}/l.npy", "identity", "face_id")
    labels = np.load(f"{tmp_path}/l.npy")
    assert labels.tolist() == [f"someone ünknown {i % 13}😀" for i in range(523)]
    np.save(f"{tmp_path}/plain.npy", labels)
    assert open(f"{tmp_path}/l.npy", "rb").read() == open(f"{tmp_path}/plain.npy", "rb").read()
    npy.write(table, f"{tmp_path}/s.npy", "vector", "face_id", dtype="<f4")
    assert np.array_equal(np.load(f"{tmp_path}/s.npy"), vectors.astype("f4"))


@pytest.mark.parametrize("stretch", [1, 1000, 1 << 20])
def test_files_are_read_in_stretches(spark, vectors, tmp_path, stretch):
    few = vectors[:40]
    np.save(f"{tmp_path}/m.npy", few.astype("f4"))
    df = npy.read(spark, f"file://{tmp_path}/m.npy", stretch)
    assert df.rdd.getNumPartitions() == -(-40 // max(1, stretch // 28))
    got = df.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(40)) and np.array_equal(np.array([r["vector"] for r in got]), few.astype("f4").astype(float))
    np.save(f"{tmp_path}/l.npy", np.array(["a", "", "ümlaut"]))
    assert [r["value"] for r in npy.read(spark, f"{tmp_path}/l.npy", stretch).orderBy("row").collect()] == ["a", "", "ümlaut"]
    np.save(f"{tmp_path}/n.npy", np.array([3, -1]))
    assert [r["value"] for r in npy.read(spark, f"{tmp_path}/n.npy", stretch).orderBy("row").collect()] == [3.0, -1.0]


def test_what_cannot_be_read(spark, vectors, tmp_path):
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(vectors))
    np.save(f"{tmp_path}/c.npy", vectors[:3].astype(complex))
    for name in ("f", "c"):
        with pytest.raises(ValueError, match="shape"):
            npy.read(spark, f"{tmp_path}/{name}.npy")
    np.save(f"{tmp_path}/t.npy", vectors)
    os.truncate(f"{tmp_path}/t.npy", 5000)
    with pytest.raises(Exception, match="ends early"):
        npy.read(spark, f"{tmp_path}/t.npy").collect()


def test_a_failure_leaves_the_old_file(spark, table, tmp_path, monkeypatch):
    path = f"{tmp_path}/m.npy"
    np.save(path, np.eye(2))

    def broken(*_):
        def run(batches):
            raise RuntimeError("lost")
            yield

        return run

    monkeypatch.setattr(npy, "_writer", broken)
    with pytest.raises(Exception, match="lost"):
        npy.write(table, path, "vector", "face_id")
    assert np.array_equal(np.load(path), np.eye(2)) and os.listdir(tmp_path) == ["m.npy"]


def test_refused_and_empty_rows(spark, table, tmp_path):
    path = f"{tmp_path}/m.npy"
    odd = table.withColumn("vector", F.when(F.col("face_id") == 8, F.array(F.lit(1.0))).otherwise(F.col("vector")))
    with pytest.raises(ValueError, match="1 to 7 entries"):
        npy.write(odd, path, "vector", "face_id")
    for null in (table.withColumn("vector", F.when(F.col("face_id") != 8, F.col("vector"))), table.withColumn("vector", F.when(F.col("face_id") == 8, F.array_repeat(F.lit(None).cast("double"), 7)).otherwise(F.col("vector")))):
        with pytest.raises(ValueError, match="null"):
            npy.write(null, path, "vector", "face_id")
    with pytest.raises(ValueError, match="mounted"):
        npy.write(table, "hdfs://host/m.npy", "vector", "face_id")
    assert os.listdir(tmp_path) == []
    assert npy.write(table.limit(0), path, "vector", "face_id") == 0 and np.load(path).shape == (0, 0)
    assert npy.write(table.limit(0), path, "identity", "face_id") == 0 and np.load(path).shape == (0,)
    assert npy.read(spark, path).count() == 0
