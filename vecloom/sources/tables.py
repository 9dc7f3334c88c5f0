"""Keyed tables as immutable versions: every change is a new DataFrame, and a store keeps numbered Parquet versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.ranks import numbered
from vecloom.sources.scratch import delete


def upsert(table: DataFrame, rows: DataFrame, keys: tuple[str, ...], keep_old: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """table with rows written over it by key: new values win, except in the columns of keep_old.

    Several rows of one key count as if written one after the other by `order`, so the last one's values stay, and the
    first one's in the columns of keep_old.  Rows that `order` does not tell apart, or all if it is not given, come in
    the order of their values, column by column.  Rows without a key, a null in one of its columns, name nothing and are
    left out.  Rows of the table that are not named stay.
    """
    values = [c for c in table.columns if c not in keys]
    given = [c for c in values if c in rows.columns]
    kept, set_ = [c for c in given if c in keep_old], [c for c in given if c not in keep_old]
    turn = F.struct(*([order] if order else []), *given)
    ends = [f(F.struct(*cols), turn).alias(name) for f, cols, name in ((F.min_by, kept, "_first"), (F.max_by, set_, "_last")) if cols]
    named = rows.dropna(subset=list(keys))
    one = named.groupBy(*keys).agg(*ends) if ends else named.select(*keys).distinct()
    rows = one.select(*keys, *[F.col(f"_first.{c}") for c in kept], *[F.col(f"_last.{c}") for c in set_])
    new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") if c in rows.columns else F.lit(None).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    old = table.withColumn("_was", F.lit(True))
    both = old.join(new, [*keys], "full_outer")

    def value(c: str):
        if c not in rows.columns:
            return F.col(c)
        if c in keep_old:
            return F.when(F.col("_was"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))

    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in table.columns])


def upsert_faces(faces: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("image_path",), order: str | None = None) -> DataFrame:
    """Faces by path (or path and index): a path that is known keeps its identity, id and creation time.

    Fresh paths get ids above the largest, in the order of their keys; one that comes several times gets one id, and the
    identity that came first.
    """
    kept = tuple(c for c in ("id", "identity", "created_at") if c in faces.columns)
    out = upsert(faces, rows, keys, kept, order)
    top = faces.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = out.where(F.col("id").isNull()).join(top, F.lit(True))  # top is one row
    fresh = numbered(fresh, "_fresh", *keys).withColumn("id", (F.col("top") + F.col("_fresh") + 1).cast("long"))
    return out.where(F.col("id").isNotNull()).unionByName(fresh.select(out.columns))


def upsert_embeddings(table: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("face_id",), order: str | None = None) -> DataFrame:
    """Vector and dim replaced by key."""
    return upsert(table, rows.withColumn("dim", F.size("vector")), keys, order=order)


def upsert_labels(table: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("run_label", "face_id"), order: str | None = None) -> DataFrame:
    """Labels replaced by key; labels of faces that a new run does not name survive."""
    return upsert(table, rows, keys, order=order)


def relabel(table: DataFrame, run: str, old: int, new: int) -> DataFrame:
    hit = (F.col("run_label") == run) & (F.col("cluster_label") == old)
    return table.withColumn("cluster_label", F.when(hit, new).otherwise(F.col("cluster_label")).cast("int"))


def update_labels(table: DataFrame, rows: DataFrame, key: str = "face_id") -> DataFrame:
    """cluster_label set by id; ids that the table does not have are ignored."""
    new = rows.select(key, F.col("cluster_label").alias("_new"))
    return table.join(new, key, "left").withColumn("cluster_label", F.coalesce("_new", "cluster_label")).select(table.columns)


def delete_centroids(cents: DataFrame, run: str, label: int | None = None) -> DataFrame:
    """Without one centroid of a run, or without all of them."""
    hit = F.col("run_label") == run
    return cents.where(~(hit if label is None else hit & (F.col("cluster_label") == label)))


class Store:
    """Numbered versions of tables under one path.

    A version is a whole table or an addition to the version before, so appending writes only what is new.  Without a
    commit the last complete version of a table counts; commit() names the versions of several tables that count
    together, by one write, and versions above them are the leavings of a failed attempt.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """(version, 'v' for a whole table or 'a' for an addition), complete ones only."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        return sorted((int(q.getName()[1:]), q.getName()[0]) for q in found if q.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS")))

    def create(self, name: str, schema: str) -> None:
        """An empty first version, unless there is one."""
        if not self._versions(name):
            self.write(name, self.spark.createDataFrame([], schema))

    def version(self, name: str) -> int:
        """The version that counts; -1 without any."""
        named = self.committed()[1]
        return named[name] if name in named else max([v for v, _ in self._versions(name)], default=-1)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        upto = self.version(name) if version is None else version
        known = [(v, kind) for v, kind in self._versions(name) if v <= upto]
        if not known:
            raise FileNotFoundError(f"{self.path}/{name} has no version")
        whole = max([i for i, (_, kind) in enumerate(known) if kind == "v"], default=0)
        paths = [f"{self.path}/{name}/{kind}{v}" for v, kind in known[whole:]]
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def write(self, name: str, df: DataFrame, *partition_by: str) -> int:
        """Adds a version; readers of older ones are not disturbed."""
        return self._put(name, df, "v", partition_by)

    def append(self, name: str, df: DataFrame) -> int:
        """A version that adds rows to the one before; only these rows are written."""
        return self._put(name, df, "a" if self.version(name) >= 0 else "v")

    def compact(self, name: str) -> int:
        """The table as one whole version again: for now and then, since every addition is a folder to list."""
        return self.write(name, self.read(name))

    def _put(self, name: str, df: DataFrame, kind: str, partition_by: tuple[str, ...] = ()) -> int:
        version = self.version(name) + 1
        self._forget(name, version)
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{name}/{kind}{version}")
        return version

    def _forget(self, name: str, version: int) -> None:
        """Deletes what a failed attempt left at a version that is about to be written."""
        for v, kind in self._versions(name):
            if v >= version:
                delete(self.spark, f"{self.path}/{name}/{kind}{v}")

    def commit(self, epoch: int, versions: dict[str, int]) -> None:
        """From now on these versions count, all at once."""
        row = self.spark.createDataFrame([(epoch, versions)], "epoch long, versions map<string,int>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v{epoch + 1}")

    def committed(self) -> tuple[int, dict[str, int]]:
        """Epoch and versions of the last commit; -1 and none without any."""
        known = self._versions("commits")
        if not known:
            return -1, {}
        r = self.spark.read.parquet(f"{self.path}/commits/v{known[-1][0]}").head()
        return r["epoch"], dict(r["versions"])

    def truncate(self, name: str) -> int:
        return self.write(name, self.read(name).limit(0))
