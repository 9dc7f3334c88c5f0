"""Arriving vectors as a stream: each micro-batch is decided in order and leaves a new version of the centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.decide import Thresholds
from vecloom.operators.incremental import sequential
from vecloom.schema import NOISE
from vecloom.sources.scratch import settled
from vecloom.sources.tables import Store, upsert

ARRIVALS = "run_label string, seq long, face_id long, vector array<double>"


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of ARRIVALS."""
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(batch: DataFrame, members: DataFrame) -> DataFrame:
    """The arrivals that are due a decision: the first of each face by seq, without those that are members of a cluster."""
    turn = Window.partitionBy("run_label", "face_id").orderBy("seq", "vector")
    fresh = batch.join(members.where(F.col("cluster_label") != NOISE).select("run_label", "face_id"), ["run_label", "face_id"], "left_anti")
    return fresh.withColumn("_n", F.row_number().over(turn)).where("_n = 1").select(batch.columns)


def apply_batch(store: Store, batch: DataFrame, epoch: int, t: Thresholds = Thresholds(), compact_every: int = 100, also: dict[str, DataFrame] | None = None) -> None:
    """Decides one micro-batch and publishes decisions, members, centroids and pending reviews together.

    A commit, written last, names the new versions.  A batch that is delivered again after a failure starts from the
    last commit: what the failed attempt wrote is above it, counts for nothing and is written over.  A batch whose epoch
    is committed is skipped.

    A face is decided once in a run: of arrivals that repeat it within a batch the first by seq counts, and one that is a
    member of a cluster already is passed over.  Noise that arrives and is taken is noise no more.  A face that waits for review may come again; it waits once.  Additions are folded
    into whole versions every `compact_every` epochs, so the folders that a batch lists stay few.  also: rows to add to
    other tables, published by the same commit.
    """
    last, versions = store.committed()
    if epoch <= last:
        return
    members, cents, waiting = store.read("members"), store.read("centroids"), store.read("pending_reviews")
    batch = settled(once(batch, members), "arrivals")
    out = sequential(batch, members, cents, t, grow=True).withColumn("epoch", F.lit(epoch).cast("long"))
    decided = store.write("decided", out)
    out = store.read("decided", decided)
    taken = out.where(F.col("status") != "ask_user")
    newest = taken.groupBy("run_label", "cluster_label").agg(F.max_by(F.struct("centroid", "n_members", "representative_face_id"), "seq").alias("s")).select("run_label", "cluster_label", "s.*")
    new = batch.join(taken.select("run_label", "face_id", "cluster_label"), ["run_label", "face_id"]).select("run_label", "face_id", "cluster_label", "vector")
    was_noise = members.where(F.col("cluster_label") == NOISE).join(taken.select("run_label", "face_id"), ["run_label", "face_id"], "left_semi")
    if was_noise.isEmpty():
        at = store.append("members", new)
    else:
        at = store.write("members", members.join(taken.select("run_label", "face_id"), ["run_label", "face_id"], "left_anti").select(new.columns).unionByName(new))
    reviews = out.where(F.col("status") == "ask_user").select("run_label", "seq", "face_id", "cluster_label", "distance")
    versions |= {
        "decided": decided,
        "centroids": store.write("centroids", upsert(cents, newest, ("run_label", "cluster_label"))),
        "members": at,
        "pending_reviews": store.append("pending_reviews", reviews.join(waiting.select("run_label", "face_id"), ["run_label", "face_id"], "left_anti").select(reviews.columns)),
        "decisions": store.append("decisions", out.select("epoch", "run_label", "seq", "face_id", "status", "cluster_label", "distance")),
    }
    versions |= {name: store.append(name, rows) for name, rows in (also or {}).items()}
    store.commit(epoch, versions)
    if (epoch + 1) % compact_every == 0:
        store.commit(epoch, versions | {name: store.compact(name) for name in ("members", "pending_reviews", "decisions", *(also or {}))})


def prepare(store: Store, members: DataFrame, cents: DataFrame) -> None:
    """First versions of the tables, committed as epoch -1; a store that has them is left as it is."""
    if store.committed()[1]:
        return
    versions = {
        "members": store.write("members", members.select("run_label", "face_id", "cluster_label", "vector")),
        "centroids": store.write("centroids", cents.select("run_label", "cluster_label", "centroid", "n_members", "representative_face_id")),
    }
    store.create("pending_reviews", "run_label string, seq long, face_id long, cluster_label int, distance double")
    store.create("decisions", "epoch long, run_label string, seq long, face_id long, status string, cluster_label int, distance double")
    store.commit(-1, {**versions, "pending_reviews": 0, "decisions": 0, "decided": -1})


def start(stream: DataFrame, store: Store, checkpoint: str, t: Thresholds = Thresholds(), available_now: bool = False) -> StreamingQuery:
    """Runs apply_batch on every micro-batch of a stream of ARRIVALS."""
    w = stream.writeStream.foreachBatch(lambda df, epoch: apply_batch(store, df, epoch, t)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
