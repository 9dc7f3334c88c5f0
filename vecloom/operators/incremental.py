"""Changes to a run that depend on order: assignment, new clusters, noise reclamation as an ordered fold."""

from __future__ import annotations

import math
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.operators.decide import Thresholds
from vecloom.operators.pairs import block_pairs
from vecloom.operators.ranks import numbered
from vecloom.schema import NOISE
from vecloom.sources.scratch import settled
from vecloom.sources.ship import ship

#: Vectors of clusters that one ordered fold may hold (the members of one run that its spread checks can need).
FOLD_STATE_LIMIT = 200_000
#: Members of a run up to which a fold is simply given all of them.
WHOLE_UP_TO = 20_000
#: Angles by which a centroid may turn within a fold; the smallest that can be shown to hold is taken, else half a turn.
TURNS = tuple(0.005 * 2**i for i in range(10))
FOLD = "run_label string, seq long, face_id long, status string, cluster_label int, distance double, n_members long, representative_face_id long, centroid array<double>"


def assign(cents: DataFrame, faces: DataFrame, members: DataFrame, label: int) -> DataFrame:
    """Centroids after one face, faces(face_id, vector), joined cluster `label`.

    The centroid is the running mean of the normalised old one; the face becomes the representative if it is nearer to
    the new centroid than the old representative.  A label without a centroid starts one.
    """
    one = faces.select(F.col("face_id").alias("new_id"), F.col("vector").alias("new_v"))
    rep = members.select(F.col("face_id").alias("representative_face_id"), F.col("vector").alias("rep_v"))
    old = cents.where(F.col("cluster_label") == label).join(rep, "representative_face_id", "left")
    run = cents.select("run_label").limit(1)
    both = one.join(old, F.lit(True), "left")  # one face, at most one centroid
    fresh = F.col("cluster_label").isNull()
    c = F.when(fresh, F.col("new_v")).otherwise(vec.running_centroid(F.col("centroid"), F.col("n_members"), F.col("new_v")))
    both = both.withColumn("c", c)
    nearer = fresh | F.col("rep_v").isNull() | (vec.cosine_distance(F.col("c"), F.col("new_v")) < vec.cosine_distance(F.col("c"), F.col("rep_v")))
    new = both.join(run.withColumnRenamed("run_label", "r"), F.lit(True), "left").select(
        F.coalesce("run_label", "r").alias("run_label"),
        F.lit(label).alias("cluster_label"),
        F.col("c").alias("centroid"),
        (F.coalesce("n_members", F.lit(0)) + 1).cast("long").alias("n_members"),
        F.when(nearer, F.col("new_id")).otherwise(F.col("representative_face_id")).alias("representative_face_id"),
    )
    return cents.where(F.col("cluster_label") != label).unionByName(new.select(cents.columns))


def start_cluster(cents: DataFrame, labels: DataFrame, faces: DataFrame) -> DataFrame:
    """Centroids with one more: a singleton for the face, labelled one above the largest label of a cluster."""
    from vecloom.operators.centroids import next_label

    new = faces.join(next_label(labels), F.lit(True)).join(labels.select("run_label").limit(1), F.lit(True), "left")  # one row each
    new = new.select("run_label", F.col("next_label").cast("int").alias("cluster_label"), F.col("vector").alias("centroid"), F.lit(1).cast("long").alias("n_members"), F.col("face_id").alias("representative_face_id"))
    return cents.unionByName(new.select(cents.columns))


class Fold:
    """The state of one run: centroids, sizes, representatives and what the spread check needs."""

    def __init__(self, t: Thresholds, grow: bool):
        self.t, self.grow = t, grow
        self.label: list[int] = []
        self.c: list[np.ndarray] = []
        self.n: list[int] = []
        self.rep: list[tuple[int, np.ndarray | None]] = []
        self.members: dict[int, list[np.ndarray]] = {}

    def decide(self, v: np.ndarray) -> tuple[str, int | None, float | None]:
        if not self.label:
            return "new_cluster", None, None
        m = np.stack(self.c)
        d = 1.0 - (m @ v) / (np.maximum(np.linalg.norm(m, axis=1), vec.EPS) * max(float(np.linalg.norm(v)), vec.EPS))
        i = int(np.argmin(np.round(d, 12)))
        if d[i] < self.t.t1:
            own = self.members.get(self.label[i])
            if own:
                x = np.stack(own)
                spread = float((1.0 - (x @ self.c[i]) / (np.maximum(np.linalg.norm(x, axis=1), vec.EPS) * max(float(np.linalg.norm(self.c[i])), vec.EPS))).max())
                if d[i] > spread * self.t.spread_margin:
                    return "ask_user", i, float(d[i])
            return "auto_merge", i, float(d[i])
        return ("ask_user" if d[i] < self.t.t2 else "new_cluster"), i, float(d[i])

    def join(self, i: int, face: int, v: np.ndarray) -> None:
        c = (self.c[i] * self.n[i] + v) / (self.n[i] + 1)
        self.c[i], self.n[i] = c / max(float(np.linalg.norm(c)), vec.EPS), self.n[i] + 1
        old = self.rep[i][1]
        cos = lambda u: float(u @ self.c[i]) / max(float(np.linalg.norm(u)), vec.EPS)
        if old is None or cos(v) > cos(old):
            self.rep[i] = (face, v)
        self.members.setdefault(self.label[i], []).append(v)

    def start(self, face: int, v: np.ndarray) -> int:
        label = max([*self.label, *[x for x in self.members if x != NOISE], -1]) + 1
        self.label.append(label)
        self.c.append(v)
        self.n.append(1)
        self.rep.append((face, v))
        self.members[label] = [v]
        return len(self.label) - 1

    def step(self, face: int, v: np.ndarray) -> tuple[str, int | None, float | None]:
        status, i, d = self.decide(v)
        if status == "auto_merge":
            self.join(i, face, v)
        elif status == "new_cluster" and self.grow:
            i = self.start(face, v)
        return status, i, d


def turns(queue: DataFrame, cents: DataFrame, t: Thresholds) -> DataFrame:
    """run_label, cluster_label, centroid, turn: an angle by which the centroid turns at most while queue is folded.

    A vector joins within the angle of t1, so the j-th join turns a centroid of n members by at most
    atan(|v| sin(t1's angle) / (n + j)).  As long as it has turned by no more than some angle, only vectors within t1's
    angle and that one of where it began can join.  Are they so few that all of them together turn it by no more, then
    the angle holds to the end, by induction over the joins.  Vectors near a centroid are counted block by block.
    """
    about = settled(numbered(cents.select("run_label", "cluster_label", "centroid", "n_members"), "c", "run_label", "cluster_label"), "numbered")
    if t.t1 >= 1.0:  # joins from behind: nothing is bounded
        return about.select("run_label", "cluster_label", "centroid", F.lit(math.pi).alias("turn"))
    reach = math.acos(1.0 - t.t1)

    def near(_ids, _ga, x, cs, _gb, y):
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), vec.EPS)
        angle = np.arccos(np.clip(unit(y) @ unit(x).T, -1.0, 1.0))
        for turn in TURNS:
            k = (angle <= reach + turn + 1e-7).sum(axis=1)
            some = np.flatnonzero(k)
            yield {"c": cs[some], "turn": np.full(len(some), turn), "k": k[some]}

    vectors = queue.select(F.xxhash64("run_label", "seq", "face_id").alias("face_id"), "vector")
    other = about.select(F.col("c").cast("long").alias("face_id"), F.col("centroid").alias("vector"))
    counted = block_pairs(vectors, near, "c long, turn double, k long", other=other).groupBy("c", "turn").agg(F.sum("k").alias("k"))
    longest = queue.agg(F.max(vec.norm(F.col("vector")))).head()[0] or 0.0
    tried = about.withColumn("turn", F.explode(F.array(*map(F.lit, TURNS)))).join(counted, ["c", "turn"], "left")
    n = F.greatest(F.col("n_members").cast("double"), F.lit(1e-9))
    first = 1.0 / (n * F.greatest(vec.norm(F.col("centroid")), F.lit(1e-9)))
    turned = F.when(F.col("k").isNull(), 0.0).otherwise(longest * math.sin(reach) * (first + F.log((n + F.col("k") - 1.0) / n)))
    held = tried.where(turned * (1 + 1e-9) <= F.col("turn")).groupBy("c").agg(F.min("turn").alias("turn"))
    return about.join(held, "c", "left").select("run_label", "cluster_label", "centroid", F.coalesce("turn", F.lit(math.pi)).alias("turn"))


def outermost(queue: DataFrame, members: DataFrame, cents: DataFrame, t: Thresholds) -> DataFrame:
    """The members that a fold of queue can need: those that may be the farthest of their cluster at some time of it.

    A centroid that turns by at most a brings no member nearer or farther by more than a, so whoever is more than 2a nearer
    to it than the farthest stays behind the farthest throughout.  Representatives stay, and one member of every label, so
    that labels of clusters without a centroid count as taken.
    """
    bound = turns(queue, cents, t)
    cosine = 1.0 - vec.cosine_distance(F.col("centroid"), F.col("vector"))
    angled = settled(members.join(bound, ["run_label", "cluster_label"], "left").select(*members.columns, "turn", F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))).alias("angle")), "angles")
    edge = angled.groupBy("run_label", "cluster_label").agg(F.max("angle").alias("widest"), F.min("face_id").alias("least"))
    reps = cents.select("run_label", F.col("representative_face_id").alias("face_id")).distinct().withColumn("rep", F.lit(True))
    about = angled.join(edge, ["run_label", "cluster_label"]).join(reps, ["run_label", "face_id"], "left")
    kept = (F.col("face_id") == F.col("least")) | F.col("rep") | (F.col("angle") >= F.col("widest") - 2 * F.col("turn") - 1e-7)
    return about.where(F.coalesce(kept, F.lit(False))).select(members.columns)


def sequential(queue: DataFrame, members: DataFrame, cents: DataFrame, t: Thresholds = Thresholds(), grow: bool = False, whole_up_to: int = WHOLE_UP_TO) -> DataFrame:
    """FOLD rows: each vector of queue(run_label, seq, face_id, vector) decided in order of seq, merges taking effect at once.

    grow: vectors that are due a new cluster start one (arrivals); else they stay as they are (noise reclamation).
    A run is one fold and so one task: every decision may depend on the one before.  Of a run with more than `whole_up_to`
    members the task is given only the outermost, with the same decisions; if those are more than FOLD_STATE_LIMIT, as
    when a queue is large beside small clusters, the fold is refused.
    """
    ship(queue.sparkSession)
    state = members.where(F.col("cluster_label") != NOISE)
    largest = lambda: state.groupBy("run_label").count().agg(F.max("count")).head()[0] or 0
    if largest() > whole_up_to:
        state = settled(outermost(queue, state, cents, t), "outermost")
        held = largest()
        if held > FOLD_STATE_LIMIT:
            raise ValueError(f"an ordered fold of this queue needs {held} members of a run (limit {FOLD_STATE_LIMIT}); fold shorter queues, or decide against frozen centroids")
    kinds = "run_label string, kind int, seq long, face_id long, cluster_label int, n long, vector array<double>"
    pick = lambda df, kind, seq, label, n, v: df.selectExpr("run_label", f"{kind} AS kind", f"CAST({seq} AS LONG) AS seq", "face_id", f"CAST({label} AS INT) AS cluster_label", f"CAST({n} AS LONG) AS n", f"{v} AS vector")
    rows = pick(cents.withColumnRenamed("representative_face_id", "face_id"), 0, "cluster_label", "cluster_label", "n_members", "centroid")
    rows = rows.unionByName(pick(state, 1, "face_id", "cluster_label", "NULL", "vector")).unionByName(pick(queue, 2, "seq", "NULL", "NULL", "vector"))
    options = asdict(t)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = Fold(Thresholds(**options), grow)
        pdf = pdf.sort_values(["kind", "seq", "face_id"])
        known = {}
        for r in pdf[pdf.kind == 1].itertuples():
            v = np.asarray(r.vector, dtype=float)
            known[r.face_id] = v
            fold.members.setdefault(int(r.cluster_label), []).append(v)
        for r in pdf[pdf.kind == 0].itertuples():
            fold.label.append(int(r.cluster_label))
            fold.c.append(np.asarray(r.vector, dtype=float))
            fold.n.append(int(r.n))
            fold.rep.append((int(r.face_id), known.get(r.face_id)))
        out = []
        for r in pdf[pdf.kind == 2].itertuples():
            status, i, d = fold.step(int(r.face_id), np.asarray(r.vector, dtype=float))
            some = i is not None
            out.append((r.run_label, int(r.seq), int(r.face_id), status, fold.label[i] if some else None, d, fold.n[i] if some else None, fold.rep[i][0] if some else None, fold.c[i].tolist() if some else None))
        df = pd.DataFrame(out, columns=["run_label", "seq", "face_id", "status", "cluster_label", "distance", "n_members", "representative_face_id", "centroid"])
        return df.astype({"cluster_label": "Int32", "n_members": "Int64", "representative_face_id": "Int64"})

    assert kinds
    return rows.groupBy("run_label").applyInPandas(run, FOLD)


def reclaim_sequential(members: DataFrame, cents: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Noise reclamation with merges taking effect, in ascending face_id."""
    noise = members.where(F.col("cluster_label") == NOISE).select("run_label", F.col("face_id").alias("seq"), "face_id", "vector")
    return sequential(noise, members, cents, t, grow=False)


def apply_batch(batch: DataFrame, members: DataFrame, decision: DataFrame) -> DataFrame:
    """The members with a batch appended under the decided cluster, or under a new one."""
    from vecloom.operators.centroids import next_label

    label = decision.join(next_label(members), F.lit(True)).select(F.coalesce("target", "next_label").cast("int").alias("cluster_label"))  # one row each
    return members.unionByName(batch.join(label, F.lit(True)).select(members.columns))
