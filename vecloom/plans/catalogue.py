"""The catalogue of registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom import schema
from vecloom.functions import geometry, slots, text, vec
from vecloom.functions.vec import rounded
from vecloom.operators import calibrate as cal
from vecloom.operators import centroids as cen
from vecloom.operators import dbscan as dbs
from vecloom.operators import embed as emb
from vecloom.operators import decide as dec
from vecloom.operators import hierarchy as hier
from vecloom.operators import incremental as inc
from vecloom.operators import kmeans as km
from vecloom.operators import metrics as met
from vecloom.operators import pairs as prs
from vecloom.operators import passes
from vecloom.operators import report as rep
from vecloom.plans.oracles import ORACLES
from vecloom.sources import scan, sinks, tables
from vecloom.sources.scratch import settled

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _QUERIES}


def _cents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The labelled view and its centroids, the latter settled: several operators read them again."""
    members = schema.labelled(spark, d)
    return members, settled(cen.centroids(members), "centroids")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors of the planted view each zone of the decision takes."""
    members, cents = _cents(spark, d)
    return dec.recommend(schema.planted(spark, d), members, cents, schema.faces(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- scans and joins ---


@query
def emb_join_faces(spark, d):
    e = schema.raw(spark, d).select("face_id", F.size("vector").alias("dim"))
    return e.join(schema.faces(spark, d).withColumnRenamed("id", "face_id"), "face_id").select("face_id", "identity", "image_path", "dim").orderBy("face_id")


@query
def cluster_members(spark, d):
    ids = scan.members_of(schema.cluster_results(spark, d), schema.RUN, 3)
    return ids.join(schema.faces(spark, d).withColumnRenamed("id", "face_id"), "face_id").select("face_id", "identity", "image_path")


@query
def noise_members(spark, d):
    return scan.members_of(schema.cluster_results(spark, d), schema.RUN, schema.NOISE)


@query
def point_lookup(spark, d):
    return scan.face_by_id(schema.faces(spark, d), 42).unionByName(scan.face_by_path(schema.faces(spark, d), "id_3/7.jpg")).select("id", "identity", "image_path")


@query
def centroid_representatives(spark, d):
    _, c = _cents(spark, d)
    f = schema.faces(spark, d).select(F.col("id").alias("representative_face_id"), "image_path", "identity")
    return c.join(f, "representative_face_id").select("run_label", "cluster_label", "n_members", "representative_face_id", "image_path", "identity").orderBy("cluster_label")


# --- vectors ---


@query
def norm_check(spark, d):
    return rep.norm_check(schema.raw(spark, d).withColumn("vector", F.transform("vector", lambda x: x * (1 + F.col("face_id") % 3)))).select(rounded(F.col("mean_norm")).alias("mean_norm"), rounded(F.col("std_norm")).alias("std_norm"))


@query
def l2_normalize(spark, d):
    v = schema.raw(spark, d).withColumn("vector", F.transform("vector", lambda x: x * (1 + F.col("face_id") % 5)))
    n = v.select("face_id", vec.l2_normalize(F.col("vector")).alias("u"), vec.l2_normalize_guarded(F.col("vector"), 1e-6).alias("g"))
    return n.select("face_id", rounded(F.col("u")[0]).alias("first"), rounded(F.col("u")[63]).alias("last"), rounded(F.col("g")[1]).alias("guarded"))


@query
def vector_dim(spark, d):
    return schema.raw(spark, d).groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query
def vector_json_roundtrip(spark, d):
    j = schema.table(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"), "embedding", text.vector_json(F.col("embedding")).alias("j"))
    back = j.select("face_id", "embedding", text.vector_of_json(F.col("j")).alias("v"))
    return back.select("face_id", F.size("v").alias("dim"), (F.col("v") == F.col("embedding")).alias("same"))


@query
def distances_to_first(spark, d):
    """Cosine and euclidean distance of every planted vector to vector 0, and one from the other."""
    p = schema.planted(spark, d)
    q = p.where("face_id = 0").select(F.col("vector").alias("q"))
    x = p.join(F.broadcast(q)).select("face_id", vec.cosine_distance(F.col("vector"), F.col("q")).alias("c"), vec.euclidean(F.col("vector"), F.col("q")).alias("e"))
    return x.where("face_id > 0").select("face_id", rounded(F.col("c")).alias("cosine"), rounded(F.col("e")).alias("euclidean"), rounded(vec.euclidean_of_cosine(F.col("c"))).alias("derived"))


@query
def pairwise_cosine_top20(spark, d):
    return prs.closest_pairs(schema.raw(spark, d), 20).select("a", "b", rounded(F.col("d")).alias("d"))


@query
def pairs_within_eps(spark, d):
    return prs.pairs_within(schema.planted(spark, d), 0.6).select("a", "b", rounded(F.col("d")).alias("d"))


@query
def knn5(spark, d):
    return prs.neighbours(schema.planted(spark, d), 5, euclidean=False).select("face_id", "rank", "neighbour", rounded(F.col("d")).alias("d"))


@query
def separability_gap(spark, d):
    s = cal.separability(schema.planted(spark, d))
    return s.select(*[rounded(F.col(c)).alias(c) for c in ("same_avg", "cross_avg", "gap")], "same_ok", "cross_ok", "gap_ok")


# --- centroids and decisions ---


@query
def centroids(spark, d):
    _, c = _cents(spark, d)
    return c.select("cluster_label", "n_members", F.posexplode("centroid").alias("pos", "value")).select("cluster_label", "n_members", "pos", rounded(F.col("value")).alias("value"))


@query
def representatives(spark, d):
    _, c = _cents(spark, d)
    return c.select("cluster_label", "representative_face_id")


@query
def cluster_spread(spark, d):
    m, c = _cents(spark, d)
    return cen.spreads(m, c).select("cluster_label", rounded(F.col("spread")).alias("spread"))


@query
def next_label(spark, d):
    return cen.next_label(schema.cluster_results(spark, d))


@query
def nearest_centroid(spark, d):
    m, c = _cents(spark, d)
    return cen.nearest_centroid(m, c).select("face_id", "cluster_label", rounded(F.col("distance")).alias("distance"))


def _decision(df: DataFrame, *more: str) -> DataFrame:
    return df.select("face_id", "status", "nearest_cluster_label", rounded(F.col("distance")).alias("distance"), "representative_face_id", "representative_image_path", "representative_identity", "auto_merge_demoted", *more)


@query
def flow1_decision(spark, d):
    m, c = _cents(spark, d)
    return _decision(dec.recommend(m.select("face_id", "vector"), m, c, schema.faces(spark, d)))


@query
def flow1_status_counts(spark, d):
    return flagship(spark, d)


@query
def centroid_rank_zones(spark, d):
    m, c = _cents(spark, d)
    return dec.rank_zones(m.select("face_id", "vector"), c).select("face_id", "rank", "cluster_label", rounded(F.col("distance")).alias("distance"), "zone")


@query
def noise_reclaim_frozen(spark, d):
    m, c = _cents(spark, d)
    return _decision(dec.reclaim_frozen(m, c, schema.faces(spark, d)), "bucket")


@query
def batch_tier_decision(spark, d):
    m = schema.labelled(spark, d)
    return dec.batch_tier(m.where("label = 4"), m).select("action", "target", rounded(F.col("dist")).alias("dist"))


@query
def flow2_pairs(spark, d):
    m, c = _cents(spark, d)
    s = dec.suspicious_pairs(m, c, schema.faces(spark, d), cap=None)
    return s.withColumns({x: rounded(F.col(x)) for x in ("distance", "centroid_distance", "min_member_distance")})


@query
def flow2_dismissed(spark, d):
    m, c = _cents(spark, d)
    s = dec.suspicious_pairs(m, c, schema.faces(spark, d), cap=None)
    return dec.dismissed(s, s.where("cluster_a = 0").select("cluster_a", "cluster_b")).select("cluster_a", "cluster_b", "auto_mergeable")


@query
def merge_clusters(spark, d):
    m, c = _cents(spark, d)
    moved, cents = cen.merge_clusters(m, c, 2, 5)
    return cents.join(moved.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n_present")), "cluster_label").select("cluster_label", "n_members", "n_present", "representative_face_id", rounded(F.col("centroid")[0]).alias("first"))


@query
def probe_diagnostic(spark, d):
    m = schema.labelled(spark, d)
    r = rep.probe(0, m, "ID_0")
    return r.select(*[rounded(F.col(c)).alias(c) for c in ("closest", "farthest", "mean")], "n")


# --- calibration ---


@query
def calibration_full(spark, d):
    c = cal.calibrate(schema.planted(spark, d), max_pairs=None)
    return c.withColumns({x: rounded(F.col(x)) for x in ("t1", "t2", "precision_t1", "mean_same", "mean_diff")})


@query
def calibration_overlapping(spark, d):
    c = cal.calibrate(schema.raw(spark, d), max_pairs=None, exclude=("id_9",))
    return c.withColumns({x: rounded(F.col(x)) for x in ("t1", "t2", "precision_t1", "mean_same", "mean_diff")})


@query
def false_merge_curve(spark, d):
    return cal.false_merge_curve(schema.planted(spark, d))


@query
def identity_exclusion(spark, d):
    kept = cal.without_placeholders(schema.raw(spark, d), ("id_3", "id_7"))
    return kept.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


# --- metrics and reports ---


@query
def contingency(spark, d):
    return met.contingency(schema.cluster_results(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    m = met.compute_metrics(schema.cluster_results(spark, d))
    return m.select("n", *[rounded(F.col(c)).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness", "v_measure", "purity", "noise_fraction")], "n_predicted_clusters", "n_true_identities")


@query
def ari(spark, d):
    return _metrics(spark, d).select("ari")


@query
def nmi(spark, d):
    return _metrics(spark, d).select("nmi")


@query
def v_measure(spark, d):
    return _metrics(spark, d).select("homogeneity", "completeness", "v_measure")


@query
def purity(spark, d):
    return _metrics(spark, d).select("purity")


@query
def metrics_bundle(spark, d):
    return _metrics(spark, d)


@query
def silhouette(spark, d):
    return met.silhouette(schema.labelled(spark, d)).select(rounded(F.col("silhouette")).alias("silhouette"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    """The labelling under two model names: all vectors, and the even ones."""
    c = schema.cluster_results(spark, d)
    return c.withColumn("model", F.lit("arcface")).unionByName(c.where("face_id % 2 = 0").withColumn("model", F.lit("facenet")))


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    return rep.model_comparison(_models(spark, d)).select("model", *[rounded(F.col(c)).alias(c) for c in rep.METRICS])


@query
def model_comparison(spark, d):
    return _comparison(spark, d)


@query
def best_per_metric(spark, d):
    return rep.best_per_metric(_comparison(spark, d))


@query
def metrics_melt(spark, d):
    return rep.melted(_comparison(spark, d))


@query
def metrics_pivot(spark, d):
    return rep.pivoted(rep.melted(_comparison(spark, d)))


@query
def per_identity_breakdown(spark, d):
    p = rep.per_identity(schema.cluster_results(spark, d))
    return p.withColumn("assigned", F.array_join(F.transform("assigned", lambda x: x.cast("string")), ","))


@query
def split_identities(spark, d):
    return rep.split_identities(schema.cluster_results(spark, d))


@query
def pure_mixed(spark, d):
    return rep.purity_of_clusters(schema.cluster_results(spark, d)).withColumn("identities", F.array_join("identities", ","))


@query
def cluster_sizes(spark, d):
    return rep.cluster_sizes(schema.cluster_results(spark, d))


@query
def distinct_labels(spark, d):
    return rep.noise_last(schema.cluster_results(spark, d).select("cluster_label").distinct())


@query
def live_browser(spark, d):
    m, c = _cents(spark, d)
    return rep.browser(m, c, schema.faces(spark, d))


@query
def label_encode(spark, d):
    return rep.label_encode(schema.faces(spark, d).select("id", "identity"), "identity").select("id", "identity", "code")


@query
def case_insensitive_match(spark, d):
    f = schema.faces(spark, d)
    return f.where(F.lower("identity") == F.lower(F.lit("ID_4"))).select("id", "identity")


@query
def collated_positions(spark, d):
    f = schema.faces(spark, d).withColumn("identity", F.when(F.col("id") % 2 == 0, F.upper("identity")).otherwise(F.col("identity")))
    return rep.collated(f).select("id", "position")


# --- detections ---


@query
def best_face_per_image(spark, d):
    return rep.best_detection(schema.detections(spark, d)).select("face_id", "face_index", "det_score")


@query
def face_index(spark, d):
    return rep.face_index(schema.detections(spark, d)).select("face_id", "face_index", "new_index")


@query
def quality_filter(spark, d):
    return rep.quality_filter(schema.detections(spark, d)).select("face_id", "face_index", "det_score", "w", "h", "blur_var")


@query
def confidence_filter(spark, d):
    return schema.detections(spark, d).groupBy((F.col("det_score") >= 0.75).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query
def reject_reasons(spark, d):
    det = schema.detections(spark, d)
    return rep.reject_reasons(schema.raw(spark, d), det.where("face_id % 11 <> 0"))


@query
def ingest_counters(spark, d):
    det = schema.detections(spark, d)
    return rep.ingest_counters(schema.raw(spark, d), det.where("face_id % 11 <> 0"))


def _registries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    det = schema.detections(spark, d)
    a = det.groupBy(F.col("image_path").alias("filename")).agg(F.count(F.lit(1)).alias("count")).withColumn("latency", F.lit(None).cast("double"))
    b = schema.faces(spark, d).where("id % 5 <> 0 AND id % 4 > 0").select(F.col("image_path").alias("filename"), (F.col("id") % 4).alias("count"), (F.col("id") % 10 / F.lit(1000.0) + 0.001).alias("latency"))
    return a, b


@query
def detector_variance(spark, d):
    v = rep.detector_variance(*_registries(spark, d))
    return v.withColumns({c: rounded(F.col(c)) for c in ("latency_a", "latency_b", "per_second_a", "per_second_b")})


@query
def mismatch_top10(spark, d):
    return rep.mismatches(*_registries(spark, d))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    det = schema.detections(spark, d)
    return det.select(F.col("image_path").alias("filename"), F.col("face_index").alias("box_index"), text.detector_crop_name(F.col("image_path"), F.col("face_index")).alias("crop_filename"), (F.col("face_id") % 50).cast("int").alias("x"), (F.col("face_id") % 40).cast("int").alias("y"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"))


@query
def registry_explode(spark, d):
    """A registry written as JSON and read back as boxes."""
    reg = sinks.registry(_boxes(spark, d)).select(F.map_from_entries(F.array(F.struct("filename", F.from_json("entry", schema.REGISTRY.removeprefix("MAP<STRING, ").removesuffix(">"))))).alias("m"))
    return scan.explode_registry(reg, "m")


# --- geometry and names ---


@query
def margin_boxes(spark, d):
    e = schema.table(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"))
    v = F.col("face_id")
    box = F.array((v % 90).cast("double"), (v % 70).cast("double"), (v % 90 + 15 + v % 40).cast("double"), (v % 70 + 12 + v % 55).cast("double"))
    w, h = F.lit(120.0), F.lit(100.0)
    s, p, c = geometry.square_margin_box(box, w, h, 0.3), geometry.proportional_margin_box(box, w, h, 0.1), geometry.clip_box(box, w, h)
    return e.select("face_id", *[s[i].alias(f"square_{i}") for i in range(4)], *[p[i].alias(f"prop_{i}") for i in range(4)], *[c[i].alias(f"clip_{i}") for i in range(4)])


@query
def eye_alignment_matrix(spark, d):
    e = schema.table(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"))
    v = F.col("face_id")
    left, right = F.array((30 + v % 7).cast("double"), (40 + v % 11).cast("double")), F.array((60 + v % 13).cast("double"), (42 + v % 5).cast("double"))
    m = e.select("face_id", geometry.eye_alignment(left, right).alias("m"), geometry.usable_eyes(left, right, 30.0).alias("usable"))
    return m.select("face_id", "usable", rounded(F.col("m.angle")).alias("angle"), rounded(F.col("m.scale")).alias("scale"), *[rounded(F.col("m.matrix")[i]).alias(f"m{i}") for i in range(6)])


@query
def landmark_similarity(spark, d):
    """The matrix that puts five landmarks onto the template of a crop."""
    v = F.col("face_id")
    e = schema.table(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"))
    points = F.array(*[F.array((20 + 30 * (k % 2) + v % (5 + k)).cast("double"), (30 + 18 * (k // 2) + v % (3 + 2 * k)).cast("double")) for k in range(5)])
    m = e.select("face_id", geometry.similarity(points).alias("m"))
    return m.select("face_id", *[rounded(F.col("m")[i]).alias(f"m{i}") for i in range(6)])


@query
def model_inputs(spark, d):
    """Crops that each model needs of each alignment, for the detections at hand."""
    specs = slots.input_specs(spark)
    models = F.array(*[F.lit(m) for m, *_ in slots.INPUT_SPECS])
    det = schema.detections(spark, d).withColumn("model", F.get(models, (F.col("face_id") % 4).cast("int")))
    return det.join(specs, "model").groupBy("model", "alignment", "size").agg(F.count(F.lit(1)).alias("n"))


@query
def filename_identity(spark, d):
    f = schema.faces(spark, d)
    name = F.when(F.col("id") % 3 == 0, F.concat("identity", F.lit("_"), "id", F.lit("_x.jpg"))).otherwise(F.concat(F.lit("plain"), "id", F.lit(".jpg")))
    return f.select("id", text.identity_of_name(name).alias("by_name"), text.identity_of_export(F.concat("identity", F.lit("__"), name)).alias("by_export"), text.identity_of_folder(F.when(F.col("id") % 5 == 0, F.concat(F.lit("/data/RAW/"), name)).otherwise(F.concat(F.lit("/data/"), "image_path"))).alias("by_folder"))


@query
def crop_names(spark, d):
    f = schema.faces(spark, d)
    return f.select("id", text.crop_name(F.col("identity"), F.col("image_path"), F.col("id") % 3).alias("crop"), text.detector_crop_name(F.col("image_path"), F.col("id") % 3).alias("detector_crop"), text.stem(F.col("image_path")).alias("stem"), text.suffix(F.col("image_path")).alias("suffix"))


@query
def folder_manifest(spark, d):
    m = schema.cluster_results(spark, d).join(schema.faces(spark, d).select(F.col("id").alias("face_id"), "image_path"), "face_id")
    return sinks.manifest(m, schema.RUN).select("cluster_folder", "src", "dst")


@query
def missing_sources(spark, d):
    f = schema.faces(spark, d)
    return sinks.missing(f.select(F.col("image_path").alias("src")), f.where("id % 4 <> 1").select(F.col("image_path").alias("path")), top=20)


# --- keyed tables ---


@query
def upsert_faces(spark, d):
    """Every face arrives twice more under another identity, and twice under a path of its own; later values count."""
    f = schema.faces(spark, d)
    again = f.select("image_path", F.lit("someone").alias("identity"), F.lit(0.25).alias("det_score"), F.lit(1).alias("seq"))
    fresh = f.select(F.concat(F.lit("new/"), "image_path").alias("image_path"), "identity", F.lit(0.75).alias("det_score"), F.lit(1).alias("seq"))
    rows = again.unionByName(fresh)
    later = rows.withColumns({"identity": F.lit("another"), "det_score": F.when(F.col("image_path").startswith("new/"), F.col("det_score") + 0.125).otherwise(F.lit(0.5)), "seq": F.lit(2)})
    return tables.upsert_faces(f, rows.unionByName(later), order="seq").select("id", "identity", "image_path", "det_score")


@query
def upsert_labels(spark, d):
    """Every label arrives twice; the later one counts.  Labels of another run stay."""
    c = schema.cluster_results(spark, d).select("run_label", "face_id", "cluster_label")
    table = c.unionByName(c.withColumn("run_label", F.lit("other")))
    new = c.withColumns({"cluster_label": F.col("cluster_label") + 70, "seq": F.lit(1)}).unionByName(c.withColumns({"cluster_label": F.col("cluster_label") + 80, "seq": F.lit(2)}))
    return tables.upsert_labels(table, new, order="seq")


@query
def upsert_embeddings(spark, d):
    """Every vector arrives twice; the later one counts."""
    e = schema.raw(spark, d).select("face_id", F.size("vector").alias("dim"), "vector")
    rows = e.select("face_id", F.slice("vector", 1, 16).alias("vector"), F.lit(1).alias("seq")).unionByName(e.select("face_id", F.slice("vector", 2, 8).alias("vector"), F.lit(2).alias("seq")))
    return tables.upsert_embeddings(e, rows, order="seq").select("face_id", "dim", rounded(F.col("vector")[0]).alias("first"))


@query
def relabel(spark, d):
    c = schema.cluster_results(spark, d).select("run_label", "face_id", "cluster_label")
    return tables.relabel(c, schema.RUN, 5, 2).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"))


@query
def update_labels(spark, d):
    c = schema.cluster_results(spark, d).select("run_label", "face_id", "cluster_label")
    return tables.update_labels(c, c.select("face_id", (F.col("cluster_label") + 100).alias("cluster_label")).unionByName(c.select((-F.col("face_id") - 1).alias("face_id"), "cluster_label"))).select("face_id", "cluster_label")


@query
def delete_centroids(spark, d):
    _, c = _cents(spark, d)
    return tables.delete_centroids(c, schema.RUN, 3).select("cluster_label", "n_members")


@query
def start_cluster(spark, d):
    m, c = _cents(spark, d)
    return inc.start_cluster(c, m.select("run_label", "cluster_label"), m.where("face_id = 19").select("face_id", "vector")).select("cluster_label", "n_members", "representative_face_id")


@query
def assign_face(spark, d):
    m, c = _cents(spark, d)
    out = inc.assign(c, m.where("face_id = 19").select("face_id", "vector"), m, 2)
    return out.where("cluster_label = 2").select("cluster_label", "n_members", F.posexplode("centroid").alias("pos", "value")).select("cluster_label", "n_members", "pos", rounded(F.col("value")).alias("value"))


@query
def batch_apply(spark, d):
    """All vectors of one identity arrive once more, under ids of their own."""
    known = schema.labelled(spark, d)
    m = known.select("run_label", "face_id", "cluster_label", "vector")
    batch = known.where("label = 4").select("run_label", (-1 - F.col("face_id")).alias("face_id"), "vector")
    decision = dec.batch_tier(batch, m)
    return inc.apply_batch(batch, m, decision).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"))


# --- clustering ---


@query
def dbscan(spark, d):
    return dbs.dbscan(schema.planted(spark, d), 0.6, 4)


@query
def dbscan_sweep(spark, d):
    p = schema.planted(spark, d)
    s = km.best_of(dbs.sweep(p), p, ("eps", "min_samples"))
    return s.select("eps", "min_samples", "n_predicted_clusters", rounded(F.col("noise_fraction")).alias("noise_fraction"), rounded(F.col("ari")).alias("ari"), rounded(F.col("nmi")).alias("nmi"), rounded(F.col("purity")).alias("purity"), "best")


@query
def kmeans_best_of_seeds(spark, d):
    return km.kmeans(schema.planted(spark, d), 10)[0]


@query
def kmeans_sweep(spark, d):
    p = schema.planted(spark, d)
    return km.best_of(km.sweep(p), p, ("k",))


@query
def hdbscan(spark, d):
    return hier.hdbscan(schema.planted(spark, d), 5, 3)


@query
def hdbscan_sweep(spark, d):
    p = schema.planted(spark, d)
    return km.best_of(hier.hdbscan_sweep(p), p, ("min_cluster_size", "min_samples"))


@query
def hdbscan_reduced(spark, d):
    return hier.reduced_hdbscan(schema.planted(spark, d))


@query
def hdbscan_embedded(spark, d):
    """HDBSCAN after a neighbour embedding in 30 dimensions."""
    return emb.embedded_hdbscan(schema.planted(spark, d))


@query
def neighbour_projection(spark, d):
    """Two dimensions for a plot: a neighbour embedding of 40 neighbours."""
    return emb.embed(schema.planted(spark, d), 2, 40).select("face_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query
def agglomerative_avg(spark, d):
    return hier.agglomerative(schema.planted(spark, d), 8)


@query
def agglomerative_ward(spark, d):
    return hier.agglomerative(schema.planted(spark, d), 10, "ward")


@query
def pca_projection(spark, d):
    return hier.pca(schema.planted(spark, d), 2).select("face_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


def _with_paths(spark: SparkSession, d: str) -> DataFrame:
    f = schema.faces(spark, d).select(F.col("id").alias("face_id"), "image_path")
    return schema.planted(spark, d).select("face_id", "identity", "vector").join(f, "face_id")


@query
def cluster_pass(spark, d):
    """Cluster, rebuild centroids: the representatives that a whole pass over a run leaves."""
    p = passes.cluster(_with_paths(spark, d), lambda v: dbs.dbscan(v, 0.6, 4))
    return p.centroids.select("cluster_label", "n_members", "representative_face_id")


@query
def cluster_all_models(spark, d):
    """The scores of a pass for each of two models."""
    v = _with_paths(spark, d)
    models = v.withColumn("model", F.lit("arcface")).unionByName(v.where("face_id % 2 = 0").withColumn("model", F.lit("facenet")))

    def clusterer(x: DataFrame) -> DataFrame:
        return dbs.dbscan(x, 0.6, 4)

    done, _ = passes.cluster_models(models, clusterer)
    out = passes.summary(done)
    return out.select("model", "n", "n_predicted_clusters", *[rounded(F.col(c)).alias(c) for c in ("ari", "nmi", "purity", "noise_fraction")])


@query
def first_images(spark, d):
    return passes.first_images(schema.faces(spark, d), 25).select("id", "identity", "image_path")


@query
def vectors_by_cluster(spark, d):
    lists = passes.vectors_by_cluster(schema.labelled(spark, d))
    return lists.groupBy("cluster_label").agg(F.sum(F.size("vectors")).cast("int").alias("n"))


@query
def reclaim_sequential(spark, d):
    m, c = _cents(spark, d)
    return inc.reclaim_sequential(m, c).select("face_id", "status", "cluster_label", rounded(F.col("distance")).alias("distance"), "n_members", "representative_face_id")


@query
def stream_flow1(spark, d):
    """Noise vectors replayed as a stream of eight files; the decisions it leaves."""
    from vecloom.sources.scratch import shared_dir
    from vecloom.sources.tables import Store
    from vecloom.streaming import arrivals as arr
    import uuid

    m, c = _cents(spark, d)
    base = f"{shared_dir(spark)}/vecloom-stream-{uuid.uuid4().hex}"
    queue = m.where("cluster_label = -1").select("run_label", F.row_number().over(Window.partitionBy("run_label").orderBy(F.col("face_id") % 8, "face_id")).cast("long").alias("seq"), "face_id", "vector")
    queue = settled(queue, "queue")
    for i in range(8):
        queue.where(F.col("face_id") % 8 == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    store = Store(spark, f"{base}/store")
    arr.prepare(store, m, c)
    q = arr.start(arr.arrivals(spark, f"{base}/in"), store, f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return store.read("decisions").select("face_id", "status", "cluster_label", rounded(F.col("distance")).alias("distance"))
