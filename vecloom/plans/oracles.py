"""SQL with the results of the catalogue's queries, for the same tables."""

P = """p0 AS (SELECT vec_id AS face_id, 'id_' || label AS identity, label, CAST(embedding AS DOUBLE[]) AS e,
  0.3::DOUBLE + 0.1::DOUBLE * (vec_id % 8) AS alpha FROM embeddings),
p1 AS (SELECT face_id, identity, label, list_transform(e, lambda x, i: alpha * x + CASE WHEN i - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w FROM p0),
p AS (SELECT face_id, identity, label, list_transform(w, lambda x: x / n) AS vector
  FROM (SELECT *, greatest(sqrt(list_inner_product(w, w)), 1e-10) AS n FROM p1))"""
L = P + """,
l AS (SELECT *, 'default' AS run_label, CAST(CASE WHEN face_id % 10 = 9 THEN -1 ELSE (label + face_id % 2) % 8 END AS INTEGER) AS cluster_label FROM p)"""


def _cents(source: str, out: str) -> str:
    return f""",
{out}_m AS (SELECT cluster_label, pos, avg(v) AS a, count(*) AS n FROM (SELECT cluster_label, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM {source} WHERE cluster_label <> -1) GROUP BY ALL),
{out}_w AS (SELECT cluster_label, list(a ORDER BY pos) AS w, max(n) AS n_members FROM {out}_m GROUP BY cluster_label),
{out}_c AS (SELECT cluster_label, n_members, list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-10)) AS centroid FROM {out}_w),
{out}_d AS (SELECT s.cluster_label, face_id, 1 - list_inner_product(centroid, vector) AS d FROM {source} s JOIN {out}_c USING (cluster_label)),
{out} AS (SELECT c.*, r.face_id AS representative_face_id, r.spread FROM {out}_c c JOIN
  (SELECT cluster_label, first(face_id ORDER BY d, face_id) AS face_id, max(d) AS spread FROM {out}_d GROUP BY cluster_label) r USING (cluster_label))"""


C = L + _cents("l", "c")
R = """r AS (SELECT vec_id AS face_id, 'id_' || label AS identity, label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""
FACES = """f AS (SELECT vec_id AS id, 'id_' || label AS identity, 'id_' || label || '/' || vec_id || '.jpg' AS image_path, (vec_id * 37 % 100) / 100.0::DOUBLE AS det_score FROM embeddings)"""
CR = """cr AS (SELECT 'default' AS run_label, vec_id AS face_id, 'id_' || label AS identity, CAST(CASE WHEN vec_id % 10 = 9 THEN -1 ELSE (label + vec_id % 2) % 8 END AS INTEGER) AS cluster_label FROM embeddings)"""
DET = """det AS (SELECT vec_id AS face_id, 'id_' || label AS identity, CAST(i AS INTEGER) AS face_index, 'id_' || label || '/' || vec_id || '.jpg' AS image_path,
  ((vec_id * 37 + i * 11) % 100) / 100.0::DOUBLE AS det_score, CAST(10 + (vec_id * 7 + i) % 60 AS DOUBLE) AS w, CAST(10 + (vec_id * 5) % 60 AS DOUBLE) AS h,
  CAST(CASE WHEN vec_id % 17 <> 0 THEN (vec_id * 13) % 90 END AS DOUBLE) AS blur_var
  FROM embeddings, LATERAL unnest(range(0, vec_id % 4 + 1)) AS u(i))"""
NEAR = """,
near AS (SELECT l.face_id, c.cluster_label, c.spread, c.representative_face_id, 1 - list_inner_product(l.vector, c.centroid) AS d,
  row_number() OVER (PARTITION BY l.face_id ORDER BY round(1 - list_inner_product(l.vector, c.centroid), 12), c.cluster_label) AS rank FROM l, c)"""
DECIDE = """SELECT n.face_id, CASE WHEN d < 0.30 AND d > spread * 1.15 THEN 'ask_user' WHEN d < 0.30 THEN 'auto_merge' WHEN d < 0.45 THEN 'ask_user' ELSE 'new_cluster' END AS status,
  n.cluster_label AS nearest_cluster_label, round(d, 6) + 0.0 AS distance, representative_face_id, f.image_path AS representative_image_path, f.identity AS representative_identity,
  (d < 0.30 AND d > spread * 1.15) AS auto_merge_demoted"""
PAIRS = """,
pr AS (SELECT a.face_id AS a, b.face_id AS b, 1 - list_inner_product(a.vector, b.vector) AS d, CAST(a.identity <> b.identity AS INTEGER) AS is_diff FROM {0} a JOIN {0} b ON a.face_id < b.face_id)"""
SCORES = """,
cells AS (SELECT model, identity AS truth, cluster_label AS pred, count(*) AS n FROM src GROUP BY ALL),
rws AS (SELECT model, truth, sum(n) AS n FROM cells GROUP BY ALL),
cls AS (SELECT model, pred, sum(n) AS n, max(n) AS top FROM cells GROUP BY ALL),
w AS (SELECT model, sum(n) AS n, sum(n * (n - 1) / 2.0::DOUBLE) AS cc, sum(n * ln(n)) AS xc FROM cells GROUP BY model),
wr AS (SELECT model, sum(n * (n - 1) / 2.0::DOUBLE) AS cr, sum(n * ln(n)) AS xr, count(*) AS nt FROM rws GROUP BY model),
wc AS (SELECT model, sum(n * (n - 1) / 2.0::DOUBLE) AS cp, sum(n * ln(n)) AS xp, sum(CASE WHEN pred <> -1 THEN top ELSE 0 END) AS maj, count(*) FILTER (pred <> -1) AS np, sum(CASE WHEN pred = -1 THEN n ELSE 0 END) AS noise FROM cls GROUP BY model),
s0 AS (SELECT model, n, cc, cr * cp / (n * (n - 1) / 2.0::DOUBLE) AS ex, (cr + cp) / 2 AS mid, ln(n) + (xc - xr - xp) / n AS mi, ln(n) - xr / n AS ht, ln(n) - xp / n AS hp, maj, np, nt, noise FROM w JOIN wr USING (model) JOIN wc USING (model)),
s AS (SELECT model, CAST(n AS BIGINT) AS n, round((cc - ex) / (mid - ex), 6) + 0.0 AS ari, round(mi / ((ht + hp) / 2), 6) + 0.0 AS nmi, round(mi / ht, 6) + 0.0 AS homogeneity, round(mi / hp, 6) + 0.0 AS completeness,
  round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6) + 0.0 AS v_measure, round(maj / CAST(n AS DOUBLE), 6) + 0.0 AS purity, np AS n_predicted_clusters, nt AS n_true_identities, round(noise / CAST(n AS DOUBLE), 6) + 0.0 AS noise_fraction FROM s0)"""
ONE = "WITH " + CR + ", src AS (SELECT 'one' AS model, * FROM cr)" + SCORES
TWO = "WITH " + CR + ", src AS (SELECT 'arcface' AS model, * FROM cr UNION ALL SELECT 'facenet', * FROM cr WHERE face_id % 2 = 0)" + SCORES
MELT = "(SELECT model, 'ari' AS metric, ari AS value FROM s UNION ALL SELECT model, 'nmi', nmi FROM s UNION ALL SELECT model, 'purity', purity FROM s UNION ALL SELECT model, 'v_measure', v_measure FROM s)"
FLOW2 = f"""WITH RECURSIVE {C}, {FACES},
g AS (SELECT a.cluster_label AS ca, b.cluster_label AS cb, min(1 - list_inner_product(a.vector, b.vector)) AS md FROM l a JOIN l b ON a.cluster_label < b.cluster_label AND a.cluster_label <> -1 GROUP BY ALL),
x AS (SELECT a.cluster_label AS cluster_a, b.cluster_label AS cluster_b, least(1 - list_inner_product(a.centroid, b.centroid), md) AS distance, 1 - list_inner_product(a.centroid, b.centroid) AS centroid_distance, md AS min_member_distance,
  fa.image_path AS rep_a_image_path, fb.image_path AS rep_b_image_path, fa.identity AS rep_a_identity, fb.identity AS rep_b_identity
  FROM c a JOIN c b ON a.cluster_label < b.cluster_label JOIN g ON g.ca = a.cluster_label AND g.cb = b.cluster_label JOIN f fa ON fa.id = a.representative_face_id JOIN f fb ON fb.id = b.representative_face_id)"""
CALIBRATE = """,
st AS (SELECT quantile_cont(d, 0.95) FILTER (is_diff = 0) AS t1, quantile_cont(d, 0.05) FILTER (is_diff = 1) AS t2, avg(d) FILTER (is_diff = 0) AS mean_same, avg(d) FILTER (is_diff = 1) AS mean_diff, count(*) FILTER (is_diff = 0) AS n_same, count(*) FILTER (is_diff = 1) AS n_diff FROM pr),
cv AS (SELECT d, sum(is_diff) OVER (ORDER BY d, is_diff ROWS UNBOUNDED PRECEDING) AS f, row_number() OVER (ORDER BY d, is_diff) AS t FROM pr),
sf AS (SELECT coalesce(max(d) FILTER (f <= 0.01 * t), 0.0) AS p FROM cv)
SELECT round(t1, 6) + 0.0 AS t1, round(t2, 6) + 0.0 AS t2, round(p, 6) + 0.0 AS precision_t1, round(mean_same, 6) + 0.0 AS mean_same, round(mean_diff, 6) + 0.0 AS mean_diff, n_same, n_diff, CAST({0} AS BIGINT) AS n_excluded, 0.01::DOUBLE AS target_rate, p = 0 AS no_safe_auto_merge_zone, t1 <= t2 AS clean_separation FROM st, sf"""


def _dbscan(eps: float, least: int) -> str:
    """Labels of DBSCAN over p as table lab(face_id, cluster_label)."""
    return f""",
nb AS (SELECT a.face_id AS a, b.face_id AS b FROM p a JOIN p b ON sqrt(2 * greatest(1 - list_inner_product(a.vector, b.vector), 0)) <= {eps} OR a.face_id = b.face_id),
core AS (SELECT a AS core FROM nb GROUP BY a HAVING count(*) >= {least}),
ed AS (SELECT a, b FROM nb WHERE a IN (SELECT core FROM core) AND b IN (SELECT core FROM core)),
reach(a, b) AS (SELECT a, b FROM ed UNION SELECT r.a, ed.b FROM reach r JOIN ed ON ed.a = r.b),
cmp AS (SELECT a AS core, min(b) AS comp FROM reach GROUP BY a),
rk AS (SELECT comp, dense_rank() OVER (ORDER BY comp) - 1 AS k FROM (SELECT DISTINCT comp FROM cmp)),
own AS (SELECT core AS face_id, comp FROM cmp UNION ALL SELECT nb.a, min(comp) FROM nb JOIN cmp ON cmp.core = nb.b WHERE nb.a NOT IN (SELECT core FROM core) GROUP BY nb.a),
lab AS (SELECT p.face_id, p.identity, CAST(coalesce(k, -1) AS INTEGER) AS cluster_label FROM p LEFT JOIN own USING (face_id) LEFT JOIN rk USING (comp))"""


def _sweep(configs: tuple[tuple[float, int], ...]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT * FROM (WITH RECURSIVE {P}{_dbscan(e, m)}, src AS (SELECT 'x' AS model, identity, cluster_label FROM lab){SCORES} SELECT {i} AS ord, {e}::DOUBLE AS eps, {m} AS min_samples, n_predicted_clusters, noise_fraction, ari, nmi, purity FROM s)"
        for i, (e, m) in enumerate(configs)
    )
    return f"WITH x AS ({rows}) SELECT * EXCLUDE (ord), ord = (SELECT ord FROM x ORDER BY ari DESC, ord LIMIT 1) AS best FROM x"


def _similarity() -> str:
    """Least squares by sums over the five points."""
    template = "(0, 38.2946, 51.6963), (1, 73.5318, 51.5014), (2, 56.0252, 71.7366), (3, 41.5493, 92.3655), (4, 70.7299, 92.2041)"
    return f"""WITH t(k, u, w) AS (SELECT k, u::DOUBLE, w::DOUBLE FROM (VALUES {template}) x(k, u, w)),
q AS (SELECT vec_id AS face_id, CAST(20 + 30 * (k % 2) + vec_id % (5 + k) AS DOUBLE) AS x, CAST(30 + 18 * (k // 2) + vec_id % (3 + 2 * k) AS DOUBLE) AS y, u, w FROM embeddings, t),
c AS (SELECT face_id, avg(x) AS cx, avg(y) AS cy, avg(u) AS cu, avg(w) AS cw FROM q GROUP BY face_id),
s AS (SELECT face_id, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cu) AS cu, any_value(cw) AS cw, sum((x - cx) * (u - cu) + (y - cy) * (w - cw)) / sum((x - cx) ** 2 + (y - cy) ** 2) AS a, sum((x - cx) * (w - cw) - (y - cy) * (u - cu)) / sum((x - cx) ** 2 + (y - cy) ** 2) AS b FROM q JOIN c USING (face_id) GROUP BY face_id)
SELECT face_id, round(a, 6) + 0.0 AS m0, round(-b, 6) + 0.0 AS m1, round(cu - a * cx + b * cy, 6) + 0.0 AS m2, round(b, 6) + 0.0 AS m3, round(a, 6) + 0.0 AS m4, round(cw - b * cx - a * cy, 6) + 0.0 AS m5 FROM s"""


def _all_models() -> str:
    """Scores of DBSCAN over all vectors and over the even ones."""
    even = P.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 2 = 0)")
    one = lambda model, source: f"SELECT * FROM (WITH RECURSIVE {source}{_dbscan(0.6, 4)}, src AS (SELECT '{model}' AS model, identity, cluster_label FROM lab){SCORES} SELECT model, n, n_predicted_clusters, ari, nmi, purity, noise_fraction FROM s)"
    return f"{one('arcface', P)} UNION ALL {one('facenet', even)}"


ORACLES: dict[str, str] = {
    "emb_join_faces": f"WITH {R}, {FACES} SELECT face_id, f.identity, image_path, CAST(len(vector) AS INTEGER) AS dim FROM r JOIN f ON f.id = r.face_id",
    "cluster_members": f"WITH {CR}, {FACES} SELECT face_id, f.identity, image_path FROM cr JOIN f ON f.id = cr.face_id WHERE run_label = 'default' AND cluster_label = 3",
    "noise_members": f"WITH {CR} SELECT face_id FROM cr WHERE cluster_label = -1",
    "point_lookup": f"WITH {FACES} SELECT id, identity, image_path FROM f WHERE id = 42 UNION ALL SELECT id, identity, image_path FROM f WHERE image_path = 'id_3/7.jpg'",
    "centroid_representatives": f"WITH {C}, {FACES} SELECT 'default' AS run_label, cluster_label, n_members, representative_face_id, image_path, identity FROM c JOIN f ON f.id = representative_face_id",
    "norm_check": f"WITH {R}, n AS (SELECT sqrt(list_inner_product(vector, vector)) * (1 + face_id % 3) AS n FROM r) SELECT round(avg(n), 6) + 0.0 AS mean_norm, round(stddev_pop(n), 6) + 0.0 AS std_norm FROM n",
    "l2_normalize": f"WITH {R}, n AS (SELECT face_id, vector, sqrt(list_inner_product(vector, vector)) AS n FROM r) SELECT face_id, round(vector[1] / n, 6) + 0.0 AS first, round(vector[64] / n, 6) + 0.0 AS last, round(vector[2] / n, 6) + 0.0 AS guarded FROM n",
    "vector_dim": "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "vector_json_roundtrip": "SELECT vec_id AS face_id, CAST(len(embedding) AS INTEGER) AS dim, true AS same FROM embeddings",
    "distances_to_first": f"WITH {P}, q AS (SELECT vector AS q FROM p WHERE face_id = 0), x AS (SELECT face_id, 1 - list_inner_product(vector, q) AS c, list_distance(vector, q) AS e FROM p, q WHERE face_id > 0) SELECT face_id, round(c, 6) + 0.0 AS cosine, round(e, 6) + 0.0 AS euclidean, round(sqrt(2 * greatest(c, 0)), 6) + 0.0 AS derived FROM x",
    "pairwise_cosine_top20": f"WITH {R}{PAIRS.format('r')} SELECT a, b, round(d, 6) + 0.0 AS d FROM pr ORDER BY pr.d, a, b LIMIT 20",
    "pairs_within_eps": f"WITH {P}{PAIRS.format('p')} SELECT a, b, round(sqrt(2 * greatest(d, 0)), 6) + 0.0 AS d FROM pr WHERE sqrt(2 * greatest(pr.d, 0)) <= 0.6",
    "knn5": f"WITH {P}, x AS (SELECT a.face_id, b.face_id AS neighbour, 1 - list_inner_product(a.vector, b.vector) AS d FROM p a JOIN p b ON a.face_id <> b.face_id), y AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY d, neighbour) AS rank FROM x) SELECT face_id, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) + 0.0 AS d FROM y WHERE rank <= 5",
    "separability_gap": f"WITH {P}{PAIRS.format('p')}, g AS (SELECT avg(1 - d) FILTER (is_diff = 0) AS s, avg(1 - d) FILTER (is_diff = 1) AS c FROM pr) SELECT round(s, 6) + 0.0 AS same_avg, round(c, 6) + 0.0 AS cross_avg, round(s - c, 6) + 0.0 AS gap, s >= 0.10 AS same_ok, c <= 0.20 AS cross_ok, s - c >= 0.10 AS gap_ok FROM g",
    "centroids": f"WITH {C} SELECT cluster_label, n_members, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS pos, round(unnest(centroid), 6) + 0.0 AS value FROM c",
    "representatives": f"WITH {C} SELECT cluster_label, representative_face_id FROM c",
    "cluster_spread": f"WITH {C} SELECT cluster_label, round(spread, 6) + 0.0 AS spread FROM c",
    "next_label": f"WITH {CR} SELECT coalesce(max(cluster_label) FILTER (cluster_label <> -1) + 1, 0) AS next_label FROM cr",
    "nearest_centroid": f"WITH {C}{NEAR} SELECT face_id, cluster_label, round(d, 6) + 0.0 AS distance FROM near WHERE rank = 1",
    "flow1_decision": f"WITH {C}{NEAR}, {FACES} {DECIDE} FROM near n JOIN f ON f.id = representative_face_id WHERE rank = 1",
    "flow1_status_counts": f"WITH {C}{NEAR}, {FACES}, x AS ({DECIDE} FROM near n JOIN f ON f.id = representative_face_id WHERE rank = 1) SELECT status, count(*) AS n FROM x GROUP BY status",
    "centroid_rank_zones": f"WITH {C}{NEAR} SELECT face_id, CAST(rank AS INTEGER) AS rank, cluster_label, round(d, 6) + 0.0 AS distance, CASE WHEN d < 0.30 THEN 'auto_merge' WHEN d < 0.45 THEN 'ask_user' ELSE 'new_cluster' END AS zone FROM near",
    "noise_reclaim_frozen": f"WITH {C}{NEAR}, {FACES}, x AS ({DECIDE} FROM near n JOIN f ON f.id = representative_face_id WHERE rank = 1 AND face_id % 10 = 9) SELECT *, CASE status WHEN 'auto_merge' THEN 'auto_merged' WHEN 'ask_user' THEN 'suggestions' ELSE 'left_as_noise' END AS bucket FROM x",
    "batch_tier_decision": f"WITH {C}, b AS (SELECT list(a ORDER BY pos) AS w FROM (SELECT pos, avg(v) AS a FROM (SELECT unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM l WHERE label = 4) GROUP BY pos)), x AS (SELECT cluster_label, 1 - list_inner_product(centroid, w) / sqrt(list_inner_product(w, w)) AS d FROM c, b ORDER BY d, cluster_label LIMIT 1) SELECT CASE WHEN d <= 0.18 THEN 'AUTO_MERGE' WHEN d <= 0.40 THEN 'USER_PROMPT' ELSE 'NEW_CLUSTER' END AS action, CASE WHEN d <= 0.40 THEN cluster_label END AS target, round(d, 6) + 0.0 AS dist FROM x",
    "flow2_pairs": FLOW2 + " SELECT cluster_a, cluster_b, round(distance, 6) + 0.0 AS distance, round(centroid_distance, 6) + 0.0 AS centroid_distance, round(min_member_distance, 6) + 0.0 AS min_member_distance, distance < 0.30 AS auto_mergeable, rep_a_image_path, rep_b_image_path, rep_a_identity, rep_b_identity FROM x WHERE x.distance < 0.45",
    "flow2_dismissed": FLOW2 + " SELECT cluster_a, cluster_b, distance < 0.30 AS auto_mergeable FROM x WHERE distance < 0.45 AND cluster_a <> 0",
    "merge_clusters": f"WITH {C}, l2 AS (SELECT * REPLACE (CASE WHEN cluster_label = 5 THEN 2 ELSE cluster_label END AS cluster_label) FROM l){_cents('l2', 'c2')}, pick AS (SELECT * FROM c2 WHERE cluster_label = 2 UNION ALL SELECT * FROM c WHERE cluster_label NOT IN (2, 5)) SELECT cluster_label, n_members, n_members AS n_present, representative_face_id, round(centroid[1], 6) + 0.0 AS first FROM pick",
    "probe_diagnostic": f"WITH {P}, q AS (SELECT vector AS q FROM p WHERE face_id = 0), x AS (SELECT 1 - list_inner_product(vector, q) AS d FROM p, q WHERE face_id <> 0 AND lower(identity) = 'id_0') SELECT round(min(d), 6) + 0.0 AS closest, round(max(d), 6) + 0.0 AS farthest, round(avg(d), 6) + 0.0 AS mean, count(*) AS n FROM x",
    "calibration_full": f"WITH {P}{PAIRS.format('p')}{CALIBRATE.format('0')}",
    "calibration_overlapping": f"WITH {R}, r2 AS (SELECT * FROM r WHERE identity <> 'id_9'){PAIRS.format('r2')}{CALIBRATE.format('(SELECT count(*) FROM embeddings WHERE label = 9)')}",
    "false_merge_curve": f"WITH {P}{PAIRS.format('p')}, b AS (SELECT CAST(floor(round(d, 9) * 100) AS BIGINT) AS bucket, count(*) AS n, sum(is_diff) AS f FROM pr GROUP BY 1) SELECT bucket, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS total, CAST(sum(f) OVER (ORDER BY bucket) AS BIGINT) AS diffs FROM b",
    "identity_exclusion": f"WITH {R} SELECT identity, count(*) AS n FROM r WHERE identity NOT IN ('id_3', 'id_7') GROUP BY identity",
    "contingency": f"WITH {CR} SELECT identity AS truth, cluster_label AS pred, count(*) AS n FROM cr GROUP BY ALL",
    "ari": ONE + " SELECT ari FROM s",
    "nmi": ONE + " SELECT nmi FROM s",
    "v_measure": ONE + " SELECT homogeneity, completeness, v_measure FROM s",
    "purity": ONE + " SELECT purity FROM s",
    "metrics_bundle": ONE + " SELECT * EXCLUDE (model) FROM s",
    "silhouette": f"WITH {L}, d AS (SELECT a.face_id, a.cluster_label AS own, b.cluster_label AS grp, avg(list_distance(a.vector, b.vector)) AS d FROM l a JOIN l b ON a.face_id <> b.face_id GROUP BY ALL), ab AS (SELECT face_id, max(d) FILTER (grp = own) AS a, min(d) FILTER (grp <> own) AS b FROM d GROUP BY face_id) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM ab",
    "model_comparison": TWO + " SELECT model, ari, nmi, purity, v_measure FROM s",
    "best_per_metric": TWO + f", m AS {MELT} SELECT metric, first(model ORDER BY value DESC, model) AS best, max(value) AS value FROM m GROUP BY metric",
    "metrics_melt": TWO + f" SELECT * FROM {MELT}",
    "metrics_pivot": TWO + " SELECT model, ari, nmi, purity, v_measure FROM s",
    "per_identity_breakdown": f"WITH {CR}, g AS (SELECT identity, count(*) AS total, count(*) FILTER (cluster_label = -1) AS noise, list_sort(list(DISTINCT cluster_label) FILTER (cluster_label <> -1)) AS ls FROM cr GROUP BY identity) SELECT identity, total, noise, array_to_string(ls, ',') AS assigned, CAST(len(ls) AS BIGINT) AS n_clusters, CASE WHEN noise = total THEN 'All Noise' WHEN len(ls) > 1 THEN 'Split' ELSE 'Clean' END AS status FROM g",
    "split_identities": f"WITH {CR} SELECT identity, count(DISTINCT cluster_label) AS n_clusters FROM cr WHERE cluster_label <> -1 GROUP BY identity HAVING count(DISTINCT cluster_label) > 1",
    "pure_mixed": f"WITH {CR}, g AS (SELECT cluster_label, list_sort(list(DISTINCT identity)) AS ls FROM cr WHERE cluster_label <> -1 GROUP BY cluster_label) SELECT cluster_label, array_to_string(ls, ',') AS identities, CASE WHEN len(ls) = 1 THEN 'pure' ELSE 'mixed' END AS verdict FROM g",
    "cluster_sizes": f"WITH {CR} SELECT cluster_label, count(*) AS images FROM cr GROUP BY cluster_label",
    "distinct_labels": f"WITH {CR} SELECT DISTINCT cluster_label FROM cr",
    "live_browser": f"WITH {C}, {FACES}, n AS (SELECT cluster_label, count(*) AS n_present FROM l GROUP BY 1) SELECT n.cluster_label, n_present, representative_face_id, coalesce(f.identity, '?') AS representative_identity FROM n LEFT JOIN c USING (cluster_label) LEFT JOIN f ON f.id = representative_face_id",
    "label_encode": f"WITH {FACES} SELECT id, identity, CAST(dense_rank() OVER (ORDER BY identity) - 1 AS INTEGER) AS code FROM f",
    "case_insensitive_match": f"WITH {FACES} SELECT id, identity FROM f WHERE lower(identity) = 'id_4'",
    "collated_positions": f"WITH {FACES} SELECT id, CAST(row_number() OVER (ORDER BY lower(identity), lower(image_path)) - 1 AS INTEGER) AS position FROM f",
    "best_face_per_image": f"WITH {DET}, x AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY det_score DESC, face_index) AS n FROM det) SELECT face_id, face_index, det_score FROM x WHERE n = 1",
    "face_index": f"WITH {DET} SELECT face_id, face_index, CAST(row_number() OVER (PARTITION BY face_id ORDER BY det_score DESC, face_index) - 1 AS INTEGER) AS new_index FROM det",
    "quality_filter": f"WITH {DET} SELECT face_id, face_index, det_score, w, h, blur_var FROM det WHERE det_score >= 0.65 AND w >= 20 AND h >= 20 AND (blur_var IS NULL OR blur_var >= 20)",
    "confidence_filter": f"WITH {DET} SELECT det_score >= 0.75 AS kept, count(*) AS n FROM det GROUP BY 1",
    "reject_reasons": f"WITH {DET}, x AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY det_score DESC, face_index) AS n FROM det WHERE face_id % 11 <> 0), y AS (SELECT face_id, concat_ws(', ', CASE WHEN det_score < 0.65 THEN 'LOW_SCORE' END, CASE WHEN w < 20 OR h < 20 THEN 'SMALL' END, CASE WHEN blur_var < 20 THEN 'BLURRY' END) AS r FROM x WHERE n = 1) SELECT vec_id AS face_id, CASE WHEN r IS NULL THEN 'NO DETECTION' WHEN r = '' THEN 'OK' ELSE r END AS status FROM embeddings LEFT JOIN y ON y.face_id = vec_id",
    "ingest_counters": "SELECT count(*) FILTER (vec_id % 11 <> 0) AS ok, count(*) FILTER (vec_id % 11 = 0) AS no_face, count(*) FILTER (vec_id % 11 <> 0 AND vec_id % 4 > 0) AS multi FROM embeddings",
    "detector_variance": "WITH a AS (SELECT vec_id, vec_id % 4 + 1 AS n FROM embeddings), b AS (SELECT vec_id, vec_id % 4 AS n, vec_id % 10 / 1000.0::DOUBLE + 0.001::DOUBLE AS t FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 4 > 0), j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (vec_id)) SELECT (SELECT count(*) FROM a) AS images_a, (SELECT CAST(sum(n) AS BIGINT) FROM a) AS faces_a, 0.005::DOUBLE AS latency_a, (SELECT count(*) FROM b) AS images_b, (SELECT CAST(sum(n) AS BIGINT) FROM b) AS faces_b, (SELECT round(avg(t), 6) + 0.0 FROM b) AS latency_b, (SELECT count(*) FROM j WHERE x <> y) AS mismatched, (SELECT count(*) FROM j WHERE x > 1 OR y > 1) AS multi_face, 200.0::DOUBLE AS per_second_a, (SELECT round(1 / avg(t), 6) + 0.0 FROM b) AS per_second_b",
    "mismatch_top10": "WITH a AS (SELECT 'id_' || label || '/' || vec_id || '.jpg' AS filename, vec_id % 4 + 1 AS count_a, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 4 ELSE 0 END AS count_b FROM embeddings) SELECT * FROM a WHERE count_a <> count_b ORDER BY filename LIMIT 10",
    "registry_explode": f"WITH {DET} SELECT image_path AS filename, CAST(count(*) OVER (PARTITION BY image_path) AS INTEGER) AS total_faces_found, face_index AS box_index, 'crop_' || face_id || '_' || face_index || '.jpg' AS crop_filename, CAST(face_id % 50 AS INTEGER) AS x, CAST(face_id % 40 AS INTEGER) AS y, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height FROM det",
    "margin_boxes": "WITH b AS (SELECT vec_id AS v, CAST(vec_id % 90 AS DOUBLE) AS x1, CAST(vec_id % 70 AS DOUBLE) AS y1, CAST(vec_id % 90 + 15 + vec_id % 40 AS DOUBLE) AS x2, CAST(vec_id % 70 + 12 + vec_id % 55 AS DOUBLE) AS y2 FROM embeddings), s AS (SELECT *, greatest(x2 - x1, y2 - y1) * 1.6::DOUBLE / 2 AS r, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, CAST(trunc((x2 - x1) * 0.1::DOUBLE) AS INTEGER) AS dx, CAST(trunc((y2 - y1) * 0.1::DOUBLE) AS INTEGER) AS dy FROM b) SELECT v AS face_id, CAST(trunc(greatest(0, cx - r)) AS INTEGER) AS square_0, CAST(trunc(greatest(0, cy - r)) AS INTEGER) AS square_1, CAST(trunc(least(120, cx + r)) AS INTEGER) AS square_2, CAST(trunc(least(100, cy + r)) AS INTEGER) AS square_3, greatest(0, CAST(x1 AS INTEGER) - dx) AS prop_0, greatest(0, CAST(y1 AS INTEGER) - dy) AS prop_1, least(120, CAST(x2 AS INTEGER) + dx) AS prop_2, least(100, CAST(y2 AS INTEGER) + dy) AS prop_3, x1 AS clip_0, y1 AS clip_1, least(120.0, x2) AS clip_2, least(100.0, y2) AS clip_3 FROM s",
    "eye_alignment_matrix": "WITH e AS (SELECT vec_id AS v, 30.0::DOUBLE + vec_id % 7 AS lx, 40.0::DOUBLE + vec_id % 11 AS ly, 60.0::DOUBLE + vec_id % 13 AS rx, 42.0::DOUBLE + vec_id % 5 AS ry FROM embeddings), d AS (SELECT *, sqrt((rx - lx) ** 2 + (ry - ly) ** 2) AS q, atan2(ry - ly, rx - lx) AS t, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy FROM e), m AS (SELECT *, 35 / q * cos(t) AS a, 35 / q * sin(t) AS b FROM d) SELECT v AS face_id, q >= 30 AS usable, round(degrees(t), 6) + 0.0 AS angle, round(35 / q, 6) + 0.0 AS scale, round(a, 6) + 0.0 AS m0, round(b, 6) + 0.0 AS m1, round((1 - a) * cx - b * cy + 56 - cx, 6) + 0.0 AS m2, round(-b, 6) + 0.0 AS m3, round(a, 6) + 0.0 AS m4, round(b * cx + (1 - a) * cy + 52 - cy, 6) + 0.0 AS m5 FROM m",
    "filename_identity": f"WITH {FACES} SELECT id, CASE WHEN id % 3 = 0 THEN identity ELSE 'Unknown' END AS by_name, identity AS by_export, CASE WHEN id % 5 = 0 THEN 'Unassigned_Outlier' ELSE identity END AS by_folder FROM f",
    "crop_names": f"WITH {FACES} SELECT id, identity || '__' || id || '__face' || id % 3 || '.jpg' AS crop, 'crop_' || id || '_' || id % 3 || '.jpg' AS detector_crop, CAST(id AS VARCHAR) AS stem, '.jpg' AS suffix FROM f",
    "folder_manifest": f"WITH {CR} SELECT CASE WHEN cluster_label = -1 THEN 'noise' ELSE 'cluster_' || cluster_label END AS cluster_folder, identity || '/' || face_id || '.jpg' AS src, 'default/arcface/' || CASE WHEN cluster_label = -1 THEN 'noise' ELSE 'cluster_' || cluster_label END || '/' || identity || '__' || face_id || '.jpg' AS dst FROM cr",
    "missing_sources": f"WITH {FACES} SELECT image_path AS src FROM f WHERE id % 4 = 1 ORDER BY src LIMIT 20",
    "upsert_faces": f"WITH {FACES} SELECT id, identity, image_path, 0.5::DOUBLE AS det_score FROM f UNION ALL SELECT (SELECT max(id) FROM f) + row_number() OVER (ORDER BY 'new/' || image_path), identity, 'new/' || image_path, 0.875::DOUBLE FROM f",
    "upsert_labels": f"WITH {CR} SELECT run_label, face_id, cluster_label + 80 AS cluster_label FROM cr UNION ALL SELECT 'other', face_id, cluster_label FROM cr",
    "upsert_embeddings": f"WITH {R} SELECT face_id, 8 AS dim, round(vector[2], 6) + 0.0 AS first FROM r",
    "relabel": f"WITH {CR} SELECT CASE WHEN cluster_label = 5 THEN 2 ELSE cluster_label END AS cluster_label, count(*) AS n FROM cr GROUP BY 1",
    "update_labels": f"WITH {CR} SELECT face_id, cluster_label + 100 AS cluster_label FROM cr",
    "delete_centroids": f"WITH {CR} SELECT cluster_label, count(*) AS n_members FROM cr WHERE cluster_label NOT IN (-1, 3) GROUP BY 1",
    "start_cluster": f"WITH {C} SELECT cluster_label, n_members, representative_face_id FROM c UNION ALL SELECT (SELECT max(cluster_label) + 1 FROM c), 1, 19",
    "assign_face": f"WITH {C}, v AS (SELECT vector AS v FROM l WHERE face_id = 19), x AS (SELECT n_members + 1 AS n, list_transform(list_zip(centroid, v), lambda z: (z[1] * n_members + z[2]) / (n_members + 1)) AS w FROM c, v WHERE cluster_label = 2), y AS (SELECT n, w, sqrt(list_inner_product(w, w)) AS q FROM x) SELECT 2 AS cluster_label, n AS n_members, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, round(unnest(w) / q, 6) + 0.0 AS value FROM y",
    "dbscan": f"WITH RECURSIVE {P}{_dbscan(0.6, 4)} SELECT face_id, cluster_label FROM lab",
    "cluster_pass": f"WITH RECURSIVE {P}{_dbscan(0.6, 4)}, lv AS (SELECT lab.face_id, lab.cluster_label, p.vector FROM lab JOIN p USING (face_id)){_cents('lv', 'c')} SELECT cluster_label, n_members, representative_face_id FROM c",
    "first_images": f"WITH {FACES} SELECT id, identity, image_path FROM f ORDER BY identity, image_path LIMIT 25",
    "vectors_by_cluster": f"WITH {CR} SELECT cluster_label, CAST(count(*) AS INTEGER) AS n FROM cr GROUP BY 1",
    "batch_apply": f"WITH {C}, b AS (SELECT list(a ORDER BY pos) AS w FROM (SELECT pos, avg(v) AS a FROM (SELECT unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM l WHERE label = 4) GROUP BY pos)), x AS (SELECT cluster_label, 1 - list_inner_product(centroid, w) / sqrt(list_inner_product(w, w)) AS d FROM c, b ORDER BY d, cluster_label LIMIT 1), t AS (SELECT CASE WHEN d <= 0.40 THEN cluster_label ELSE (SELECT max(cluster_label) + 1 FROM l) END AS k FROM x), y AS (SELECT cluster_label FROM l UNION ALL SELECT k FROM t, range(0, (SELECT count(*) FROM l WHERE label = 4))) SELECT CAST(cluster_label AS INTEGER) AS cluster_label, count(*) AS n FROM y GROUP BY 1",
    "cluster_all_models": _all_models(),
    "landmark_similarity": _similarity(),
    "model_inputs": f"""WITH {DET}, m(i, model, size, alignment) AS (VALUES (0, 'arcface', 112, 'insightface_norm_crop'), (1, 'dlib_resnet', 150, 'dlib_chip'), (2, 'facenet', 160, 'bbox_margin_crop'), (3, 'siglip2', 224, 'bbox_margin_crop'))
SELECT model, alignment, size, count(*) AS n FROM det JOIN m ON i = face_id % 4 GROUP BY ALL""",
    "dbscan_sweep": _sweep(tuple((e, m) for e in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0) for m in (1, 2, 3))),
}
