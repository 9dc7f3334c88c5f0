"""SQL with the results of those queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: A leaf's fields, with {0} for the text.
_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: Bytes of a number's digits through the table t of the reflected CRC-32.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH w AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM w, LATERAL unnest(range(1, len(ws) - 11)) AS u(i)),
lo AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN lo USING (k), range(0, 13) AS t(j) WHERE m < doc_id),
r AS (SELECT doc_id, list(p) AS ps FROM cov GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)""",
    "op6_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM s LEFT JOIN c USING (doc_id)""",
    "op12_merkle_manifest": f"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(x AS BIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format("text")} END AS seen FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(source, lvl, i, n, h) AS (SELECT source, 0, i, n, leaf FROM p UNION ALL SELECT source, lvl + 1, i // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, lvl, i // 16),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
o(lvl, i, n, h) AS (SELECT 0, i, n, subroot FROM s UNION ALL SELECT lvl + 1, i // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM o WHERE n > 1 GROUP BY lvl, i // 16),
st AS (SELECT source, lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM t WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, i // 16 ORDER BY i)),
so AS (SELECT lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM o WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 16 ORDER BY i)),
pieces AS (SELECT p.source, p.i, lvl, l, r FROM p JOIN st ON st.source IS NOT DISTINCT FROM p.source AND st.i = p.i // CAST(power(16, lvl) AS BIGINT)
  UNION ALL SELECT p.source, p.i, 1000 + lvl, l, r FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN so ON so.i = s.i // CAST(power(16, lvl) AS BIGINT)),
way AS (SELECT source, i, list({{'l': l, 'h': '', 'r': r}} ORDER BY lvl) AS w FROM pieces GROUP BY source, i),
f AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM o WHERE n = 1) AS root, coalesce(w, []) AS w, p.seen FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN way ON way.source IS NOT DISTINCT FROM p.source AND way.i = p.i)
SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(w, lambda x: x.l || x.r)), lambda a, b: a || b)) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend({{'l': '', 'h': seen, 'r': ''}}, w), lambda a, x: {{'l': '', 'h': sha256(x.l || a.h || x.r), 'r': ''}}).h AS folded_root FROM f)""",
}
