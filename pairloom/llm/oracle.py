"""The registered queries of this package that SQL can express, for DuckDB, over the same whole tables."""

from __future__ import annotations

import string

URLS = f"""
WITH parts AS (
  SELECT page_id, url, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') AS raw,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
pages_ AS (SELECT page_id, url, path, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host FROM parts),
rules(rule, rule_host, rule_path, action) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block'))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM pages_ LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""

# Components by repeated least neighbour: links are few, so the recursion is short.
NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
         '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
each AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n, b.n AS m, count(*) AS k
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared WHERE 100 * k >= 85 * (n + m - k)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.other = links.u),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
"""

# As above, with shingles of four words.
GROUP_JOIN = (
    NEAR_DUPLICATES.replace("len(w) < 5", "len(w) < 4").replace("range(1, len(w) - 3)", "range(1, len(w) - 2)")
    .replace("w[i:i + 4]", "w[i:i + 3]").replace("component_id, doc_id = component_id AS kept FROM", "component_id FROM")
)

_FINITE = """embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"""


def _rounds() -> str:
    """The rounds of the clustering: nearest centroid, then means rounded down, exact in whole numbers."""
    parts = []
    for n in range(4):
        parts.append(f"""
        near{n} AS (
          SELECT vec_id, p, c, d FROM (
            SELECT vec_id, p, c, list_sum(list_transform(list_zip(p, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM points, centroids{n})
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if n < 3:
            parts.append(f"""
        sums{n} AS (SELECT c, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM near{n}, range(1, 65) AS r(i) GROUP BY c, i),
        means{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums{n} GROUP BY c),
        centroids{n + 1} AS (SELECT c, coalesce(means{n}.m, centroids{n}.m) AS m FROM centroids{n} LEFT JOIN means{n} USING (c))""")
    return ",".join(parts)


KMEANS = f"""
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND {_FINITE}),
centroids0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, p AS m FROM (
    SELECT sha256('1:' || vec_id) AS h, p FROM points ORDER BY h LIMIT 16)),
{_rounds()}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM near3 JOIN centroids3 USING (c)
"""

HARD_NEGATIVES = f"""
WITH points AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS p
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.p, b.p)::BIGINT AS score
  FROM points a JOIN points b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

ORACLE = {
    "op3_url_rules": URLS, "op4_near_duplicates": NEAR_DUPLICATES, "op11_ns_kmeans": KMEANS, "op12_hard_negatives": HARD_NEGATIVES,
    "op13_group_join": GROUP_JOIN,
}
