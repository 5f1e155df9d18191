"""DuckDB SQL for the rows of the queries that SQL can state (see `queries.ORACLE_SQL`)."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"
_LONG = ("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, "
         "CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept")
_FLOOR_MEAN = "(s - ((s % n) + n) % n) // n"


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    fits = " UNION ALL ".join(
        f"SELECT page_id, '{h}{p}' AS rule, '{v}' AS verdict, {len(h + p)} AS size FROM parts "
        f"WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in rules)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
listed AS (SELECT DISTINCT host || path AS k FROM parts WHERE host LIKE '%-%'),
fits AS ({fits}),
best AS (SELECT page_id, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM fits GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule, (l.k IS NOT NULL) AS listed,
       coalesce(b.verdict, CASE WHEN l.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON l.k = p.host || p.path"""


def vector_clusters(components: int, centroids: int, rounds: int, seed: str) -> str:
    ctes = [f"kept AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE {_FINITE} AND len(embedding) = {components})",
            f"x AS MATERIALIZED ({_LONG})",
            f"first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster FROM kept "
            f"QUALIFY cluster < {centroids})",
            "c0 AS MATERIALIZED (SELECT cluster, pos, x AS c FROM first JOIN x USING (vec_id))"]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{r} USING (pos) "
                    "GROUP BY vec_id, cluster)")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, cluster, d FROM d{r} "
                    "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) "
                        "GROUP BY cluster, pos)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, pos, CAST(CASE WHEN n IS NULL THEN c ELSE {_FLOOR_MEAN} END "
                        f"AS BIGINT) AS c FROM c{r} LEFT JOIN m{r} USING (cluster, pos))")
    return f"""
WITH {", ".join(ctes)},
h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM a{rounds} JOIN h USING (cluster)"""


def vector_codes(entries: int, parts: int, rounds: int) -> str:
    """For vectors of one length, which ``parts`` divides."""
    ctes = [f"kept AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE {_FINITE})",
            f"x AS MATERIALIZED (SELECT k.vec_id, pos // (len(embedding) // {parts}) AS part, pos, x "
            f"FROM ({_LONG}) JOIN kept k USING (vec_id))",
            f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries})",
            "c0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM first JOIN x USING (vec_id))"]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT vec_id, x.part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d "
                    f"FROM x JOIN c{r} USING (pos) GROUP BY vec_id, x.part, entry)")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM d{r} "
                    "QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT a.part, entry, pos, sum(x) AS s, count(*) AS n FROM a{r} a "
                        "JOIN x ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY a.part, entry, pos)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CAST(CASE WHEN n IS NULL THEN c ELSE {_FLOOR_MEAN} END "
                        f"AS BIGINT) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry, pos))")
    return f"""
WITH {", ".join(ctes)},
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT codebooks_sha256 FROM h) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str, key: str) -> str:
    """CTEs of the smallest node that each node reaches by the links (a, b)."""
    return f"""
both_ways AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
reach AS (SELECT {key} AS node, {key} AS root FROM {nodes}
          UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node),
component AS (SELECT node AS {key}, min(root) AS component_id FROM reach GROUP BY node)"""


def near_duplicates(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) >= {k} THEN list_distinct(list_transform(range(1, len(ws) - {k} + 2),
                                                             lambda i: array_to_string(ws[i:i + {k - 1}], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM sets),
s AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b
    ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
{_components("n", "links", "doc_id")}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN component USING (doc_id)"""


def similar_vectors(min_cosine: float) -> str:
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, {_FINITE} AND len(list_filter(embedding, lambda v: v <> 0)) > 0 AS proper
  FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x)
  WHERE a.proper AND b.proper AND list_cosine_similarity(a.x, b.x) >= {min_cosine}),
{_components("v", "links", "vec_id")},
degree AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)"""


def benchmark_hits(window: int) -> str:
    words = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws"
    return f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} FROM benchmark),
item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (
    SELECT item_id, ws, least(len(ws), {window}) AS m, unnest(range(1, len(ws) - least(len(ws), {window}) + 2)) AS i
    FROM item WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM item_windows),
doc AS MATERIALIZED (SELECT doc_id, {words} FROM documents),
places AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM doc CROSS JOIN sizes WHERE len(ws) >= m),
hits AS MATERIALIZED (
  SELECT doc_id, m, i, item_id FROM (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM places)
  JOIN item_windows USING (m, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""
