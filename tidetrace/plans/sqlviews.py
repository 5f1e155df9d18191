"""DuckDB forms of the derived views (FIXTURES.md §3) and shared SQL pieces."""

V = """V AS (
  SELECT vec_id AS post_id, 'label_' || CAST(label AS VARCHAR) AS ChannelName, label, embedding,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((vec_id * 7919) % 43200 AS INTEGER) AS Datetime
  FROM embeddings)"""

T = """T AS (
  SELECT doc_id AS post_id, text AS Tweet, source AS ChannelName, lang AS datasetName,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((doc_id * 2591) % 43200 AS INTEGER) AS Datetime
  FROM documents)"""

R = """R AS (
  SELECT event_id AS PostId,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'user ' || CAST(user_id AS VARCHAR) END AS ChannelName,
         CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '  ' ELSE event_type || ' ' || props END AS post_body_text,
         CASE WHEN event_id % 10 = 0 THEN event_type END AS EmbeddedContentText,
         CASE WHEN event_id % 13 = 0 THEN 'not a date' WHEN event_id % 29 = 0 THEN ''
              ELSE substring(CAST(ts AS VARCHAR), 1, 10) || 'T' || substring(CAST(ts AS VARCHAR), 12, 8) || '.500Z' END AS published_at,
         CASE WHEN event_id % 7 = 0 THEN '12abc' WHEN event_id % 11 = 0 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS LikesCount
  FROM events)"""

N = """N AS (
  SELECT item_id AS narrative_id,
         CASE item_id % 5 WHEN 1 THEN 'ab' WHEN 2 THEN '<b></b> x ' WHEN 3 THEN text || repeat('x', 600)
              ELSE '<i>' || text || '</i>' END AS text
  FROM benchmark)"""

E = """E AS (
  SELECT a.vec_id AS pair_id, a.embedding AS e1, b.embedding AS e2,
         (5 - least(5, abs(a.label - b.label))) / CAST(5 AS DOUBLE) AS gold_score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""

L = """L AS (
  SELECT vec_id AS post_id,
         CASE WHEN vec_id % 11 = 0 THEN NULL
              WHEN vec_id % 7 = 0 THEN 'no json here'
              WHEN vec_id % 17 = 0 THEN '{"support":1}'
              WHEN vec_id % 5 = 0 THEN '{bad} {"unsure":0,"support":0,"opposition":1,"neutral":0}'
              ELSE repeat('`', 3) || 'json' || chr(10) || '{"support":' || CASE WHEN vec_id % 4 = 1 THEN '1' ELSE '0' END
                   || ',"opposition":' || CASE WHEN vec_id % 4 = 2 THEN '1' ELSE '0' END
                   || ',' || chr(10) || '"neutral":' || CASE WHEN vec_id % 4 = 3 OR vec_id % 13 = 0 THEN '1' ELSE '0' END
                   || ',"unsure":' || CASE WHEN vec_id % 4 = 0 THEN '1' ELSE '0' END || '}' || chr(10) || repeat('`', 3) END AS response
  FROM embeddings)"""


def cos(a: str, b: str) -> str:
    """Cosine in double precision, 0 for a zero vector."""
    return (f"coalesce(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
            f"nullif(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
            f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 0), 0)")


def toks(s: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({s}), '[ \\n\\t\\r]+'), lambda x: x <> '')"
