"""SQL that states the same results plainly, for the queries SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op1_url_filters": r"""
WITH rules(verdict, rule) AS (VALUES
  ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
  ('allow', 'com/fr/'), ('block', 'com/de/')),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules
    ON ends_with('.' || host, '.' || split_part(rule, '/', 1))
   AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
""",
    "op2_source_mixing": rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM docs GROUP BY source),
caps AS (
  SELECT *, source_size * 2 AS cap, [5, 2, 1][(place - 1) % 3 + 1] AS weight,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
targets AS (
  SELECT source, place, source_size, budget, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT d.*, t.place, t.source_size, t.target, t.budget,
    sum(size) OVER (PARTITION BY t.place ORDER BY key, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS done,
    row_number() OVER (ORDER BY doc_id) AS rid
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT *, CASE WHEN target > 0 THEN (turn * source_size + done) / target
    ELSE ('0x' || key[1:8])::BIGINT / 4294967296.0::DOUBLE END AS finish
  FROM queued, (VALUES (0), (1)) AS r(turn)),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, turn, key, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
  FROM turns)
SELECT doc_id, size, source_size, target, sum(CASE WHEN served <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM served GROUP BY rid, doc_id, size, source_size, target
""",
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
    "op6_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, ws[s:s + least(len(ws), 10) - 1] AS w
  FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS t(s) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT rid, n, s, ws[s:s + n - 1] AS w
  FROM d, lengths, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS t(s)),
found AS (SELECT rid, item_id, s, n FROM doc_windows JOIN windows USING (n, w)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + n)) AS t(p) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
""",
    "op13_importance_resampling": r"""
WITH crc_table AS (  -- CRC-32 of each byte: eight steps of the reflected polynomial
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM range(256) AS r(b))),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, TRUE AS corpus, text FROM documents
  UNION ALL SELECT NULL, NULL, FALSE, text FROM benchmark),
words AS (
  SELECT rid, doc_id, corpus, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM texts),
spans AS (SELECT rid, corpus, unnest(ws) AS w FROM words),
codes AS (
  SELECT w, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))),
      lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000)::INTEGER AS bucket
  FROM (SELECT DISTINCT w FROM spans), crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM spans JOIN codes USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts, totals),
weights AS (SELECT rid, sum(gain)::BIGINT AS weight FROM spans JOIN codes USING (w) JOIN gains USING (bucket) WHERE corpus GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (rid) WHERE corpus),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM ranked
""",
}
