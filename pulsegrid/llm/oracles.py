"""DuckDB SQL for the queries of this subpackage that plain SQL can express."""

OP1 = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM item_window),
doc_window AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, k FROM doc_window JOIN item_window USING (k, g)),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

OP2 = r"""
WITH part AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rule_set(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (
  SELECT host, path, h || p AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, h || p DESC) AS k
  FROM (SELECT DISTINCT host, path FROM part), rule_set
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, part.host, part.path, rule, coalesce(v, 'allow') AS verdict
FROM part LEFT JOIN fit ON part.host = fit.host AND part.path = fit.path AND k = 1
"""

OP5 = r"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN size USING (doc_id)
"""

OP10 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
told AS (
  SELECT *, 3 + 7 + 12 + length(role) + length(text)
    + CASE WHEN regexp_matches(role || ' ' || text, '</?s>|\[/?INST\]')
      THEN len(regexp_extract_all(role || ' ' || text, '</?s>|\[/?INST\]')) ELSE 0 END AS n
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, true AS identical
FROM told GROUP BY conv_id
"""


def _op11(rounds: int = 6) -> str:
    """Each round's distances, nearest entries and means, one after the other."""
    near = """near{i} AS MATERIALIZED (
  SELECT r, p, k, d FROM (
    SELECT r, p, k, d, row_number() OVER (PARTITION BY r, p ORDER BY d, k) AS place FROM (
      SELECT r, p, k, CAST(sum((cell.x - book{i}.x) * (cell.x - book{i}.x)) AS BIGINT) AS d FROM cell JOIN book{i} USING (p, i) GROUP BY r, p, k))
  WHERE place = 1)"""
    book = """book{j} AS MATERIALIZED (
  SELECT p, k, i, coalesce(CAST(floor(mean.s / mean.n) AS BIGINT), x) AS x FROM book{i} LEFT JOIN (
    SELECT p, k, i, CAST(sum(x) AS DOUBLE) AS s, count(*) AS n FROM near{i} JOIN cell USING (r, p) GROUP BY p, k, i) AS mean USING (p, k, i))"""
    steps = ["""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cell AS MATERIALIZED (
  SELECT r, i * 8 // len(v) AS p, i, v[i + 1] AS x FROM (SELECT r, v, unnest(range(len(v))) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT p, r AS k, i, x FROM cell WHERE r < 16)"""]
    for i in range(rounds):
        steps += [near.format(i=i), book.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    return ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  sha256((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i) FROM book{rounds})) AS codebooks_sha256
FROM kept JOIN (SELECT r, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r) USING (r)
"""


OP12 = r"""
WITH RECURSIVE vec AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN link ON a = other)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_url_filter": OP2, "op5_neardup": OP5, "op10_chat_format": OP10, "op11_vector_codes": _op11(), "op12_vector_dups": OP12}
