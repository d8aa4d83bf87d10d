"""DuckDB statements for the queries that SQL can express exactly on whole tables."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"

P3 = " UNION ALL ".join(
    f"""
    SELECT '{t}' AS tbl, id, neighbor_id FROM (
      WITH v AS (
        SELECT id, {c}::DOUBLE[] AS e FROM {t}
        WHERE {c} IS NOT NULL AND len({c}) = 64
          AND len(list_filter({c}, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter({c}, lambda x: x <> 0)) > 0
      ), s AS (
        SELECT q.id AS id, r.id AS neighbor_id, round(list_cosine_similarity(q.e, r.e), 6) AS c
        FROM v q, v r WHERE q.id % 40 = 0 AND q.id <> r.id
      )
      SELECT id, neighbor_id FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbor_id) <= 10
    )"""
    for t, c in (("code_files", "summary_embedding"), ("code_chunks", "embedding"), ("code_symbols", "embedding"))
)

P4 = """
SELECT id AS chunk_id,
  CASE WHEN list_max(list_transform(string_split(chunk_content, chr(10)), lambda x: ceil(length(x) / 4.0))) > 800
    THEN 'inside_line' ELSE 'line_ends' END AS cut
FROM code_chunks WHERE ceil(length(chunk_content) / 4.0) > 800
"""

P6 = f"""
WITH t AS (
  SELECT 'code_chunks' AS tbl, id, {_WORDS.format("chunk_content")} AS w FROM code_chunks WHERE chunk_content IS NOT NULL
  UNION ALL
  SELECT 'code_symbols', id, {_WORDS.format("definition")} FROM code_symbols WHERE definition IS NOT NULL
), s AS (
  SELECT DISTINCT tbl, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT tbl, id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 20)
), n AS (SELECT tbl, id, count(*) AS n FROM s GROUP BY ALL),
c AS (
  SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY ALL
)
SELECT c.tbl AS tbl, id_a, id_b FROM c
JOIN n x ON x.tbl = c.tbl AND x.id = id_a JOIN n y ON y.tbl = c.tbl AND y.id = id_b
WHERE k / (x.n + y.n - k) >= 0.7
"""

P8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3,
        "p4_found": P4,
        "p6_found": P6,
        "p8_found": P8,
        "p8_clean": f"SELECT doc_id, kind, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P8}))",
    }
