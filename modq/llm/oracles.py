"""SQL of the pN_ queries that SQL can express, over whole tables (DuckDB)."""

from __future__ import annotations

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\p{P}\p{S}]', '', 'g'), '[" + _SPACE + r"]+'), lambda w: w <> '')"

_DELIVERED = rf"""WITH r AS (SELECT row_idx, text FROM moderation_examples UNION ALL
        SELECT row_idx, j->>'$.text' FROM (SELECT row_idx, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_rows)
        WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.text') = 'VARCHAR'),
      k AS (SELECT row_idx, regexp_replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ẞ', 'ss'), 'ς', 'σ'), '[\p{{P}}$+<=>^`|~{_SPACE}]', '', 'g') AS k
        FROM r WHERE row_idx IS NOT NULL AND regexp_matches(text, '[^{_SPACE}]'))"""

_LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
      e AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
      dr AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS r FROM d, unnest(range(1, len(w) - 10)) AS t(i)),
      er AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS r FROM e, unnest(range(1, len(w) - 10)) AS t(i)),
      l AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r))"""

ORACLE_SQL: dict[str, str] = {
    "p2_found": f"""{_DELIVERED}, m AS (SELECT k, min(row_idx) AS first_row_idx FROM k GROUP BY k HAVING count(*) > 1)
      SELECT DISTINCT first_row_idx, row_idx FROM k JOIN m USING (k) WHERE row_idx <> first_row_idx""",
    "p2_copies": f"{_DELIVERED} SELECT min(row_idx) AS row_idx, count(*) AS n_copies FROM k GROUP BY k",
    "p8_found": f"{_LEAKS} SELECT doc_id, item_id FROM l",
    "p8_items": f"{_LEAKS} SELECT i.item_id, i.split, count(l.doc_id) AS n_documents FROM eval_items i LEFT JOIN l USING (item_id) GROUP BY i.item_id, i.split",
    "p9_found": """WITH n AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source)
      SELECT t.source FROM mix_targets t LEFT JOIN n USING (source)
      WHERE coalesce(n.n, 0) * t.max_repeats < t.target_share * (SELECT sum(length(text)) FROM documents)""",
    "p10_found": """WITH s AS (SELECT DISTINCT doc_id, substring(text, i, 250) AS s FROM documents, unnest(range(1, length(text) - 248)) AS t(i) WHERE length(text) >= 250),
      m AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1), c AS (SELECT * FROM s SEMI JOIN m USING (s))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id""",
    "p10_share": """WITH s AS (SELECT doc_id, i, substring(text, i, 250) AS s FROM documents, unnest(range(1, length(text) - 248)) AS t(i) WHERE length(text) >= 250),
      m AS (SELECT s FROM s GROUP BY s HAVING count(DISTINCT doc_id) > 1),
      c AS (SELECT doc_id, sum(least(250, coalesce(following - i, 250))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM s SEMI JOIN m USING (s)) GROUP BY doc_id)
      SELECT doc_id, length(text) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0 END AS share
      FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL""",
}
