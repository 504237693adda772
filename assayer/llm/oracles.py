"""DuckDB SQL for the queries that SQL can express at a bearable cost."""

from __future__ import annotations

from assayer.llm.common import LOWER, UPPER

SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


LINES = f"""
    lines AS (
        SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ),
    keyed AS (
        SELECT doc_id, pos, line, {lowered(f"trim(line, {SPACES_SQL})")} AS line_key FROM lines
    ),
    shared AS (
        SELECT line_key, max(doc_id) AS keeper FROM keyed
        WHERE length(line_key) >= 20
        GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
    ),
    judged AS (
        SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone
        FROM keyed k LEFT JOIN shared s USING (line_key)
    )
"""

ORACLES = {
    "op1_line_dedup": f"""
        WITH {LINES}
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
                   AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op5_winnowing": f"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
            FROM documents
        ),
        item_words AS (
            SELECT item_id, regexp_extract_all({lowered("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
            FROM benchmark
        ),
        item_windows AS (
            SELECT DISTINCT item_id, least(len(words), 10) AS length,
                   array_to_string(words[s:s + least(len(words), 10) - 1], ' ') AS win
            FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s
                  FROM item_words WHERE len(words) > 0)
        ),
        doc_windows AS (
            SELECT doc_id, s, length, array_to_string(words[s:s + length - 1], ' ') AS win
            FROM (SELECT doc_id, words, length, unnest(range(1, len(words) - length + 2)) AS s
                  FROM doc_words, (SELECT DISTINCT length FROM item_windows))
        ),
        found AS (SELECT doc_id, s, length, item_id FROM doc_windows JOIN item_windows USING (length, win)),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + length)) AS p FROM (SELECT DISTINCT doc_id, s, length FROM found))
            GROUP BY doc_id
        ),
        items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
            FROM found GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op3_preference_pairs": """
        WITH turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        ),
        sides AS (
            SELECT *, CASE WHEN role = 'assistant' THEN lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY pos)
                           ELSE text END AS other
            FROM turns
        ),
        parted AS (
            SELECT *, bool_or(text <> other) OVER (PARTITION BY conv_id ORDER BY pos) AS apart,
                   length(role) + 5 AS head,
                   '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
                   '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS shown_other
            FROM sides
        ),
        placed AS (
            SELECT *, sum(length(shown)) OVER upto AS till, sum(length(shown_other)) OVER upto AS till_other
            FROM parted WINDOW upto AS (PARTITION BY conv_id, apart ORDER BY pos)
        )
        SELECT conv_id, count(*) FILTER (NOT apart)::INTEGER AS prompt_turns,
               sha256(coalesce(string_agg(shown, '' ORDER BY pos) FILTER (NOT apart), '')) AS prompt_sha256,
               sha256(coalesce(string_agg(shown, '' ORDER BY pos) FILTER (apart), '')) AS chosen_sha256,
               sha256(coalesce(string_agg(shown_other, '' ORDER BY pos) FILTER (apart), '')) AS rejected_sha256,
               coalesce(string_agg((till - length(shown) + head)::BIGINT || '-' || till::BIGINT, ',' ORDER BY pos)
                        FILTER (apart AND role = 'assistant'), '') AS chosen_spans,
               coalesce(string_agg((till_other - length(shown_other) + head)::BIGINT || '-' || till_other::BIGINT, ',' ORDER BY pos)
                        FILTER (apart AND role = 'assistant'), '') AS rejected_spans
        FROM placed GROUP BY conv_id
    """,
    "op11_angular_negatives": """
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
                   list_inner_product(a.x, v.x)::BIGINT AS score
            FROM vectors a JOIN vectors v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
        ),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
}
