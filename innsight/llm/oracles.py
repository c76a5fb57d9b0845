"""DuckDB text for the operators that SQL can express."""

from __future__ import annotations

_BLANKS = r"[\x20\x09-\x0D]"

#: Conversations that continue no other: turn lists compared as lists.
CHAT = """
WITH turns AS (
    SELECT conv_id, turn, role, text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
           count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM conversations
), said AS (
    SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS l, max(n_turns) AS n_turns
    FROM turns GROUP BY conv_id
), whole AS (
    SELECT l, n_turns, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM said GROUP BY l, n_turns
), maximal AS (
    SELECT * FROM whole w
    WHERE NOT EXISTS (
        SELECT 1 FROM said s WHERE s.l[1] = w.l[1] AND s.n_turns > w.n_turns AND s.l[1:w.n_turns] = w.l
    )
)
SELECT m.conv_id, (t.pos - 1) // 128 AS segment, m.n_turns, m.n_snapshots, count(*) AS segment_turns,
       string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10),
                  '' ORDER BY t.pos) AS text
FROM maximal m JOIN turns t USING (conv_id)
GROUP BY m.conv_id, (t.pos - 1) // 128, m.n_turns, m.n_snapshots
"""



def _reach(width: int, columns: str) -> str:
    """Connected components by repeated least neighbours; fit for the small table that it is compared on."""
    return f"""
WITH RECURSIVE words AS (
    SELECT doc_id,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS s
    FROM words
), single AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT a.doc_id AS u, b.doc_id AS v
    FROM single a JOIN single b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id{columns}
FROM sets s JOIN least l USING (doc_id)
"""


NEAR = _reach(5, ", s.doc_id = l.component_id AS kept")
JACCARD = _reach(4, "")

#: Keys of ten code points or more that two documents hold lose their lines outside the first.
LINES = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^{_BLANKS}+|{_BLANKS}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
    SELECT keyed.*, coalesce(doc_id > first, false) AS dropped FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def all_oracles() -> dict[str, str]:
    return {"op2_chat_formatting": CHAT, "op9_near_duplicates": NEAR, "op10_line_dedup": LINES, "op13_jaccard_join": JACCARD}
