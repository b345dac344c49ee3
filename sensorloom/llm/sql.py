"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from sensorloom.llm.common import LOWER, UPPER

_WORDS = r"[^\x20\x09-\x0D]+"
_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_LINES = rf"""
d AS (
    SELECT row_number() OVER () AS rid, *, coalesce(source, '') AS host, string_split(text, chr(10)) AS raw,
        list_transform(string_split(translate(text, '{UPPER}', '{LOWER}'), chr(10)),
            lambda l: trim(regexp_replace(l, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ')) AS normal
    FROM documents
),
pages AS (
    SELECT rid, host, array_to_string(list_filter(normal, lambda l: l <> ''), chr(10)) AS page, unnest(list_distinct(list_filter(normal, lambda l: l <> ''))) AS line FROM d
),
hosts AS (SELECT host, count(DISTINCT page) AS host_pages FROM pages GROUP BY host),
"""

OP1 = r"""
WITH turns AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
asked AS (SELECT conv_id, turn, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM turns WHERE role = 'user'),
replied AS (SELECT conv_id, turn - 1 AS asked, turn, coalesce(text, '') AS text FROM turns WHERE role = 'assistant'),
calls AS (
    SELECT conv_id, 'ask-' || turn AS call_id, 'ask' AS tool, turn, 1 AS level,
        CASE WHEN text = '' THEN ['$.text: shorter than 1'] ELSE [] END AS problems,
        '{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || '},"name":"ask","needs":[' ||
            list_aggregate(list_sort(list_transform(range(len(lines)), lambda i: '"line-' || turn || '-' || i || '"')), 'string_agg', ',') || ']}' AS call
    FROM asked
    UNION ALL
    SELECT conv_id, 'line-' || turn || '-' || i, 'lookup', turn, 0,
        list_concat(CASE WHEN n < 1 THEN ['$.words: below 1'] WHEN n > 40 THEN ['$.words: above 40'] ELSE [] END,
            CASE WHEN line = '' THEN ['$.line: shorter than 1'] WHEN length(line) > 2000 THEN ['$.line: longer than 2000'] ELSE [] END),
        '{"arguments":{"line":' || to_json(line) || ',"words":' || n || '},"name":"lookup","needs":[]}'
    FROM (SELECT *, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS n
        FROM (SELECT conv_id, turn, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM asked))
),
results AS (
    SELECT conv_id, 'ask-' || asked AS call_id, turn, text AS content FROM replied
    UNION ALL
    SELECT conv_id, 'line-' || asked || '-' || i, turn, content
    FROM (SELECT conv_id, asked, turn, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS content FROM replied)
)
SELECT conv_id, call_id, c.tool, coalesce(c.turn, r.turn) AS turn, c.level,
    CASE WHEN c.tool IS NULL THEN 'orphan' WHEN len(c.problems) > 0 THEN 'invalid' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
    coalesce(c.problems, []) AS problems, (c.tool IS NOT NULL)::BIGINT AS n_calls, (r.turn IS NOT NULL)::BIGINT AS n_results,
    '{' || CASE WHEN c.tool IS NOT NULL THEN '"call":' || c.call || ',' ELSE '' END || '"id":"' || call_id || '"' ||
        CASE WHEN r.turn IS NOT NULL THEN ',"result":' || to_json(r.content) ELSE '' END || '}' AS record
FROM calls c FULL JOIN results r USING (conv_id, call_id)
"""

OP2 = f"""
WITH {_LINES}
common AS (
    SELECT host, list(line) AS lines FROM (
        SELECT p.host, line FROM pages p JOIN hosts h ON p.host = h.host
        GROUP BY p.host, line HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) > any_value(host_pages) * 0.02::DOUBLE)
    GROUP BY host
),
cut AS (
    SELECT d.*, c.lines, list_filter(list_zip(raw, normal), lambda x: x[2] = '' OR NOT list_contains(coalesce(c.lines, []), x[2])) AS stays
    FROM d LEFT JOIN common c ON d.host = c.host
)
SELECT doc_id, source, CASE WHEN lines IS NULL OR text IS NULL THEN 0 ELSE len(raw) - len(stays) END::BIGINT AS n_lines_dropped,
    CASE WHEN lines IS NULL OR text IS NULL THEN text ELSE coalesce(array_to_string(list_transform(stays, lambda x: x[1]), chr(10)), '') END AS text
FROM cut
"""


def links_sql(k: int, columns: str = "") -> str:
    """Classes of documents whose sets of k-word shingles are similar."""
    return rf"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLDED}, '{_WORDS}') AS words FROM documents
),
s AS (
    SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')) END) AS shingle FROM w
),
n AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY rid, doc_id),
together AS (SELECT a.rid AS ra, b.rid AS rb, count(*) AS both_n FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (
    SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM together JOIN n x ON x.rid = ra JOIN n y ON y.rid = rb
    WHERE 100 * both_n >= 80 * (x.n + y.n - both_n) AND x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL
),
reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM w WHERE doc_id IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
label AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, label.component_id{columns}
FROM w LEFT JOIN n ON n.rid = w.rid LEFT JOIN label ON label.a = w.doc_id
"""


OP4 = links_sql(5)
OP12 = links_sql(2, ", coalesce(w.doc_id = label.component_id, true) AS kept")

OP7 = rf"""
WITH {_LINES}
common AS (
    SELECT p.host, line FROM pages p JOIN hosts h ON p.host = h.host
    GROUP BY p.host, line HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) > any_value(host_pages) * 0.02::DOUBLE
),
w AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT rid, win FROM win GROUP BY rid, win HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS pos FROM win JOIN again USING (rid, win)) GROUP BY rid),
lines AS (SELECT rid, host, unnest(raw) AS line, unnest(normal) AS norm FROM d),
per AS (
    SELECT l.rid, count(*) FILTER (l.norm <> '') - count(DISTINCT l.line) FILTER (l.norm <> '') AS dup,
        coalesce(sum(len(string_split(l.norm, ' '))) FILTER (l.norm <> '' AND c.line IS NOT NULL), 0) AS lost
    FROM lines l LEFT JOIN common c ON c.host = l.host AND c.line = l.norm GROUP BY l.rid
),
m AS (
    SELECT d.doc_id, len(w.words) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(per.dup, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, len(w.words) - coalesce(per.lost, 0) AS n_words_left
    FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN per USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words_left::BIGINT AS n_words_left,
    n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
    NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND n_words_left >= 20 AND n_words_left >= n_words * 0.3 AS kept
FROM m
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = rf"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS words FROM benchmark WHERE text IS NOT NULL),
asked AS (
    SELECT DISTINCT item, least(len(words), 10) AS k, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM item WHERE len(words) > 0)
),
doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS words FROM documents),
places AS (
    SELECT rid, k, i, array_to_string(words[i:i + k - 1], ' ') AS win
    FROM (SELECT rid, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM asked) WHERE len(words) >= k)
),
hit AS (SELECT rid, item, i, p.k FROM places p JOIN asked ON asked.k = p.k AND asked.win = p.win),
words AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hit GROUP BY rid)
SELECT doc_id, len(doc.words)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLDED}, '{_TERMS}') AS terms FROM documents),
whole AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERMS}')) AS term FROM benchmark),
held AS (
    SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY rid, term
),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term),
sizes AS (SELECT rid, doc_id, 50 + (50 * len(terms) * n) // l AS m FROM d, whole WHERE len(terms) > 0),
scored AS (
    SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (rid) GROUP BY item_id, rid
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES = {
    "op1_chat_formatting": OP1, "op2_site_line_dedup": OP2, "op4_ngram_jaccard_join": OP4, "op7_quality_rules": OP7,
    "op8_benchmark_decontamination": OP8, "op11_ranked_lexical_search": OP11, "op12_minhash_near_dedup": OP12,
}
