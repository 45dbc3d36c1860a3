"""SQL of the operators that SQL can express."""

from __future__ import annotations

from .licenses import LIMIT, TEMPLATES
from .suffix_dedup import LEAST

#: Words as ``words.tokenize`` cuts them, of lower-cased text.
WORD = r"[a-z0-9\x{C0}-\x{1FFF}\x{2040}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pairs(w: str) -> str:
    return f"CASE WHEN len({w}) = 1 THEN {w} ELSE list_distinct(list_transform(generate_series(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1])) END"


REPEATS = f"""WITH d AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM d WHERE text IS NOT NULL),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS spot FROM t WHERE len(w) >= {LEAST}),
g AS (SELECT doc_id, spot, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY spot ROWS BETWEEN CURRENT ROW AND {LEAST - 1} FOLLOWING)) AS h FROM u),
r AS (SELECT doc_id, spot, count(*) OVER (PARTITION BY h) AS places, row_number() OVER (PARTITION BY h ORDER BY doc_id, spot) = 1 AS first FROM g WHERE spot + {LEAST} <= n),
i AS (SELECT doc_id, spot, first, spot - row_number() OVER (PARTITION BY doc_id, first ORDER BY spot) AS run FROM r WHERE places > 1)
SELECT doc_id, min(spot)::INT AS start_word, (max(spot) + {LEAST})::INT AS end_word, (max(spot) + {LEAST} - min(spot))::INT AS n_words, first FROM i GROUP BY doc_id, first, run"""

def _best(units: str, key: str) -> str:
    """Rows of ``units`` with the best template that reaches the limit, one for each ``key``."""
    size = f"len(p.b) >= len(t.b) * {LIMIT / (2 - LIMIT) - 1e-9} AND len(t.b) >= len(p.b) * {LIMIT / (2 - LIMIT) - 1e-9}"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY dice DESC, name) AS best FROM (
SELECT p.*, name, 2e0 * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b)) AS dice FROM (SELECT *, {_pairs("w")} AS b FROM {units}) p JOIN t ON {size}) WHERE dice >= {LIMIT - 1e-9}) WHERE best = 1"""


LICENSES = f"""WITH t0 AS (SELECT name, regexp_extract_all(lower(body), '{WORD}') AS w FROM (VALUES {", ".join(f"({_lit(k)}, {_lit(v)})" for k, v in TEMPLATES.items())}) x(name, body)), t AS (SELECT name, {_pairs("w")} AS b FROM t0),
most AS (SELECT floor(max(len(w)) * {(2 - LIMIT) / LIMIT})::INT AS words FROM t0),
l AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), u AS (SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS spot FROM l),
w AS (SELECT row_id, doc_id, spot, line, regexp_extract_all(lower(line), '{WORD}') AS w FROM u), s AS (SELECT *, spot - row_number() OVER (PARTITION BY row_id ORDER BY spot) AS run FROM w WHERE len(w) > 0),
f AS (SELECT row_id, doc_id, spot, unnest(x) AS w, generate_subscripts(x, 1) AS part FROM (SELECT row_id, doc_id, spot, list_filter(list_transform(string_split_regex(line, '[.!?][ \t\r]'), lambda y: regexp_extract_all(lower(y), '{WORD}')), lambda y: len(y) > 0) AS x FROM s) WHERE len(x) > 1),
g AS (SELECT row_id, doc_id, min(spot) AS first_line, max(spot) - min(spot) + 1 AS n_lines, flatten(list(w ORDER BY spot)) AS w, row_number() OVER (PARTITION BY row_id ORDER BY min(spot)) AS block FROM s GROUP BY row_id, doc_id, run),
h AS (SELECT *, sum(len(w)) OVER (PARTITION BY row_id ORDER BY block) AS upto FROM g),
r AS (SELECT a.row_id, a.doc_id, a.block AS lo, c.block AS hi, flatten(list(b.w ORDER BY b.block)) AS w, a.first_line, c.first_line + c.n_lines - a.first_line AS n_lines FROM h a JOIN h c ON c.row_id = a.row_id AND c.block >= a.block AND (c.block = a.block OR c.upto - a.upto + len(a.w) <= (SELECT words FROM most))
JOIN h b ON b.row_id = a.row_id AND b.block BETWEEN a.block AND c.block GROUP BY a.row_id, a.doc_id, a.block, c.block, a.first_line, c.first_line, c.n_lines),
q AS ({_best("r", "row_id, lo, hi")}),
k AS (SELECT row_id, doc_id, 0 AS unit, spot AS first_line, 1 AS n_lines, 0 AS part, w FROM s UNION ALL SELECT row_id, doc_id, 1, first_line, n_lines, 0, w FROM g WHERE n_lines > 1 UNION ALL SELECT row_id, doc_id, 3, spot, 1, part, w FROM f),
z AS ({_best("k", "row_id, unit, first_line, part")})
SELECT doc_id, unit::INT AS unit, first_line::INT AS first_line, n_lines::INT AS n_lines, name AS license, dice, len(w)::INT AS n_words FROM z
UNION ALL SELECT doc_id, 2, first_line::INT, n_lines::INT, name, dice, len(w)::INT FROM q WHERE hi > lo AND NOT EXISTS (
SELECT 1 FROM q o WHERE o.row_id = q.row_id AND o.lo <= q.hi AND q.lo <= o.hi AND (o.dice > q.dice OR (o.dice = q.dice AND (o.lo < q.lo OR (o.lo = q.lo AND o.hi < q.hi)))))"""
