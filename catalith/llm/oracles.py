"""SQL for the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM per),
c AS (SELECT *, 3 * source_size AS cap FROM w),
l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM c) AS DOUBLE) - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE))
          / CAST((SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM c
  WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN CAST(cap AS DOUBLE) / weight <= level THEN CAST(cap AS DOUBLE) ELSE (SELECT max(level) FROM l) * weight END AS target
  FROM l),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
f AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM b),
r AS (SELECT *, CASE WHEN source_size > 0 THEN budget - passes * source_size ELSE 0 END AS rest FROM f),
s AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized)
SELECT s.doc_id, s.source, s.size, r.source_size, r.target,
       CAST(r.passes * s.size + greatest(0, least(s.size, r.rest - s.start)) AS BIGINT) AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
""",
    "op3_bm25": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
  FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
stats AS (SELECT count(*) AS n, (SELECT sum(len) FROM len) / count(*) AS mean FROM documents WHERE doc_id IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT doc_id AS query_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
    FROM documents WHERE doc_id % 20 = 0) GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op5_preferences": r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS better, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, better ORDER BY turn, role, text) AS place,
         '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
  FROM t),
c AS (SELECT * FROM p WHERE better), r AS (SELECT * FROM p WHERE NOT better),
b AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.place, r.place) AS place,
         coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.place = r.place),
n AS (SELECT pair_id, coalesce(min(place) FILTER (NOT same) - 1, max(place)) AS n FROM b GROUP BY pair_id),
o AS (
  SELECT p.*, n.n, CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS label FROM p JOIN n USING (pair_id))
SELECT pair_id, n AS n_prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY place) FILTER (better AND place <= n), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY place) FILTER (better AND place > n), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY place) FILTER (NOT better AND place > n), '') AS rejected,
       coalesce(string_agg(length(head) || ':0,' || length(body) || label, ',' ORDER BY place) FILTER (better AND place > n), '') AS chosen_mask,
       coalesce(string_agg(length(head) || ':0,' || length(body) || label, ',' ORDER BY place) FILTER (NOT better AND place > n), '') AS rejected_mask
FROM o GROUP BY pair_id, n
""",
}

ORACLES["bm25_benchmark"] = ORACLES["op3_bm25"].replace("doc_id AS query_id", "item_id AS query_id").replace("documents WHERE doc_id % 20 = 0", "benchmark WHERE item_id IS NOT NULL")

ORACLES["op6_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


def _licences() -> str:
    """The same steps over the documents and the listed texts, then a join of digests."""
    from catalith.llm.licences import STEPS, TEXTS

    expression = "lower(coalesce(text, ''))"
    for pattern, replacement in STEPS:
        expression = f"regexp_replace({expression}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEXTS.items()))
    return f"""
WITH known AS (SELECT licence, sha256({expression}) AS digest FROM (VALUES {rows}) AS v(licence, text)),
d AS (SELECT doc_id, sha256({expression}) AS digest FROM documents)
SELECT d.doc_id, d.digest, k.licence FROM d LEFT JOIN known k ON d.digest = k.digest
"""


ORACLES["op7_licences"] = _licences()


def _located(found: str, gaps: str, offset: str) -> str:
    """Structs (s, e, v) of matches, from the matches and what lies between them."""
    before = f"list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': CAST({offset} + {before} AS INTEGER), 'e': CAST({offset} + {before} + length({found}[i]) AS INTEGER), 'v': {found}[i]}})"


def _personal_data() -> str:
    """The four patterns as they stand, then the words outside of them, counts and shares, step by step."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INTEGER) WHEN CAST(reverse(d)[i] AS INTEGER) > 4 THEN 2 * CAST(reverse(d)[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse(d)[i] AS INTEGER) END)) % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    }
    found = []
    for i, (pattern, test) in enumerate(kinds.values()):
        spans = _located(f"regexp_extract_all(text, '{pattern}')", f"string_split_regex(text, '{pattern}')", "0")
        found.append(f"SELECT row, text, {i} AS kind, m.s, m.e, m.v FROM (SELECT row, text, m.s, m.e, m.v AS v, regexp_replace(m.v, '[^0-9]', '', 'g') AS d, m FROM (SELECT row, text, unnest({spans}) AS m FROM t)) WHERE {test}")
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " ELSE 'term' END"
    listed = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    word = r"[\p{L}\p{M}\p{N}_]+"
    # full lower case, as the operator's; lower() here knows one letter's short form only
    lowered = "lower(replace(w, '\u0130', 'i\u0307'))"
    return rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
b AS MATERIALIZED ({' UNION ALL '.join(found)}),
o AS (SELECT row, text, s, coalesce(max(e) OVER (PARTITION BY row ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
g AS (SELECT row, before AS a, text[before + 1:s] AS part FROM o WHERE before < s
  UNION ALL SELECT row, max(e), any_value(text)[max(e) + 1:] FROM b GROUP BY row
  UNION ALL SELECT row, 0, text FROM t WHERE row NOT IN (SELECT row FROM b)),
d AS MATERIALIZED (SELECT DISTINCT row, {lowered} AS term FROM (SELECT row, unnest(regexp_extract_all(part, '{word}')) AS w FROM g)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
m AS (SELECT DISTINCT row, kind || ':' || CASE WHEN kind >= 2 THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE lower(v) END AS entity FROM b),
e AS (SELECT entity, count(*) AS n_e FROM m GROUP BY entity),
f AS (SELECT term, count(*) AS n_t FROM d GROUP BY term),
p AS (SELECT entity, term, count(*) AS n_et FROM m JOIN d USING (row) GROUP BY ALL),
q AS (SELECT term, n_e / n AS usual, (n_et + 0.25 * (n_e / n)) / (n_t + 0.25) AS given FROM p JOIN e USING (entity) JOIN f USING (term), n),
r AS MATERIALIZED (SELECT DISTINCT term FROM q WHERE given >= 0.8 AND given >= 2 * usual),
h AS (SELECT row, a, regexp_extract_all(part, '{word}') AS ws, string_split_regex(part, '{word}') AS gs FROM g WHERE row IN (SELECT row FROM d JOIN r USING (term))),
u AS (SELECT row, a, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS gap, unnest(range(len(ws))) AS i FROM h),
x AS (SELECT row, w, a + sum(length(gap) + length(w)) OVER (PARTITION BY row, a ORDER BY i) AS e FROM u),
a AS (SELECT row, kind, s, e FROM b UNION ALL SELECT row, 4, CAST(e AS INTEGER) - CAST(length(w) AS INTEGER), CAST(e AS INTEGER) FROM x WHERE {lowered} IN (SELECT term FROM r))
SELECT t.doc_id, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(kinds))},
  sha256(coalesce({listed} FILTER (kind < 4), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM t LEFT JOIN a USING (row) GROUP BY t.row, t.doc_id
"""


ORACLES["op8_pii"] = _personal_data()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
