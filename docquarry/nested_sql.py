"""SQL of problem 6, by patterns over XML texts and JSON trees; the tests and the driver compare it with the operator."""

from __future__ import annotations

from docquarry.operators import nested

_PLACES = ", ".join(f"('{up}', '{label}', '{place}')" for (up, label), place in nested.PLACES.items())
_KINDS = ", ".join(f"'{k}'" for k in nested.KINDS)
_STRUCTURE = ", ".join(f"'{x}'" for x in sorted(nested.STRUCTURE))
_FIELDS = ", ".join(f"'{x}'" for x in nested.FIELDS)
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
#: A truncated payload is ill-formed, and no other: enough for payloads that were delivered whole or cut.
_GOOD = f"payload IS NOT NULL AND CASE WHEN fmt = 'json' THEN json_valid(payload) ELSE trim(payload, {_BLANKS}) LIKE '%</us-patent-grant>' END"


def _decoded(words: str) -> str:
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        words = f"replace({words}, '&{name};', '{ch}')"
    return f"replace(replace({words}, chr(2), '<'), chr(3), '&')"


#: els (raw_id, id, parent, label, num) are the elements in their order, segs (raw_id, seq, el, words) the texts in them.
_ELEMENTS = rf"""
    good AS MATERIALIZED (SELECT raw_id, fmt, payload FROM grants_raw WHERE {_GOOD}),
    bodies AS (SELECT raw_id, array_to_string(list_transform(string_split(regexp_replace(payload, '(?s)<!--.*?-->', '', 'g'), '<![CDATA['),
        lambda x, i: CASE WHEN i = 1 THEN x ELSE replace(replace(split_part(x, ']]>', 1), '<', chr(2)), '&', chr(3)) || split_part(x, ']]>', 2) END), '') AS body
        FROM good WHERE fmt = 'xml'),
    lists AS (SELECT raw_id, regexp_extract_all(body, '<[/A-Za-z][^>]*>[^<]*') AS xs FROM bodies),
    marks AS (SELECT raw_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM lists),
    tags AS (SELECT raw_id, i, regexp_extract(x, '^</?([A-Za-z0-9_-]+)', 1) AS label, regexp_extract(x, '>([^<]*)$', 1) AS words, nullif(regexp_extract(x, '^[^>]*\snum="([^"]*)"', 1), '') AS num,
        CASE WHEN x LIKE '</%' THEN -1 WHEN regexp_matches(x, '^<[^>]*/>') THEN 0 ELSE 1 END AS step FROM marks),
    deep AS MATERIALIZED (SELECT *, sum(step) OVER (PARTITION BY raw_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS depth FROM tags),
    opens AS MATERIALIZED (SELECT raw_id, i AS id, label, num, CASE WHEN step = 0 THEN depth + 1 ELSE depth END AS level FROM deep WHERE step >= 0),
    tree AS MATERIALIZED (SELECT g.raw_id, t.id, t.parent, t.key, t.type, t.atom FROM good g, json_tree(g.payload) t WHERE g.fmt = 'json'),
    members AS MATERIALIZED (SELECT n.raw_id, n.id, n.type, n.atom ->> '$' AS words, CASE WHEN p.type = 'ARRAY' THEN p.key ELSE n.key END AS label,
        CASE WHEN p.type = 'ARRAY' THEN p.parent ELSE n.parent END AS parent FROM tree n JOIN tree p ON p.raw_id = n.raw_id AND p.id = n.parent WHERE n.type NOT IN ('ARRAY', 'NULL')),
    els AS MATERIALIZED (
        SELECT c.raw_id, c.id, p.id AS parent, c.label, c.num FROM opens c ASOF LEFT JOIN opens p ON p.raw_id = c.raw_id AND p.level = c.level - 1 AND p.id < c.id
        UNION ALL SELECT m.raw_id, m.id, CASE WHEN m.parent > 0 THEN m.parent END, m.label, x.words FROM members m LEFT JOIN members x ON x.raw_id = m.raw_id AND x.parent = m.id AND x.label = 'num'
        WHERE m.label NOT IN ('text', 'num')),
    segs AS MATERIALIZED (
        SELECT t.raw_id, t.i AS seq, p.id AS el, {_decoded('t.words')} AS words FROM deep t ASOF JOIN opens p ON p.raw_id = t.raw_id AND p.level = t.depth AND p.id <= t.i
        UNION ALL SELECT raw_id, CASE WHEN label = 'text' THEN parent ELSE id END, CASE WHEN label = 'text' THEN parent ELSE id END, words FROM members WHERE type <> 'OBJECT' AND label <> 'num')"""

_NODES = f"""WITH RECURSIVE places(up, label, place) AS (VALUES {_PLACES}), {_ELEMENTS},
    walk AS (
        SELECT e.raw_id, e.id, e.label, coalesce(p.place, '-') AS place, CAST(NULL AS BIGINT) AS above, CAST(NULL AS BIGINT) AS own FROM els e LEFT JOIN places p ON p.up = '' AND p.label = e.label WHERE e.parent IS NULL
        UNION ALL
        SELECT e.raw_id, e.id, e.label, coalesce(p.place, '-'), w.own, CASE WHEN p.place IN ({_KINDS}) THEN e.id ELSE w.own END
        FROM walk w JOIN els e ON e.raw_id = w.raw_id AND e.parent = w.id LEFT JOIN places p ON p.up = w.place AND p.label = e.label),
    made AS MATERIALIZED (SELECT * FROM walk),
    numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY raw_id, above, place ORDER BY id) AS n FROM made WHERE place IN ({_KINDS})),
    named AS (
        SELECT raw_id, id, place AS kind, CAST(n AS VARCHAR) AS node_no, '' AS parent_no FROM numbered WHERE above IS NULL
        UNION ALL SELECT c.raw_id, c.id, c.place, p.node_no || '.' || c.n, p.node_no FROM named p JOIN numbered c ON c.raw_id = p.raw_id AND c.above = p.id),
    says AS MATERIALIZED (SELECT raw_id, el, bool_or(regexp_matches(words, '\\S')) AS said, string_agg(words, '' ORDER BY seq) AS words FROM segs GROUP BY raw_id, el),
    below AS (SELECT c.raw_id, c.parent, list(DISTINCT c.label) AS labels, bool_or(c.label = 'date' AND coalesce(s.said, false)) AS dated FROM els c LEFT JOIN says s ON s.raw_id = c.raw_id AND s.el = c.id GROUP BY c.raw_id, c.parent),
    spoken AS (SELECT m.raw_id, CASE WHEN m.place IN ({_KINDS}) THEN m.id ELSE m.above END AS id, string_agg(g.words, '' ORDER BY g.seq) AS words FROM made m JOIN segs g ON g.raw_id = m.raw_id AND g.el = m.id
        WHERE m.place IN ({_KINDS}) OR m.label NOT IN ({_STRUCTURE}, {_FIELDS}) GROUP BY ALL),
    fields AS (SELECT m.raw_id, m.above AS id, {", ".join(f"coalesce(arg_min(s.words, m.id) FILTER (WHERE m.label = '{label}'), CASE WHEN bool_or(m.label = '{label}') THEN '' END) AS {field}" for label, field in nested.FIELDS.items())}
        FROM made m LEFT JOIN says s ON s.raw_id = m.raw_id AND s.el = m.id WHERE m.label IN ({_FIELDS}) AND m.place NOT IN ({_KINDS}) AND m.above IS NOT NULL GROUP BY m.raw_id, m.above),
    nodes AS MATERIALIZED (SELECT k.raw_id, k.kind, k.node_no, k.parent_no, e.num, coalesce(w.words, '') AS words, f.country, f.doc_number, f.kind_code, f.date, f.other,
        CASE WHEN k.kind = 'document_id' THEN CASE WHEN b.labels IS NULL AND NOT coalesce(s.said, false) THEN 'empty' WHEN NOT (list_contains(coalesce(b.labels, []), 'country') AND list_contains(b.labels, 'doc-number')) THEN 'partial' WHEN b.dated THEN 'dated' ELSE 'undated' END
             WHEN k.kind = 'citation' THEN CASE WHEN list_contains(coalesce(b.labels, []), 'patcit') THEN 'patent' WHEN list_contains(coalesce(b.labels, []), 'nplcit') THEN 'other' ELSE 'empty' END
             WHEN list_has_any(coalesce(b.labels, []), [{_STRUCTURE}]) THEN 'nested' WHEN b.labels IS NOT NULL THEN 'marked' WHEN coalesce(s.said, false) THEN 'text' ELSE 'empty' END AS variant
        FROM named k JOIN els e ON e.raw_id = k.raw_id AND e.id = k.id LEFT JOIN spoken w ON w.raw_id = k.raw_id AND w.id = k.id LEFT JOIN fields f ON f.raw_id = k.raw_id AND f.id = k.id
        LEFT JOIN says s ON s.raw_id = k.raw_id AND s.el = k.id LEFT JOIN below b ON b.raw_id = k.raw_id AND b.parent = k.id)"""

_KEYS = "raw_id, node_no, parent_no"
_TEXT = "CASE WHEN variant <> 'empty' THEN words END AS text"
_OTHER = "CASE WHEN variant = 'other' THEN other END AS text"
_ID = "country, try_cast(doc_number AS BIGINT) AS number, doc_number, kind_code"
_IDS = (
    "CASE WHEN variant <> 'empty' THEN country END AS country, CASE WHEN variant IN ('dated', 'undated') THEN try_cast(doc_number AS BIGINT) END AS number,"
    " CASE WHEN variant <> 'empty' THEN doc_number END AS doc_number, CASE WHEN variant <> 'empty' THEN kind_code END AS kind_code,"
    " CASE WHEN variant = 'dated' THEN try_cast(date AS INTEGER) END AS date, CASE WHEN variant = 'partial' THEN date END AS date_text"
)


def _of(columns: str, condition: str) -> str:
    return f"{_NODES} SELECT {columns} FROM nodes WHERE {condition}"


SQL = {
    "p6_found": _of("raw_id, kind, node_no, parent_no", "true"),
    "p6_variants": f"{_NODES} SELECT kind, variant, count(*) AS n_elements FROM nodes GROUP BY kind, variant",
    "p6_rejected": f"SELECT raw_id, CASE WHEN payload IS NULL THEN 'null' WHEN trim(payload, {_BLANKS}) = '' THEN 'blank' ELSE 'ill-formed' END AS reason FROM grants_raw WHERE NOT coalesce({_GOOD}, false)",
    "p6_claim": _of(f"{_KEYS}, variant, num, {_TEXT}", "kind = 'claim'"),
    **{f"p6_{kind}": _of(f"{_KEYS}, variant, {_TEXT}", f"kind = '{kind}'") for kind in ("claim_text", "abstract_p", "description_p", "list_item")},
    "p6_citation": _of(f"{_KEYS}, variant, {_OTHER}", "kind = 'citation'"),
    "p6_document_id": _of(f"{_KEYS}, variant, {_IDS}", "kind = 'document_id'"),
    "p6_patent_citations": _of(_KEYS, "kind = 'citation' AND variant = 'patent'"),
    "p6_other_citations": _of(f"{_KEYS}, other AS text", "kind = 'citation' AND variant = 'other'"),
    "p6_dated_ids": _of(f"{_KEYS}, {_ID}, try_cast(date AS INTEGER) AS date", "kind = 'document_id' AND variant = 'dated'"),
    "p6_undated_ids": _of(f"{_KEYS}, {_ID}", "kind = 'document_id' AND variant = 'undated'"),
}
