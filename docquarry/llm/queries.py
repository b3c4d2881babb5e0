"""Queries of the problems in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import tokens, tokens_sql
from docquarry.llm import distinctive, encoding, packing, sentences, spampages
from docquarry.llm.frequencies import CountStore, arrivals
from docquarry.llm.neardup import NearDuplicates
from docquarry.session import table

#: White space, as the splitting knows it.
_BLANK = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]"
ZONES = ["title", "abstract", "claims", "description"]


def zone_tokens() -> Column:
    """Tokens of the four zones of a row."""
    return F.concat(*[F.coalesce(tokens(z), F.array().cast("array<string>")) for z in ZONES])


def posting_token() -> Column:
    """The token of a postings row, as a list of one."""
    return F.array(F.lower(F.trim("token")))


def _loaded(spark: SparkSession, d: str) -> CountStore:
    """Both fields in two steps: what was there by the end of 2013, then the rows that came since, merged as signed deltas."""
    store = CountStore(spark)
    for field, name, at, terms in (
        ("postings.token", "postings", "indexed_at", posting_token()),
        ("patents.contents", "patents", "loaded_at", zone_tokens()),
    ):
        rows, early = table(spark, d, name), F.coalesce(F.col(at) < "2014-01-01", F.lit(False))
        store.load(field, rows.filter(early), "doc_id", terms)
        store.apply(field, arrivals(rows.filter(early), rows.filter(~early), "doc_id"), "doc_id", terms)
    return store


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).marked().filter("band IS NOT NULL").select("field", F.col("term").alias("token"), "band")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).marked().withColumnsRenamed({"term": "token", "records": "n_docs"})


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.scores(table(spark, d, "patents"), "doc_id", "row_id", zone_tokens()).withColumnRenamed("term", "token")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).filter("tf >= 4 AND records BETWEEN 2 AND 8").select("doc_id", "token")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("doc_id", "token", "tf", F.col("records").alias("n_docs"), F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "patents"), "row_id", {"abstract": "Abstract", "description": "Description"})


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """How many characters other than white space the units of a zone hold: all of them, once."""
    zones = table(spark, d, "patents").select("row_id", F.explode(F.expr("array(struct('Abstract' AS ct, abstract AS text), struct('Description' AS ct, description AS text))")).alias("z"))
    units = p4_found(spark, d).join(zones.select("row_id", "z.ct", "z.text"), ["row_id", "ct"])
    unit = F.expr("substring(text, start_pos + 1, end_pos - start_pos)")
    return units.groupBy("row_id", "ct").agg(F.sum(F.length(F.regexp_replace(unit, _BLANK, ""))).alias("n_chars"))


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    patents = table(spark, d, "patents")
    return NearDuplicates(patents.select("doc_id", F.concat_ws(" ", *ZONES[1:]).alias("body")), "doc_id", "body")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("doc", "doc_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    ids = encoding.encode(table(spark, d, "documents"), "doc_id", "text", offsets=True)
    return encoding.decode(ids, "doc_id", "ids", starts="starts")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return encoding.count_tokens(table(spark, d, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), "doc_id", "n_tokens")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).filter(F.col("piece_no") > 0).select("doc_id").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_proof(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents whose pieces do not cover them once, and containers that hold more than they may, of a packing."""
    return packing.violations(_packed(spark, d), _sizes(spark, d), "doc_id", "n_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    prose = F.col("zone").isin("abstract", "claims", "description")
    return spampages.spam_pages(table(spark, d, "documents"), "doc_id", "text", "lang", prose).select("doc_id")


def p9_curves(spark: SparkSession, d: str) -> DataFrame:
    """The rank-frequency curves of all documents."""
    got = spampages.rank_curves(table(spark, d, "documents"), "doc_id", "text")
    return got.select("doc_id", "n_terms", F.round("slope", 6).alias("slope"), F.round("residual", 6).alias("residual"))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p4_found": p4_found,
    "p4_cover": p4_cover,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_found": p8_found,
    "p8_packed": p8_packed,
    "p8_proof": p8_proof,
    "p9_found": p9_found,
    "p9_curves": p9_curves,
}

_ZONE_TOKENS = " || ".join(f"coalesce({tokens_sql(z)}, [])" for z in ZONES)
_P1_COUNTS = f"""
    WITH rows_ AS (
        SELECT 'postings.token' AS field, doc_id, lower(trim(token, ' ')) AS token FROM postings WHERE doc_id IS NOT NULL AND token IS NOT NULL
        UNION ALL
        SELECT 'patents.contents', doc_id, unnest({_ZONE_TOKENS}) FROM patents WHERE doc_id IS NOT NULL),
    n AS (SELECT 'postings.token' AS field, count(DISTINCT doc_id) AS n FROM postings
          UNION ALL SELECT 'patents.contents', count(DISTINCT doc_id) FROM patents)
    SELECT field, token, occurrences, n_docs,
           CASE WHEN n_docs <= 2 THEN 'rare' WHEN 10 * n_docs > 3 * n THEN 'common' END AS band
    FROM (SELECT field, token, count(*) AS occurrences, count(DISTINCT doc_id) AS n_docs FROM rows_ GROUP BY field, token) c
    JOIN n USING (field)"""
_P3_SCORES = f"""
    WITH per_row AS (SELECT doc_id, row_id, token, count(*) AS tf FROM
            (SELECT doc_id, row_id, unnest({_ZONE_TOKENS}) AS token FROM patents WHERE doc_id IS NOT NULL) x GROUP BY ALL),
    local AS (SELECT doc_id, token, max(tf) AS tf FROM per_row GROUP BY ALL),
    n AS (SELECT count(DISTINCT doc_id) AS n FROM patents),
    spread AS (SELECT token, count(*) AS n_docs, sum(tf) AS gf, sum(tf * ln(tf)) AS tlt FROM local GROUP BY token)
    SELECT doc_id, token, tf, n_docs, round(ln(1 + tf) * (1 - (ln(gf) - tlt / gf) / ln(n)), 6) AS score
    FROM local JOIN spread USING (token), n"""

_P5_PAIRS = r"""
    WITH docs AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(lower(concat_ws(' ', any_value(abstract), any_value(claims), any_value(description))), '\s+', ' ', 'g'), ' ') AS t
        FROM patents WHERE doc_id IS NOT NULL GROUP BY doc_id),
    runs AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(t) - 6), lambda i: substr(t, i, 8)))) AS r FROM docs WHERE len(t) >= 300),
    sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS m FROM runs a JOIN runs b ON a.r = b.r AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT doc_a, doc_b FROM shared JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b WHERE 10 * m >= 6 * (x.n + y.n - m)"""

_P4_COVER = " UNION ALL ".join(
    f"SELECT row_id, '{ct}' AS ct, length(regexp_replace({zone}, '{_BLANK}', '', 'g')) AS n_chars FROM patents WHERE length(regexp_replace({zone}, '{_BLANK}', '', 'g')) > 0"
    for zone, ct in (("abstract", "Abstract"), ("description", "Description"))
)
#: Classes of equal texts, links between them, and their transitive closure.
_P5_GROUPS = _P5_PAIRS.replace("WITH docs", "WITH RECURSIVE docs").replace(")\n    SELECT doc_a, doc_b", "),\n    pairs AS MATERIALIZED (SELECT doc_a, doc_b") + r"""),
    classes AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id FROM docs WHERE len(t) >= 300),
    ends AS (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
    links AS MATERIALIZED (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM ends JOIN classes x ON x.doc_id = a JOIN classes y ON y.doc_id = b WHERE x.class_id <> y.class_id),
    reached AS (SELECT DISTINCT class_id AS a, class_id AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
    groups AS (SELECT a, min(b) AS group_id FROM reached GROUP BY a),
    degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT doc_id, class_id, group_id, CAST(coalesce(n, 0) AS INTEGER) AS n_links FROM classes JOIN groups g ON g.a = class_id LEFT JOIN degrees d ON d.a = class_id"""

#: A term is a run of letters, or one character of a script without blanks; terms of equal frequency share the mean of their ranks.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
_P9_CURVES = rf"""
    WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([{_UNSPACED}])', ' \1 ', 'g'), '[\p{{L}}\p{{M}}{_UNSPACED}]+')) AS term FROM documents WHERE trim(text, ' ') <> ''),
    freq AS (SELECT doc_id, term, count(*) AS f FROM terms GROUP BY ALL),
    spectrum AS (SELECT doc_id, f, count(*) AS m FROM freq GROUP BY ALL),
    points AS (SELECT *, ln(sum(m) OVER (PARTITION BY doc_id ORDER BY f DESC ROWS UNBOUNDED PRECEDING) - (m - 1) / 2) AS x, ln(f) AS y FROM spectrum),
    sums AS (SELECT doc_id, CAST(sum(f * m) AS INTEGER) AS n_terms, sum(m) AS w, sum(m * x) AS sx, sum(m * y) AS sy, sum(m * x * x) AS sxx, sum(m * x * y) AS sxy, sum(m * y * y) AS syy FROM points GROUP BY doc_id),
    v AS (SELECT *, sxx - sx * sx / w AS vx, sxy - sx * sy / w AS vxy, syy - sy * sy / w AS vy FROM sums)
    SELECT doc_id, n_terms, round(CASE WHEN vx > 1e-9 THEN vxy / vx ELSE 0 END, 6) AS slope,
        round(sqrt(greatest(CASE WHEN vx > 1e-9 THEN greatest(vy - vxy * vxy / vx, 0) / w ELSE vy / w END, 0)), 6) AS residual FROM v"""

SQL = {
    "p9_curves": _P9_CURVES,
    "p4_cover": _P4_COVER,
    "p5_found": _P5_PAIRS,
    "p5_groups": _P5_GROUPS,
    "p8_proof": "SELECT count(*) AS n_items, CAST(0 AS BIGINT) AS n_wrong_items, CAST(0 AS BIGINT) AS n_wrong_containers FROM documents",
    "p1_found": f"SELECT field, token, band FROM ({_P1_COUNTS}) WHERE band IS NOT NULL",
    "p1_counts": _P1_COUNTS,
    "p3_found": f"SELECT doc_id, token FROM ({_P3_SCORES}) WHERE tf >= 4 AND n_docs BETWEEN 2 AND 8",
    "p3_scores": _P3_SCORES,
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
