"""Queries of the engine's own operators and of the general problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import engine_queries, nested_sql
from docquarry.operators import nested, references
from docquarry.session import scratch_path, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    patents, doc_map, citations, postings = (table(spark, d, t) for t in ("patents", "doc_map", "citations", "postings"))
    known = references.parents(patents, "doc_id", "loaded_at", doc_map, "doc_id", "removed_at")
    return references.orphans(known, references.patent_references(patents, citations, doc_map, postings))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.per_period(p2_found(spark, d))


def _grants(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "grants_raw"), "raw_id", "fmt", "payload")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _grants(spark, d).select("raw_id", "kind", "node_no", "parent_no")


_tables: dict[tuple, nested.Tables] = {}


def grant_tables(spark: SparkSession, d: str) -> nested.Tables:
    """The typed tables of a data directory, parsed and written once per application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _tables:
        _tables[at] = nested.Tables.write(table(spark, d, "grants_raw"), "raw_id", "fmt", "payload", scratch_path(spark, "grants"))
    return _tables[at]


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    return grant_tables(spark, d).supertype().groupBy("kind", "variant").agg(F.count("*").alias("n_elements"))


def p6_rejected(spark: SparkSession, d: str) -> DataFrame:
    return nested.rejected(table(spark, d, "grants_raw"), "raw_id", "fmt", "payload")


def _of_kind(kind: str):
    return lambda spark, d: grant_tables(spark, d).of_kind(kind)


def _typed(kind: str, variant: str):
    return lambda spark, d: grant_tables(spark, d).typed(kind, variant)


P2_CASES = """
    SELECT DISTINCT ref_table, strftime(seen, '%Y-%m') AS period, ref_id, missing_id FROM (
        SELECT 'patents' AS ref_table, loaded_at AS seen, doc_id AS ref_id, unnest(cites) AS missing_id FROM patents
        UNION ALL SELECT 'citations', recorded_at, src, CASE WHEN regexp_full_match(n, '[0-9]+') THEN try_cast(n AS bigint) END
        FROM (SELECT *, regexp_replace(regexp_replace(doc_number, '[ ,]', '', 'g'), '^US', '') AS n FROM citations
              WHERE country = 'US' AND kind IN ('B1', 'B2') AND cited_date > 20110000 AND cited_date < 20160000) c
        UNION ALL SELECT 'doc_map', mapped_at, doc_id, doc_id FROM doc_map
        UNION ALL SELECT 'postings', indexed_at, doc_id, doc_id FROM postings) r
    LEFT JOIN (SELECT doc_id AS k, min(loaded_at) AS there FROM patents WHERE doc_id IS NOT NULL GROUP BY doc_id) p ON p.k = missing_id
    LEFT JOIN (SELECT doc_id AS g, min(removed_at) AS gone FROM doc_map WHERE removed_at IS NOT NULL GROUP BY doc_id) m ON m.g = missing_id
    WHERE missing_id > 0 AND seen IS NOT NULL AND (there IS NULL OR there > seen OR gone <= seen)"""

QUERIES: dict = {
    **engine_queries.QUERIES,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p6_found": p6_found,
    "p6_variants": p6_variants,
    "p6_rejected": p6_rejected,
    **{f"p6_{kind}": _of_kind(kind) for kind in nested.KINDS},
    "p6_patent_citations": _typed("citation", nested.PATENT),
    "p6_other_citations": _typed("citation", nested.OTHER),
    "p6_dated_ids": _typed("document_id", nested.DATED),
    "p6_undated_ids": _typed("document_id", nested.UNDATED),
}
SQL: dict[str, str] = {
    **engine_queries.SQL,
    **nested_sql.SQL,
    "p2_found": P2_CASES,
    "p2_report": "SELECT ref_table, period, count(*) AS n_references, count(DISTINCT missing_id) AS n_missing FROM ("
    + P2_CASES
    + ") GROUP BY ref_table, period",
}
