"""Algebra of posting cells (token, doc_id, ct, tf, len, positions): what a mutable table of postings offers, as DataFrames.

A cell of the table is a (token, document) with its zones. Nothing is changed in place: each function gives the cells after the step.
Nulls are no tokens and no documents, so they are never found; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.matching import latest


def put_all(cells: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of cells; where both hold a (token, document), all its zones are those of the second."""
    return latest(cells, more)


def remove(cells: DataFrame, token: str | None = None, doc_id: int | None = None) -> DataFrame:
    """The cells without a token, without a document, or without one token of one document. Without either, all stay."""
    gone = F.lit(token is not None or doc_id is not None)
    if token is not None:
        gone = gone & F.coalesce(F.col("token") == token, F.lit(False))
    if doc_id is not None:
        gone = gone & F.coalesce(F.col("doc_id") == doc_id, F.lit(False))
    return cells.filter(~gone)


def contains(cells: DataFrame, token: str | None = None, doc_id: int | None = None) -> bool:
    """Whether there is a posting of a token, of a document, or of both. One row is looked for."""
    found = cells
    if token is not None:
        found = found.filter(F.col("token") == token)
    if doc_id is not None:
        found = found.filter(F.col("doc_id") == doc_id)
    return not found.isEmpty()


def sizes(cells: DataFrame) -> DataFrame:
    """One row: (n_tokens, n_docs, n_cells, occurrences) of the table."""
    return cells.agg(
        F.countDistinct("token").alias("n_tokens"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.countDistinct("token", "doc_id").alias("n_cells"),
        F.coalesce(F.sum("tf"), F.lit(0)).alias("occurrences"),
    )


def token_sets(cells: DataFrame) -> DataFrame:
    """(doc_id, tokens): the set of each document's tokens, sorted. A set is as large as its document at most."""
    return cells.groupBy("doc_id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))


def document_range(docs: DataFrame) -> DataFrame:
    """One row: (first_id, last_id, n_docs) of the documents."""
    return docs.agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.countDistinct("doc_id").alias("n_docs"))
