"""Pseudo-relevance feedback: terms of the best documents' snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.snippets import snippet_column
from docquarry.functions.text import tokens

#: Fixed value: terms added to a query.
TERMS = 10


def grouped_hits(cells: DataFrame, docs: DataFrame, zone: str, name: str) -> DataFrame:
    """(doc_id, <name> array of (token, positions)) of the matches in a zone of some documents, at most the k ranked."""
    rows = cells.filter(F.col("ct") == zone).join(docs.select("doc_id"), "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token", "positions"))).alias(name))


def snippets(ranked: DataFrame, cells: DataFrame, contents: DataFrame) -> DataFrame:
    """(rank, doc_id, score, title, abstract, snippet, tokens) of ranked documents; those without contents have an empty snippet."""
    hits = grouped_hits(cells, ranked, "Abstract", "hits")
    rows = ranked.join(contents, "doc_id", "left").join(hits, "doc_id", "left").withColumn("s", snippet_column("abstract", "hits"))
    return rows.select("rank", "doc_id", "score", "title", "abstract", F.col("s.text").alias("snippet"), F.col("s.tokens").alias("tokens"))


def frequent_terms(texts: DataFrame, column: str, stop_words: frozenset[str], n: int = TERMS, order: str = "desc") -> DataFrame:
    """(token, n bigint): the most (or least, with asc) frequent tokens of texts without stop words, ties by token."""
    rows = texts.select(F.explode(tokens(column)).alias("token"))
    if stop_words:
        rows = rows.filter(~F.col("token").isin(sorted(stop_words)))
    counts = rows.groupBy("token").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n") if order == "desc" else F.asc("n"), "token").limit(n)
