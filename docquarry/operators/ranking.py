"""Ranking: coordination level, smoothed query likelihood, top k; and most recent first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.index import Index
from docquarry.operators.matching import Hits
from docquarry.schemas import ZONES
from docquarry.session import materialize

#: Jelinek-Mercer's weight of the collection, and the factor of tokens that feedback added.
LAMBDA = 0.2
FEEDBACK_FACTOR = 0.25


def coordination(per_doc: DataFrame, k: int) -> DataFrame:
    """The rows (doc_id, n_tokens, ...) by falling number of matched tokens, whole levels of it until there are k.

    The level is found on the counts per level, of which there are at most as many as tokens matched, so no window
    runs over all documents. A negative k keeps all.
    """
    if k < 0:
        return per_doc
    levels = per_doc.groupBy("n_tokens").agg(F.count("*").alias("n"))
    more = F.sum("n").over(Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1))
    enough = levels.withColumn("more", F.coalesce(more, F.lit(0))).filter(F.col("more") < k).agg(F.min("n_tokens").alias("level"))
    return per_doc.join(F.broadcast(enough), F.col("n_tokens") >= F.col("level")).drop("level")  # one row


def matched(cells: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): the number of distinct tokens matched by each document."""
    return cells.select("doc_id", "token").distinct().groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def score(index: Index, hits: Hits, k: int, original: list[str] | None = None, nan_empty_zone: bool = False) -> DataFrame:
    """(doc_id, score) of the candidates and the linking documents.

    score = sum over zones w(z) * sum over matched tokens ln(f * (0.8 * tf / len + 0.2 * cf / C)), over all tokens of the
    result, also those a document lacks. What tokens contribute with tf = 0 is the same for every document, so it is
    computed once and only the cells that exist are used: the plan grows with the matches, not with documents times tokens.
    original: tokens of the first round, the others weighing less. nan_empty_zone: a document with an empty zone scores NaN.
    """
    c = float(index.size())
    cells = hits.cells
    factor = F.lit(1.0) if original is None else F.when(F.col("token").isin(original), 1.0).otherwise(FEEDBACK_FACTOR)
    terms = index.lexicon.join(cells.select("token").distinct(), "token", "left_semi").select("token", "cf")
    terms = terms.select("token", (factor * LAMBDA * F.col("cf") / F.lit(c)).alias("smooth"), factor.alias("f"))
    base = terms.agg(F.coalesce(F.sum(F.log("smooth")), F.lit(0.0)).alias("base")).select((F.col("base") * sum(ZONES.values())).alias("base"))
    weights = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.col("ct")]
    ml = F.when(F.col("len") > 0, F.col("f") * (1 - LAMBDA) * F.col("tf") / F.col("len")).otherwise(0.0)
    gain = weights * (F.log(ml + F.col("smooth")) - F.log("smooth"))
    rows = cells.select("token", "doc_id", "ct", "tf", "len").join(terms, "token")
    per_token = rows.groupBy("doc_id", "token").agg(F.sum(gain).alias("gain"))
    per_doc = per_token.groupBy("doc_id").agg(F.sum("gain").alias("gain"), F.count("*").alias("n_tokens"))
    docs = coordination(per_doc, k).select("doc_id", "gain").unionByName(hits.links.select("doc_id", F.lit(0.0).alias("gain")))
    docs = docs.groupBy("doc_id").agg(F.max("gain").alias("gain"))  # gains are never negative
    # only the candidates that remain meet the document map
    out = docs.join(index.doc_map.select("doc_id"), "doc_id", "left_semi").join(F.broadcast(base), F.lit(True))  # base: one row
    total = F.col("gain") + F.col("base")
    if nan_empty_zone:
        empty = index.doc_len.groupBy("doc_id").agg((F.min("len") == 0).alias("empty"))
        out = out.join(empty, "doc_id", "left")
        total = F.when(F.col("empty"), F.lit(float("nan"))).otherwise(total)
    return out.select("doc_id", total.alias("score"))


def _ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """(rank int, doc_id, score) of the first k rows in an order, or of all if k is negative.

    All rows are numbered without gathering them: they are range-partitioned by the order, numbered within their ranges, and
    the sizes of the ranges before are added.
    """
    if k >= 0:
        best = rows.orderBy(*order).limit(k)
        return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "doc_id", "score")
    spread = materialize(rows.repartitionByRange(*order).select("doc_id", "score", F.spark_partition_id().alias("range")), "ranked")
    sizes = spread.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("before"))  # a row per partition
    at = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    return spread.join(F.broadcast(sizes), "range").select(at.cast("int").alias("rank"), "doc_id", "score")


def top(scored: DataFrame, k: int) -> DataFrame:
    """(rank int, doc_id, score): the k best, ties by document number; a negative k keeps all."""
    return _ranked(scored, [F.desc("score"), F.asc("doc_id")], k)


def most_recent(index: Index, hits: Hits, k: int) -> DataFrame:
    """(rank int, doc_id, score null): the k documents with the greatest numbers."""
    docs = hits.docs().join(index.doc_map.select("doc_id"), "doc_id", "left_semi")
    return _ranked(docs.withColumn("score", F.lit(None).cast("double")), [F.desc("doc_id")], k)
