"""NDCG of a ranking against a gold ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gain(rank: Column) -> Column:
    """1 + floor(10 * 0.5 ^ (0.1 * rank)) of a gold rank, 0 without one."""
    return F.when(rank > 0, 1 + F.floor(10 * F.pow(F.lit(0.5), 0.1 * rank))).otherwise(0)


def dcg(ranked: DataFrame, gains: str, p: int) -> DataFrame:
    """(dcg): the first gain plus the later ones over the logarithm of their rank, up to rank p."""
    part = F.col(gains) / F.when(F.col("rank") > 1, F.log2("rank")).otherwise(1.0)
    return ranked.filter(F.col("rank") <= p).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("dcg"))


def ndcg(gold: DataFrame, results: DataFrame, p: int) -> DataFrame:
    """(ndcg double) of rankings (rank int, doc_id), ranks from 1; null without gold. Results unknown to gold gain nothing."""
    told = results.join(gold.select("doc_id", F.col("rank").alias("gold")), "doc_id", "left")
    actual = dcg(told.withColumn("g", F.coalesce(gain(F.col("gold")), F.lit(0))), "g", p)
    ideal = dcg(gold.withColumn("g", gain(F.col("rank"))), "g", p).withColumnRenamed("dcg", "ideal")
    return actual.join(ideal, F.lit(True)).select(F.expr("CASE WHEN ideal > 0 THEN dcg / ideal END").alias("ndcg"))
