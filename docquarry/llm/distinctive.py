"""Problem 3: how distinctive a term is of a record, by log-entropy weighting.

Two aggregations give everything: one per (record, term) with the local frequency, one per term with
the spread. With p = tf / gf over the records that hold the term and N records in all,

    score = ln(1 + tf) * (1 - H / ln N),   H = -sum p ln p = ln gf - (sum tf ln tf) / gf

so the term aggregate needs only sums of tf and tf ln tf and is combined before the shuffle. Terms
of a large share of all records are few (their number times that share is at most the mean
number of distinct terms of a record); at most HOT_TERMS of them, those in most records, are joined by broadcast, the others by a shuffle. What
is left for the shuffle has no hot term: a term there is in at most HOT_SHARE of the records, or there are HOT_TERMS terms in more records
than it, so that it has at most 1 / HOT_TERMS of all rows.

Defined results: rows with a null key are left out; the rows of one key are one record, whose local
frequency is that of the row holding the term most often; null and empty texts hold no terms; with
one record in all the weight is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import materialize

#: Terms in more than this share of the records are joined by broadcast, HOT_TERMS of them at most.
HOT_SHARE = 1 / 64
HOT_TERMS = 100_000


def local_frequencies(df: DataFrame, key: str, row: str, terms: Column) -> DataFrame:
    """(key, term, tf): the frequency of a term in the row of the record that holds it most often."""
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(row).alias("row"), F.explode(terms).alias("term")
    )
    per_row = rows.filter(F.col("term").isNotNull()).groupBy("key", "row", "term").agg(F.count("*").alias("tf"))
    return per_row.groupBy("key", "term").agg(F.max("tf").alias("tf"))


def term_weights(local: DataFrame, n_records: int) -> DataFrame:
    """(term, records, gf, weight): 1 less the normalised entropy of the term's spread over the records."""
    w = local.groupBy("term").agg(
        F.count("*").alias("records"),
        F.sum("tf").alias("gf"),
        F.sum(F.col("tf") * F.log(F.col("tf"))).alias("tlt"),
    )
    entropy = F.log(F.col("gf")) - F.col("tlt") / F.col("gf")
    weight = F.lit(1.0) - entropy / F.lit(float(_ln(n_records))) if n_records > 1 else F.lit(0.0)
    return w.select("term", "records", "gf", weight.alias("weight"))


def _ln(n: int) -> float:
    from math import log

    return log(n)


def scores(df: DataFrame, key: str, row: str, terms: Column) -> DataFrame:
    """(key, term, tf, records, score) for every record and term."""
    n = df.select(key).where(F.col(key).isNotNull()).distinct().count()
    local = materialize(local_frequencies(df, key, row, terms), "local-frequencies")
    weights = materialize(term_weights(local, n), "term-weights")
    score = (F.log1p(F.col("tf")) * F.col("weight")).alias("score")
    cols = [F.col("key").alias(key), "term", "tf", "records", score]
    bound = hot_bound(weights, n)
    hot = weights.filter(F.col("records") > bound).select("term", "records", "weight")
    rest = weights.filter(F.col("records") <= bound).select("term", "records", "weight")
    split = local.join(F.broadcast(hot), "term", "left")  # at most HOT_TERMS rows
    cold = split.filter(F.col("records").isNull()).select("key", "term", "tf").join(rest, "term")
    return split.filter(F.col("records").isNotNull()).select(*cols).unionByName(cold.select(*cols))


def hot_bound(weights: DataFrame, n: int, share: float = HOT_SHARE, most: int = HOT_TERMS) -> float:
    """The least number of records, share * n or more, that at most so many terms exceed."""
    levels = weights.filter(F.col("records") > share * n).groupBy("records").count()
    total = 0
    for r in levels.orderBy(F.desc("records")).limit(most + 1).collect():  # a level holds a term or more, so these suffice
        total += r["count"]
        if total > most:
            return r["records"]
    return share * n
