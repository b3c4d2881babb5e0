"""Spelling correction against the lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.distance import distance_column

#: The largest difference of lengths, and the largest distance.
MAX_LENGTH_DIFFERENCE, MAX_DISTANCE = 2, 3


def candidates(lexicon: DataFrame, token: str) -> DataFrame:
    """(token, cf, distance) of tokens with the same first character, a like length and a small distance.

    The native filters prune the lexicon before the distance is computed, in Arrow batches. One of them is the distance without swaps, which is at most
    twice the other, as a swap is two replacements.
    """
    near = lexicon.filter(F.col("token").startswith(token[:1]) & (F.abs(F.length("token") - len(token)) <= MAX_LENGTH_DIFFERENCE))
    near = near.filter(F.levenshtein("token", F.lit(token), 2 * MAX_DISTANCE) >= 0)
    return near.select("token", "cf", distance_column("token", F.lit(token)).alias("distance")).filter(F.col("distance") <= MAX_DISTANCE)


def correction(lexicon: DataFrame, token: str) -> DataFrame:
    """(token, corrected, distance): the candidate nearest, then most frequent, then first; no row if there is none."""
    best = candidates(lexicon, token).agg(F.min(F.struct("distance", (-F.col("cf")).alias("o"), "token")).alias("b"))
    return best.filter("b IS NOT NULL").select(F.lit(token).alias("token"), F.col("b.token").alias("corrected"), F.col("b.distance").alias("distance"))


def correct(lexicon: DataFrame, token: str) -> str | None:
    row = correction(lexicon, token).first()
    return row["corrected"] if row else None
