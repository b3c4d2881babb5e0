"""Unrestricted Damerau-Levenshtein distance with weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def damerau_levenshtein(a: str, b: str, delete: int = 1, insert: int = 1, replace: int = 1, swap: int = 1) -> int:
    """Least total cost of turning a into b by deletions, insertions, replacements and swaps of neighbours, between
    which other edits may lie. Needs 2 * swap >= insert + delete."""
    if 2 * swap < insert + delete:
        raise ValueError("2 * swap must be at least insert + delete")
    far = (len(a) + len(b) + 1) * max(delete, insert, replace, swap)
    width = len(b) + 2
    # row and column 0 are a border of far values; cost[i + 1][j + 1] is the cost for a[:i] and b[:j]
    cost = [[far] * width, [far, *(j * insert for j in range(width - 1))]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row = [far, i * delete]
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            row.append(
                min(
                    cost[i][j] + (0 if x == y else replace),
                    row[j] + insert,
                    cost[i][j + 1] + delete,
                    cost[k][m] + (i - k - 1) * delete + swap + (j - m - 1) * insert,
                )
            )
        seen[x] = i
        cost.append(row)
    return cost[len(a) + 1][len(b) + 1]


@F.pandas_udf(T.IntegerType())
def distance_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau_levenshtein(x, y) for x, y in zip(a, b)], dtype="Int32")
