"""Token column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of these characters, of two or more.
TOKEN_PATTERN = "[a-zA-Z_-]{2,}"


def tokens(text: str | Column) -> Column:
    """Lower-cased tokens of a text in order; null for a null text.

    A run of fewer than two characters is no match, so the length filter is in the pattern. Only the
    ASCII matches are lower-cased: lower-casing the text first would turn other letters into ASCII.
    """
    col = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


#: The same in DuckDB's SQL.
def tokens_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{TOKEN_PATTERN}'), lambda x: lower(x))"
