"""Syntax tree to a plan over the index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from docquarry.functions.stemmer import stem
from docquarry.operators import matching, spelling
from docquarry.operators.index import Index
from docquarry.operators.matching import Hits
from docquarry.plans.ast import Boolean, Keyword, LinkTo, Mixed, Phrase, Query


@dataclass(frozen=True)
class Options:
    """Choices of semantics; the defaults are the engine's own."""

    correct_spelling: bool = True
    strict_and: bool = False
    strict_phrase: bool = False
    nan_empty_zone: bool = False
    prf_order: str = "desc"


def resolve(index: Index, tokens: tuple[str, ...], options: Options) -> tuple[list[str], dict[str, str]]:
    """Index tokens of query tokens: stemmed unless they end in *, and corrected once if the index has none of them.

    The second value maps a correction to what it replaced; of two the last stays. One small job looks the
    query's tokens up in the lexicon, and one more runs per unknown token.
    """
    wanted = [t if t.endswith("*") or not index.stemmed else stem(t) for t in tokens]
    changes: dict[str, str] = {}
    if options.correct_spelling:
        plain = [t for t in wanted if not t.endswith("*")]
        known = {r["token"] for r in index.lexicon.filter(F.col("token").isin(plain)).select("token").collect()} if plain else set()
        for k, t in enumerate(wanted):
            if not t.endswith("*") and t not in known:
                better = spelling.correct(index.lexicon, t)
                if better is not None:
                    changes[better] = t
                    wanted[k] = better
    return wanted, changes


def compile_query(query: Query, index: Index, options: Options = Options()) -> Hits:
    """The unranked result of a query."""
    match query:
        case Keyword(tokens=tokens):
            found, changes = resolve(index, tokens, options)
            hits = matching.match_tokens(index, found)
            hits.corrections = changes
            return hits
        case Phrase(tokens=tokens):
            found, changes = resolve(index, tokens, options)
            hits = matching.match_phrase(index, found, options.strict_phrase)
            hits.corrections = changes
            return hits
        case LinkTo(doc_id=doc_id):
            return matching.match_link(index, doc_id)
        case Mixed(phrase=phrase, keyword=keyword):
            return matching.union(compile_query(phrase, index, options), compile_query(keyword, index, options))
        case Boolean(left=left, op=op, right=right):
            a, b = compile_query(left, index, options), compile_query(right, index, options)
            if op == "AND":
                return matching.both(a, b, options.strict_and)
            return matching.union(a, b) if op == "OR" else matching.without(a, b)
    raise TypeError(f"no query: {query!r}")
