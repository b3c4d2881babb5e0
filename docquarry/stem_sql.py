"""The stemmer's steps as a chain of SQL tables, one per step; the tests and the driver compare it with the operator."""

from __future__ import annotations

from docquarry.functions import stemmer

_V = "aeiouy"
_SHORT = f"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _map(pairs: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in pairs.items())}}}"


def _longest(words) -> str:
    """The longest of some suffixes that a word ends in, or null."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    return f"list_filter({_list(ordered)}, lambda x: ends_with(w, x))[1]"


def _region(text: str) -> str:
    return f"len(regexp_extract({text}, '^.*?[{_V}][^{_V}]'))"


_CUT = "left(w, len(w) - len(s))"
_MARKED = f"array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN substr(t, i, 1) = 'y' AND (i = 1 OR contains('{_V}', substr(t, i - 1, 1))) THEN 'Y' ELSE substr(t, i, 1) END), '')"
_FIXED = _map({**stemmer.EXCEPTIONS})

#: Each table has t, w (the word so far), r1 and r2; done says that a word takes no further step.
_STEPS = [
    f"m0 AS (SELECT t, {_MARKED} AS w FROM words)",
    f"m1 AS (SELECT t, w, CASE WHEN starts_with(w, 'gener') OR starts_with(w, 'arsen') THEN 5 WHEN starts_with(w, 'commun') THEN 6 WHEN {_region('w')} > 0 THEN {_region('w')} ELSE len(w) END AS r1 FROM m0)",
    f"m2 AS (SELECT t, w, r1, CASE WHEN {_region('substr(w, r1 + 1)')} > 0 THEN r1 + {_region('substr(w, r1 + 1)')} ELSE len(w) END AS r2 FROM m1)",
    f"""a1 AS (SELECT t, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, len(w) - 2) WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN left(w, len(w) - CASE WHEN len(w) > 4 THEN 2 ELSE 1 END)
        WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') AND regexp_matches(left(w, len(w) - 2), '[{_V}]') THEN left(w, len(w) - 1) ELSE w END AS w FROM m2)""",
    f"a2 AS (SELECT *, list_contains({_list(sorted(stemmer.INVARIANT_AFTER_1A))}, w) AS done FROM a1)",
    f"b1 AS (SELECT *, {_longest(['eedly', 'eed'])} AS e, {_longest(['ingly', 'edly', 'ing', 'ed'])} AS s FROM a2)",
    f"""b2 AS (SELECT t, r1, r2, done, CASE WHEN done THEN w WHEN e IS NOT NULL THEN CASE WHEN len(w) - len(e) >= r1 THEN left(w, len(w) - len(e)) || 'ee' ELSE w END
        WHEN s IS NOT NULL AND regexp_matches({_CUT}, '[{_V}]') THEN {_CUT} ELSE w END AS w, NOT done AND e IS NULL AND s IS NOT NULL AND regexp_matches({_CUT}, '[{_V}]') AS cut FROM b1)""",
    f"""b3 AS (SELECT t, r1, r2, done, CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '({'|'.join(stemmer.DOUBLES)})$') THEN left(w, len(w) - 1)
        WHEN r1 >= len(w) AND regexp_matches(w, '{_SHORT}') THEN w || 'e' ELSE w END AS w FROM b2)""",
    f"c1 AS (SELECT t, r1, r2, done, CASE WHEN NOT done AND len(w) > 2 AND regexp_matches(w, '[^{_V}][yY]$') THEN left(w, len(w) - 1) || 'i' ELSE w END AS w FROM b3)",
    f"d1 AS (SELECT *, {_longest([*stemmer.STEP2, 'ogi', 'li'])} AS s FROM c1)",
    f"""d2 AS (SELECT t, r1, r2, done, CASE WHEN done OR s IS NULL OR len(w) - len(s) < r1 THEN w WHEN s = 'ogi' THEN CASE WHEN ends_with({_CUT}, 'l') THEN left(w, len(w) - 1) ELSE w END
        WHEN s = 'li' THEN CASE WHEN regexp_matches({_CUT}, '[{stemmer.LI_ENDINGS}]$') THEN {_CUT} ELSE w END ELSE {_CUT} || {_map(stemmer.STEP2)}[s] END AS w FROM d1)""",
    f"e1 AS (SELECT *, {_longest([*stemmer.STEP3, 'ative'])} AS s FROM d2)",
    f"""e2 AS (SELECT t, r1, r2, done, CASE WHEN done OR s IS NULL OR len(w) - len(s) < r1 THEN w WHEN s = 'ative' THEN CASE WHEN len(w) - 5 >= r2 THEN {_CUT} ELSE w END
        ELSE {_CUT} || {_map(stemmer.STEP3)}[s] END AS w FROM e1)""",
    f"f1 AS (SELECT *, {_longest([*stemmer.STEP4, 'ion'])} AS s FROM e2)",
    f"f2 AS (SELECT t, r1, r2, done, CASE WHEN NOT done AND s IS NOT NULL AND len(w) - len(s) >= r2 AND (s <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN {_CUT} ELSE w END AS w FROM f1)",
    f"""g1 AS (SELECT t, CASE WHEN done THEN w WHEN ends_with(w, 'e') THEN CASE WHEN len(w) - 1 >= r2 OR len(w) - 1 >= r1 AND NOT regexp_matches(left(w, len(w) - 1), '{_SHORT}') THEN left(w, len(w) - 1) ELSE w END
        WHEN ends_with(w, 'll') AND len(w) - 1 >= r2 THEN left(w, len(w) - 1) ELSE w END AS w FROM f2)""",
    f"stems AS MATERIALIZED (SELECT t AS token, CASE WHEN len(t) <= 2 THEN t ELSE coalesce({_FIXED}[t], replace(w, 'Y', 'y')) END AS stem FROM g1)",
]


def stem_ctes(tokens: str) -> str:
    """CTEs ending in stems (token, stem) of the distinct tokens that a SELECT gives; tokens are of letters, hyphens and underscores."""
    return ", ".join([f"words AS MATERIALIZED (SELECT DISTINCT token AS t FROM ({tokens}))", *_STEPS])
