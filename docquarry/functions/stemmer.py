"""The Porter2 (Snowball English) stemmer, as a Python function and as an Arrow-batched column function.

Applied to the distinct tokens of a corpus, never to every occurrence.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V = "aeiouy"
#: Fixed values of the published algorithm: exceptions, suffix tables.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"

_BY_LENGTH2 = sorted([*STEP2, "ogi", "li"], key=len, reverse=True)
_BY_LENGTH3 = sorted([*STEP3, "ative"], key=len, reverse=True)
_BY_LENGTH4 = sorted([*STEP4, "ion"], key=len, reverse=True)


def _regions(word: str) -> tuple[int, int]:
    """Starts of the regions R1 and R2."""
    r1 = len(word)
    for head in ("gener", "commun", "arsen"):
        if word.startswith(head):
            r1 = len(head)
            break
    else:
        m = re.search(f"[{_V}][^{_V}]", word)
        if m:
            r1 = m.end()
    m = re.search(f"[{_V}][^{_V}]", word[r1:])
    return r1, r1 + m.end() if m else len(word)


def _short_syllable_end(word: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$", word))


def _ends(word: str, suffixes) -> str | None:
    return next((s for s in suffixes if word.endswith(s)), None)


def _step1a(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")):
        return w
    if w.endswith("s") and re.search(f"[{_V}]", w[:-2]):
        return w[:-1]
    return w


def _step1b(w: str, r1: int) -> str:
    s = _ends(w, ("eedly", "eed"))
    if s:
        return w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    s = _ends(w, ("ingly", "edly", "ing", "ed"))
    if not s or not re.search(f"[{_V}]", w[: -len(s)]):
        return w
    w = w[: -len(s)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _short_syllable_end(w) else w


@lru_cache(200_000)
def stem(token: str) -> str:
    """The stem of a lower-case token; tokens of one or two letters stay."""
    if len(token) <= 2:
        return token
    w = token[1:] if token[0] == "'" else token
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(f"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    w = _step1a(w)
    if w in INVARIANT_AFTER_1A:
        return w
    w = _step1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    s = _ends(w, _BY_LENGTH2)
    if s and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s == "ogi":
            w = w[:-1] if base.endswith("l") else w
        elif s == "li":
            w = base if base and base[-1] in LI_ENDINGS else w
        else:
            w = base + STEP2[s]
    s = _ends(w, _BY_LENGTH3)
    if s and len(w) - len(s) >= r1:
        if s == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(s)] + STEP3[s]
    s = _ends(w, _BY_LENGTH4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_column(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem, na_action="ignore")
