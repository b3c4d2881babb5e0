import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.functions import snippets
from docquarry.functions.distance import damerau_levenshtein as dl
from docquarry.functions.stemmer import stem


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consignment", "consign"), ("consistency", "consist"),
        ("consolation", "consol"), ("consolatory", "consolatori"), ("knack", "knack"), ("knightly", "knight"), ("knives", "knive"),
        ("generate", "generat"), ("generic", "generic"), ("communism", "communism"), ("arsenal", "arsenal"), ("skies", "sky"), ("dying", "die"),
        ("hopping", "hop"), ("hoped", "hope"), ("luxuriated", "luxuri"), ("fitted", "fit"), ("ties", "tie"), ("cries", "cri"),
        ("gas", "gas"), ("gaps", "gap"), ("agreed", "agre"), ("relational", "relat"), ("conditional", "condit"), ("analogously", "analog"),
        ("sensibility", "sensibl"), ("happily", "happili"), ("by", "by"), ("youth", "youth"), ("boy", "boy"), ("news", "news"), ("exceed", "exceed"),
        ("adoption", "adopt"), ("electrical", "electr"), ("hopefulness", "hope"), ("controlled", "control"), ("rate", "rate"), ("cease", "ceas"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_distance():
    assert dl("ab", "ba") == 1 and dl("ca", "abc") == 2 and dl("", "abc") == 3 and dl("abc", "") == 3
    assert dl("edtoin", "edtion") == 1 and dl("abcd", "abcd") == 0
    with pytest.raises(ValueError):
        dl("a", "b", swap=0)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance_invariants(a, b):
    d = dl(a, b)
    assert d == dl(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def test_snippets():
    text = "A scanning laser device. The laser scans. A third sentence about tools. The last laser tool."
    assert snippets.sentences(text)[1] == "The laser scans."
    assert snippets.token_offsets(snippets.sentences(text)) == [0, 3, 6, 10]
    assert snippets.snippet(text, {}) == ("A scanning laser device.", [])
    got, words = snippets.snippet(text, {"laser": [1, 4, 12], "tool": [13]})
    assert got == "The last laser tool." and words == ["laser", "tool"]
    got, _ = snippets.snippet(text, {"scan": [0], "scans": [5], "tool": [13]})
    assert got == "A scanning laser device.The laser scans...The last laser tool."
    assert snippets.snippet(None, {"a": [0]}) == ("", []) and snippets.snippet("", {}) == ("", [])
    assert snippets.highlight("Laser lasers", ["laser"]) == "\033[32mLaser\033[39m lasers"
    assert snippets.formatted(7, None, [], None, {}) == "7"


def test_cover_ends():
    rng = random.Random(3)
    for _ in range(50):
        places = {k: {t: rng.randint(1, 3) for t in rng.sample("abcdef", rng.randint(1, 4))} for k in range(6)}
        chosen = snippets.cover(places)
        assert {t for k in chosen for t in places[k]} == {t for p in places.values() for t in p}


def test_stems_equal_the_sql_chain(duck):
    import random

    from docquarry.functions.stemmer import EXCEPTIONS, STEP2, STEP3, STEP4, stem
    from docquarry.stem_sql import stem_ctes

    rng = random.Random(7)
    ends = [*STEP2, *STEP3, *STEP4, "ogi", "li", "ative", "ion", "sses", "ied", "edly", "eedly", "ing", "y", "e", "ll", "us", ""]
    words = {"".join(rng.choices("aeiouybcdlmnrst", k=rng.randint(1, 6))) + rng.choice(ends) + rng.choice(["", "s", "ed"]) for _ in range(5000)} | set(EXCEPTIONS)
    words |= {head + end for head in ("gener", "commun", "arsen", "say-", "_x") for end in ends}
    rows = ", ".join(f"('{w}')" for w in sorted(words))
    got = dict(duck.sql(f"WITH v(token) AS (VALUES {rows}), {stem_ctes('SELECT token FROM v')} SELECT token, stem FROM stems").fetchall())
    assert got == {w: stem(w) for w in words}
