import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import spampages as S

NOUNS = "pump valve lever rotor housing gasket piston nozzle filter sensor".split()
WORDS = "buy cheap best online price sale shop deal free discount review quote".split()


def prose(rng, n):
    forms = [
        "The {} is mounted on the {} of the {}.", "A {} is connected to the {} by a {}.", "When the {} is closed, the {} returns to the {}.",
        "It has been found that the {} of the {} is held by the {}.", "In use, the {} presses a {} against the {}.",
    ]
    return " ".join(rng.choice(forms).format(*rng.choices(NOUNS, k=3)) for _ in range(n))


def spam(rng, kind):
    pair = lambda: f"{rng.choice(WORDS)} {rng.choice(NOUNS[:4])}"
    return {
        "urls": lambda: "\n".join(f"http://{rng.choice(NOUNS)}{rng.randint(1, 99)}.example/{rng.randint(1, 9999)}" for _ in range(20)),
        "anchors": lambda: " ".join(f'<a href="http://{rng.choice(NOUNS)}.test">{pair()}</a>' for _ in range(15)),
        "markdown": lambda: " ".join(f"[{pair()}](http://{rng.choice(NOUNS)}.test/{k})" for k in range(15)),
        "bullets": lambda: "\n".join(f"* {pair()} - www.{rng.choice(NOUNS)}.test/p{k}" for k in range(15)),
        "tags": lambda: "\n".join(f"ABC-{rng.randint(1, 9999)} {rng.choice(NOUNS)} [{rng.choice(WORDS)}] {rng.randint(1, 99)}.99" for _ in range(15)),
        "hash": lambda: " ".join(f"#{rng.choice(WORDS)}{rng.choice(NOUNS)}" for _ in range(30)),
        "words": lambda: ", ".join(pair() for _ in range(40)),
        "fake": lambda: " ".join(f"{pair().capitalize()} {pair()}, {pair()}." for _ in range(15)),
        "lines": lambda: "\n".join(pair().title() for _ in range(40)),
    }[kind]()


KINDS = ["urls", "anchors", "markdown", "bullets", "tags", "hash", "words", "fake", "lines"]


def made(seed=3):
    rng = random.Random(seed)
    rows, cases = [], set()
    for _ in range(300):
        rows.append((len(rows), prose(rng, rng.randint(3, 20)), "en", "description"))
    for kind in KINDS * 3:
        text = spam(rng, kind)
        if rng.random() < 0.5:
            text = f"{prose(rng, 1)}\n{text}\n{prose(rng, 1)}"
        cases.add(len(rows))
        rows.append((len(rows), text, rng.choice(["en", "EN", None, "xx"]), "page"))
    for kind in KINDS:  # running text with a short list beside it
        rows.append((len(rows), prose(rng, 30) + "\n" + spam(rng, kind)[:200], "en", "page"))
    refs = "\n".join(f"[{k}] Smith, {rng.choice(NOUNS)}, https://x.example/{k}" for k in range(1, 9))
    rows += [(len(rows), prose(rng, 4) + "\n" + refs, "en", "page"), (len(rows) + 1, "Pump Valve And Pump Rotor", "en", "title"), (len(rows) + 2, "", "en", None)]
    rows += [(len(rows), None, None, None), (None, spam(rng, "words"), "en", "page"), (5, rows[5][1], "en", "page")]
    return rows, cases


def test_found(spark):
    rows, cases = made()
    df = spark.createDataFrame(rows, "id long, body string, lang string, zone string").withColumns({"key": F.lit(1), "row": F.lit(2), "text": F.lit("x"), "size": F.lit(0)})
    got = S.spam_pages(df, "id", "body", "lang", F.col("zone") == "description")
    found = [r["id"] for r in got.collect()]
    assert set(found) == cases | {None} and len(found) == len(cases) + 1


def test_numbered_lines(spark):
    """Numbered key words and numbered links are cases; numbered claims and references beside running text are none."""
    rng = random.Random(5)
    pair = lambda: f"{rng.choice(WORDS)} {rng.choice(NOUNS[:4])}"
    rows = [(k, prose(rng, rng.randint(3, 20)), "en", "description") for k in range(300)]
    cases = [
        "\n".join(f"{k}. {pair()} {rng.choice(WORDS)}" for k in range(1, 21)),
        "\n".join(f"[{k}] {pair()}, {pair()}, {pair()}, {pair()}, {pair()}." for k in range(1, 11)),
        "\n".join(f"{k}. {rng.choice(NOUNS).title()} shop - https://{rng.choice(NOUNS)}.example/{k}" for k in range(1, 16)),
        "\n".join(f"[{k}] Smith, {rng.choice(NOUNS)}, https://x.example/{k}" for k in range(1, 16)),
    ]
    claims = [f"{k}. The {a} of claim {k - 1}, wherein said {b} holds said {a}." for k, (a, b) in enumerate((rng.choices(NOUNS[:3], k=2) for _ in range(9)), 2)]
    refs = "\n".join(f"[{k}] Smith, {rng.choice(NOUNS)}, https://x.example/{k}" for k in range(1, 9))
    parts = "\n".join(f"{k} {rng.choice(NOUNS)}" for k in range(10, 26, 2))
    others = ["\n".join(claims), prose(rng, 4) + "\n" + refs, prose(rng, 8) + "\n" + parts]
    rows += [(1000 + k, t, "en", "page") for k, t in enumerate(cases)] + [(2000 + k, t, "en", "page") for k, t in enumerate(others)]
    df = spark.createDataFrame(rows, "id long, body string, lang string, zone string")
    got = S.spam_pages(df, "id", "body", "lang", F.col("zone") == "description")
    assert sorted(r["id"] for r in got.collect()) == [1000, 1001, 1002, 1003]


def test_spam_zoned_as_prose(spark):
    """Neither copies of a page nor different pages of a wrongly zoned source become prose to compare with."""
    rng = random.Random(8)
    texts = [(k, prose(rng, rng.randint(3, 20)), "en", "description") for k in range(300)]
    page = spam(rng, "words")
    copies = [(1000 + k, page, "en", "description") for k in range(60)]
    others = [(2000 + k, spam(rng, "words"), "en", "description") for k in range(60)]
    for more in (copies, others):
        df = spark.createDataFrame(texts + more, "id long, body string, lang string, zone string")
        got = S.spam_pages(df, "id", "body", "lang", F.col("zone") == "description")
        assert sorted(r["id"] for r in got.collect()) == [r[0] for r in more]


def foreign(text):
    """The text in a made-up language: every word spelt backwards."""
    return " ".join(w[::-1] for w in text.split(" "))


def shifted(text):
    """The text in another: vowels exchanged."""
    return text.lower().translate(str.maketrans("aeiou", "ouaie"))


@pytest.fixture(scope="module")
def three_languages(spark):
    """Honest and spam pages of three languages, some of them zoned as prose, some with another language's code or none."""
    rng = random.Random(13)
    rows = []
    for lang, turn, n in (("en", str, 200), ("ne", foreign, 90), ("up", shifted, 60)):
        rows += [(turn(prose(rng, rng.randint(3, 20))), lang, "description") for _ in range(n)]
        rows += [(turn(spam(rng, kind)), lang, "description") for kind in ("words", "fake", "lines") for _ in range(4)]
        rows += [(turn(prose(rng, 6)) + "\n" + turn(spam(rng, "words")), code, "page") for code in (lang, "en", None)]
        rows += [(turn(prose(rng, rng.randint(3, 20))), code, "page") for code in (lang, "ne", None) for _ in range(8)]
    rows += [rows[0], rows[205], rows[230]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, body string, lang string, zone string").cache()
    return df, _shares_of(df)


def _shares_of(df):
    got = S.spam_pages(df, "id", "body", "lang", F.col("zone") == "description").collect()
    return sorted((r["id"], round(r["share"], 12)) for r in got)


@pytest.mark.parametrize("most_pairs, most_languages", [(0, 1), (40, 10_000), (8_000_000, 1), (150, 2)])
def test_pairs_and_languages_beyond_those_sent(three_languages, monkeypatch, most_pairs, most_languages):
    """What is sent to the workers changes no result: pairs and languages beyond it are joined."""
    df, expected = three_languages
    assert len(expected) >= 36
    monkeypatch.setattr(S, "MOST_PAIRS", most_pairs)
    monkeypatch.setattr(S, "MOST_LANGUAGES", most_languages)
    assert _shares_of(df) == expected


@pytest.mark.parametrize("most_pairs, most_languages", [(0, 1), (60, 2)])
def test_spam_in_prose_beyond_what_is_sent(three_languages, monkeypatch, most_pairs, most_languages):
    df, _ = three_languages
    rows = df.select(F.xxhash64("body").alias("row"), (F.col("zone") == "description").alias("prose"), S.language(F.col("lang")).alias("lang"), F.col("body").alias("text"))
    told = S.prose_texts(rows).cache()
    counts = S.pair_counts(told).cache()
    of = lambda: sorted(tuple(r) for r in S.spam_in_prose(told, counts).collect())
    expected = of()
    assert {lang for lang, _, _ in expected} == {"en", "ne", "up"}
    monkeypatch.setattr(S, "MOST_PAIRS", most_pairs)
    monkeypatch.setattr(S, "MOST_LANGUAGES", most_languages)
    assert of() == expected


def test_likeness_against_plain_counting(spark):
    """Likeness and language by sets of pairs, whichever part of them is joined."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c d e f".split(), k=rng.randint(1, 12))) for _ in range(60)]
    langs = [rng.choice(["x", "y", "", "zz"]) for _ in texts]
    term = lambda w: int(S.terms(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])
    code = {w: term(w) for w in "abcdef"}
    two = lambda v, w: int(S.pairs(np.zeros(2, int), np.array([code[v], code[w]], np.uint64), np.array([0, 2]), np.array([1, 3]), np.zeros(2, bool))[0].view(np.int64)[0])
    common = {lang: set(rng.sample([(v, w) for v in "abcdef" for w in "abcdef"], k)) for lang, k in (("x", 4), ("y", 12), ("w", 9))}
    expected = []
    for t, lang in zip(texts, langs):
        of = list(zip(t.split(), t.split()[1:]))
        like = {name: sum(p in held for p in of) / max(len(of), 1) for name, held in common.items()}
        mine, best = like.get(lang, 0.0), lang
        if mine < S.UNLIKE or lang == "":
            for name in sorted(like):
                if like[name] > mine:
                    mine, best = like[name], name
        expected.append((best, mine))
    entries = [(lang, two(*p)) for lang in common for p in sorted(common[lang])]
    df = spark.createDataFrame([(k, k, False, lang, t) for k, (t, lang) in enumerate(zip(texts, langs))], "key long, row long, prose boolean, lang string, text string")
    for cut in (0, 10, 36):
        terms = {t for _, t in entries[:cut]}
        sent, unsent = [e for e in entries if e[1] in terms], [e for e in entries if e[1] not in terms]
        names = sorted(common)
        profile = spark.sparkContext.broadcast(S._Profile(names, [names.index(lang) for lang, _ in sent], [t for _, t in sent]))
        rest = S.rest_pairs(df, profile, spark.createDataFrame(unsent, "lang string, term long") if unsent else None)
        got = {r["key"]: (r["lang"], r["likeness"]) for r in S.curve_features(df, profile, "bigint", rest).collect()}
        assert [got[k] for k in range(len(texts))] == expected


def test_without_prose_and_empty(spark):
    df = spark.createDataFrame([(1, spam(random.Random(1), "words"), "en"), (2, None, None)], "id long, body string, lang string")
    assert [r["id"] for r in S.spam_pages(df, "id", "body", "lang", F.lit(None).cast("boolean")).collect()] == [1]
    assert S.spam_pages(df.limit(0), "id", "body", "lang", F.lit(True)).count() == 0


def test_terms_against_plain_splitting():
    texts = ["The Pump, the pump.", "", "日本 go", "éÉ a1b"]
    data = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    text, term, a, b, thai, starts = S.terms(np.frombuffer(data, np.uint8), off)
    whole = "".join(texts)
    assert [whole[x:y].lower() for x, y in zip(a, b)] == ["the", "pump", "the", "pump", "日", "本", "go", "éé", "a", "b"]
    assert text.tolist() == [0, 0, 0, 0, 2, 2, 2, 3, 3, 3] and term[0] == term[2] and term[1] == term[3] and len(set(term.tolist())) == 8


def test_curve(spark):
    """The fitted line equals a direct fit over every term's rank, ranks of equal frequencies averaged."""
    text = "a " * 8 + "b " * 4 + "c " * 4 + "d " * 2 + "e f g"
    df = spark.createDataFrame([(1, 9, False, "en", text)], "key long, row long, prose boolean, lang string, text string")
    r = S.curve_features(df, spark.sparkContext.broadcast(S._Profile([])), "bigint").first()
    freq = np.array([8, 4, 4, 2, 1, 1, 1])
    rank = np.array([1, 2.5, 2.5, 4, 6, 6, 6])
    slope, _ = np.polyfit(np.log(rank), np.log(freq), 1)
    assert abs(r["slope"] - slope) < 1e-9 and r["n_terms"] == 21
