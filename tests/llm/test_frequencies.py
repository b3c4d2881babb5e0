import random

from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.llm import frequencies as Q
from docquarry.llm.distinctive import scores

WORDS = "alpha beta gamma delta omega Beta".split()


def made(rng, n):
    return [(rng.choice([None, *range(1, 25)]), rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(0, 8)))])) for _ in range(n)]


def counted(table):
    occ, recs = {}, {}
    for k, t in table:
        for w in (t or "").lower().split() if k is not None else ():
            occ[w] = occ.get(w, 0) + 1
            recs.setdefault(w, set()).add(k)
    return {w: (occ[w], len(recs[w])) for w in occ}


def test_deltas_follow_changes(spark):
    """Records are added, changed, deleted and repeated; the counts equal those of a fresh count after every step."""
    rng = random.Random(11)
    store = Q.CountStore(spark)
    versions = [made(rng, 60)]
    for _ in range(2):
        v = [x for x in versions[-1] if rng.random() > 0.2] + made(rng, 15)
        versions.append(v + rng.sample(v, 5))
    versions.append([])
    before = None
    for v in versions:
        now = spark.createDataFrame(v, "doc long, text string").withColumns({"term": F.lit("clash"), "key": F.lit(0)})
        store.apply("f", [(now, 1)] if before is None else Q.snapshot_changes(before, now, "doc", ["text"]), "doc", tokens("text"))
        store = Q.CountStore(spark, store.path)  # opened anew, as by a later application
        got = {r["term"]: (r["occurrences"], r["records"]) for r in store.counts("f").collect()}
        assert got == counted(v)
        assert store.records("f") == len({k for k, _ in v if k is not None})
        before = now


def test_only_changes_are_aggregated(spark):
    a = spark.createDataFrame([(1, "x y"), (2, "y z"), (2, "q")], "doc long, text string")
    b = spark.createDataFrame([(2, "q"), (2, "y z"), (3, "y y")], "doc long, text string")
    assert sorted(r["key"] for r in Q.changed_keys(a, b, "doc", ["text"]).collect()) == [1, 3]
    same = Q.signed_deltas(Q.snapshot_changes(a, a, "doc", ["text"]), "doc", tokens("text"))
    assert same.count() == 0


def test_arrivals_and_untouched_partitions(spark):
    """Rows that arrive for records already there; only partitions with a changed term are written again, and old ones go."""
    there = spark.createDataFrame([(1, "aa bb"), (1, "aa"), (2, "cc"), (None, "aa")], "doc long, text string")
    come = spark.createDataFrame([(1, "aa dd"), (3, "aa"), (3, None), (4, "")], "doc long, text string")
    store = Q.CountStore(spark, buckets=64)
    store.load("f", there, "doc", tokens("text"))
    first = store.manifest("f")["parts"]
    store.apply("f", Q.arrivals(there, come, "doc"), "doc", tokens("text"))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in store.counts("f").collect()}
    assert got == {"aa": (4, 2), "bb": (1, 1), "cc": (1, 1), "dd": (1, 1)} and store.records("f") == 4
    second = store.manifest("f")
    assert sum(v == 0 for v in second["parts"].values()) >= 2 and len(second["parts"]) >= len(first)
    store.apply("f", [(come.filter("doc = 3"), -1)], "doc", tokens("text"))
    store.apply("f", [(come.filter("doc = 4"), -1)], "doc", tokens("text"))
    assert store.records("f") == 2 and {r["term"]: r["occurrences"] for r in store.counts("f").collect()}["aa"] == 3
    from docquarry.session import list_path

    assert len(list_path(spark, f"{store.path}/f/manifests")) == Q.KEPT and store.fields() == ["f"]


def test_bands(spark):
    rows = [(d, "aa") for d in range(10)] + [(1, "bb"), (1, "bb"), (2, "bb"), *((d, "cc") for d in range(3)), *((d, "dd") for d in range(4)), (None, "ee")]
    store = Q.CountStore(spark)
    store.load("f", spark.createDataFrame(rows, "doc long, t string"), "doc", F.array("t"))
    got = {r["term"]: r["band"] for r in store.marked().collect()}
    assert got == {"aa": "common", "bb": "rare", "cc": None, "dd": "common"}


def test_scores(spark):
    from math import log

    rows = [(1, 1, "aa aa bb"), (2, 1, "aa"), (3, 2, "aa cc cc cc"), (4, 3, "aa"), (5, None, "aa zz"), (6, 4, None), (7, 5, "")]
    df = spark.createDataFrame(rows, "row long, doc long, text string").withColumns({"term": F.lit(1), "tf": F.lit(2)})
    got = {(r["doc"], r["term"]): r for r in scores(df, "doc", "row", tokens("text")).collect()}
    assert set(got) == {(1, "aa"), (1, "bb"), (2, "aa"), (2, "cc"), (3, "aa")}
    spread = [2 / 4, 1 / 4, 1 / 4]
    weight = 1 + sum(p * log(p) for p in spread) / log(5)
    assert abs(got[1, "aa"]["score"] - log(3) * weight) < 1e-12
    assert abs(got[2, "cc"]["score"] - log(4)) < 1e-12 and got[2, "cc"]["records"] == 1
    from docquarry.llm import distinctive

    weights = spark.createDataFrame([("a", 9), ("b", 9), ("c", 7), ("d", 5), ("e", 1)], "term string, records long")
    assert [distinctive.hot_bound(weights, 10, 0.3, k) for k in (4, 3, 2, 1)] == [3.0, 5, 7, 9]
    assert scores(df.limit(0), "doc", "row", tokens("text")).count() == 0
