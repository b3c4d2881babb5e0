"""Orphan references against brute force, and edge cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docquarry.operators import references as R

T0 = dt.datetime(2012, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def test_brute_force(spark):
    rng = random.Random(5)
    loaded = [(rng.choice([None, *range(1, 40)]), day(rng.choice([None, *range(100)]))) for _ in range(120)]
    removed = [(rng.randint(1, 40), day(rng.choice([None, None, *range(100)]))) for _ in range(40)]
    # a third of all references go to one key
    refs = [(rng.randint(1, 9), rng.choice([7, None, -1, *range(1, 60)] + [7] * 30), day(rng.choice([None, *range(100)]))) for _ in range(900)]
    p = spark.createDataFrame(loaded, "doc_id long, loaded_at timestamp_ntz").withColumn("range", F.lit(1))
    m = spark.createDataFrame(removed, "doc_id long, removed_at timestamp_ntz")
    r = spark.createDataFrame(refs, "src long, dst long, at timestamp_ntz").withColumn("part", F.lit("clash"))
    known = R.parents(p, "doc_id", "loaded_at", m, "doc_id", "removed_at")
    told = [R.references("t", r, F.col("src"), F.col("dst"), F.col("at"))]
    there, gone = {}, {}
    for k, t in loaded:
        if k is not None and t is not None:
            there[k] = min(t, there.get(k, t))
    for k, t in removed:
        if t is not None:
            gone[k] = min(t, gone.get(k, t))
    expected = {
        ("t", f"{t:%Y-%m}", s, k) for s, k, t in refs if k and k > 0 and t and (k not in there or there[k] > t or k in gone and gone[k] <= t)
    }
    for keys, batch in ((50_000, 100_000), (5, 7)):
        got = [tuple(x) for x in R.orphans(known, told, keys, batch).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    report = R.per_period(R.orphans(known, told)).collect()
    assert sum(x["n_references"] for x in report) == len(expected)


def test_empty_tables(spark):
    p = spark.createDataFrame([], "doc_id long, loaded_at timestamp_ntz")
    m = spark.createDataFrame([], "doc_id long, removed_at timestamp_ntz")
    r = spark.createDataFrame([(1, 2, day(3))], "src long, dst long, at timestamp_ntz")
    known = R.parents(p, "doc_id", "loaded_at", m, "doc_id", "removed_at")
    one = [R.references("t", r, F.col("src"), F.col("dst"), F.col("at"))]
    assert [tuple(x) for x in R.orphans(known, one).collect()] == [("t", "2012-01", 1, 2)]
    none = [R.references("t", r.limit(0), F.col("src"), F.col("dst"), F.col("at"))]
    assert R.orphans(known, none).count() == 0


def test_number_forms(spark):
    texts = ["US 01003555", "1,003,123", " 1001983 ", "D291233", "", None, "US1000289", "9" * 40, "0", "12a"]
    c = spark.createDataFrame([(1, t, "US", "B1", 20120101, T0) for t in texts], "src long, doc_number string, country string, kind string, cited_date int, recorded_at timestamp_ntz")
    p = spark.createDataFrame([], "doc_id long, loaded_at timestamp_ntz, cites array<long>")
    m = spark.createDataFrame([], "doc_id long, mapped_at timestamp_ntz, removed_at timestamp_ntz")
    o = spark.createDataFrame([], "doc_id long, indexed_at timestamp_ntz")
    got = R.patent_references(p, c, m, o)[1].select("missing_id").distinct().collect()
    assert sorted(x[0] for x in got) == [1000289, 1001983, 1003123, 1003555]
