import random

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import golay
from docquarry.llm import neardup as N


def test_golay_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    low, high, errors = golay._tables()
    fixed = words ^ errors[low[words & 4095] ^ high[words >> 12]]
    assert all(bin(int(a ^ b)).count("1") <= 3 for a, b in zip(words, fixed))
    assert (golay._remainder(fixed) == 0).all() and (golay.nearest(fixed) == fixed >> 11).all()
    messages = np.arange(1 << 12, dtype=np.int64) << 11
    assert golay.nearest(messages ^ golay._remainder(messages)).tolist() == list(range(1 << 12))


def test_words_at_distance_two_share_a_key():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 400)
    for d in (0, 1, 2):
        other = words.copy()
        for k in range(len(other)):
            for bit in rng.choice(23, d, replace=False):
                other[k] ^= 1 << int(bit)
        for a, b in zip(words, other):
            assert set(golay.keys(np.array([a]))[1]) & set(golay.keys(np.array([b]))[1])


def corpus(rng):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    docs, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=90)
        docs.append((n := n + 1, " ".join(base)))
        for _ in range(2):
            copy = list(base)
            for _ in range(rng.choice([1, 3, 6, 12])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            if rng.random() < 0.3:
                cut = rng.randrange(len(copy))
                copy = copy[cut:] + copy[:cut]
            docs.append((n := n + 1, " ".join(copy)))
    same = " ".join(rng.choices(words, k=90))
    docs += [(n := n + 1, same if k % 2 else same.upper().replace(" ", " \n")) for k in range(20)]  # a third are copies
    docs += [(n := n + 1, "short text"), (n := n + 1, ""), (n := n + 1, None), (None, same), (docs[0][0], docs[0][1])]
    return docs


def brute(docs):
    texts = {k: N.normal(t) for k, t in docs if k is not None and t is not None and len(N.normal(t)) >= N.LEAST_CHARS}
    sets = {k: {t[i : i + 8] for i in range(len(t) - 7)} for k, t in texts.items()}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_pairs_and_groups(spark):
    docs = corpus(random.Random(4))
    df = spark.createDataFrame(docs, "id long, body string").withColumns({"doc": F.lit("x"), "text": F.lit("y"), "keys": F.lit(0)})
    near = N.NearDuplicates(df, "id", "body")
    got = [tuple(r) for r in near.pairs().collect()]
    expected = brute(docs)
    assert len(got) == len(set(got)) and set(got) <= expected and len(set(got)) >= 0.97 * len(expected)
    groups = {r["doc"]: r for r in near.groups().collect()}
    parent = {k: k for k in groups}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(groups[k]["group_id"] == root(k) for k in groups)
    copies = [r for r in groups.values() if r["class_id"] != r["doc"]]
    assert len(copies) >= 19


def sets_at(rng, n, similarity):
    """Two sets of n hashes each with the given share in common."""
    c = round(2 * n * similarity / (1 + similarity))
    pool = rng.integers(0, 1 << 63, 2 * n - c).astype(np.uint64)
    return np.sort(pool[:n]), np.sort(pool[n - c :])


def test_recall_at_the_threshold():
    """Of pairs at similarity 0.60 to 0.65, for short and usual texts, at least 0.95 share a key and pass the sketch."""
    rng = np.random.default_rng(8)
    for n in (260, 1100):
        sides = [sets_at(rng, n, rng.uniform(0.6, 0.65)) for _ in range(400)]
        assert all(i >= 0.599 * u for i, u in (N.similarity(a, b) for a, b in sides))
        m = np.array([[N.min_hashes(s) for s in pair] for pair in sides])
        found = 0
        for one, two in m:
            a, b = (set(N.keys(N.words_of(x[None]))[1].tolist()) for x in (one, two))
            x, y = N.sketches(one[None])[0], N.sketches(two[None])[0]
            found += bool(a & b) and sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= N.SKETCH_FLIPS
        assert found >= 0.95 * len(sides)


def test_unlike_records_rarely_meet():
    rng = np.random.default_rng(9)
    m = np.array([N.min_hashes(np.sort(rng.integers(0, 1 << 63, 800).astype(np.uint64))) for _ in range(1500)])
    row, key = N.keys(N.words_of(m))
    _, n = np.unique(key, return_counts=True)
    pairs = int((n * (n - 1) // 2).sum())
    assert pairs <= 2e-3 * 1500 * 1499 / 2


def test_hot_keys_are_joined_in_blocks(spark, monkeypatch):
    """Texts that share most of their keys, with blocks of three records: the pairs are those of one block."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(300)]
    base = rng.choices(words, k=90)
    docs = []
    for k in range(14):
        text = list(base)
        text[rng.randrange(90)] = words[k]
        docs.append((k, " ".join(text)))
    df = spark.createDataFrame(docs, "id long, body string")
    whole = sorted(map(tuple, N.NearDuplicates(df, "id", "body").pairs().collect()))
    monkeypatch.setattr(N, "BLOCK", 3)
    assert sorted(map(tuple, N.NearDuplicates(df, "id", "body").pairs().collect())) == whole == sorted(brute(docs))


def test_empty_table(spark):
    near = N.NearDuplicates(spark.createDataFrame([], "id long, body string"), "id", "body")
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    links = [(1, k) for k in range(2, 20)] + [(k, k + 1) for k in range(30, 60)] + [(19, 30), (70, 71)]
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(links, "doc_a long, doc_b long")).collect()}
    assert all(got[k] == 1 for k in [*range(2, 20), *range(30, 61)]) and got[71] == 70


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (50, 101)]
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(links, "doc_a long, doc_b long")).collect()}
    assert all(got[k] == 1 for k in range(2, 41)) and got[100] == got[101] == 50
