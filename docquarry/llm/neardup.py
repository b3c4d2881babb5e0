"""Problem 5: near-duplicate records, by Golay-code fuzzy hashing.

A record's text is the set of its runs of 8 characters. Its fingerprint is SEGMENTS words of 23 bits,
each made of the low bits of 4 min-hashes of that set; edits of a text that keep most runs flip few
bits. A word is decoded to the indices of the Golay codewords nearest to it and to its neighbours:
several keys, of which two words with few flips share one.

One index has 12 bits, too coarse for a large collection, so segments are taken in groups of six and a key
joins the indices of two neighbouring segments of a group. The flips of a pair at the similarity sought cannot
be many in every group (pigeonhole): in some group one word of the two is nearly the same, and the
other near enough to share an index. So of the two words of a key only one is taken with all its
indices, the other with the nearest alone: about 10 keys for each of PAIRS pairs of segments, in place of 28.

Records that share a key are compared by their sizes and sketches inside the join, and the rest is
verified on the texts exactly. Keys held by one record leave before the join; a key held by more than BLOCK records is joined in
pairs of blocks, so no task gets an unbounded group.

Equal texts are one class throughout: only its representative takes part, so a group of copies of
any size costs as much as one record.

Simulated, a pair at similarity 0.6 is found with probability 0.99, at 0.65 with 0.997.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import golay
from docquarry.session import materialize

RUN = 8
LEAST_CHARS = 300
SIMILARITY = 0.6
SEGMENTS = 48
#: Bits that a word takes of each of its min-hashes.
BITS = (6, 6, 6, 5)
HASHES = SEGMENTS * len(BITS)
#: Pairs of segments whose indices make keys: the five neighbours of each group of six.
GROUP = 6
FIRST = np.array([k for k in range(SEGMENTS) if k % GROUP < GROUP - 1])
PAIRS = len(FIRST)
#: The sketch has two bits of each min-hash. A pair at the similarity sought flips 76.8 of them on average, with a deviation of 9.2;
#: what flips more than five deviations more is not verified.
SKETCH_WORDS, SKETCH_FLIPS = HASHES * 2 // 64, 123
#: Records of a block, where a key is held by more.
BLOCK = 1000
#: Parts in which the first keys of classes with copies are joined.
SALTS = 16
#: Nodes with many links that are joined by broadcast (16 bytes each).
MOST_HUBS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The base of a run's polynomial, and its square and fourth power.
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, 1 << k, 1 << 64)) for k in range(RUN.bit_length() - 1)]


def normal(text: str) -> str:
    """Lower case, every run of white space one blank, no blanks at the ends."""
    return " ".join(text.lower().split())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(text: str) -> np.ndarray:
    """64-bit hashes of the distinct runs of RUN characters, sorted; none for a shorter text.

    A run is a polynomial of its code points, put together from halves and mixed.
    """
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(h) < RUN:
        return np.zeros(0, np.uint64)
    for k, power in enumerate(_POWERS):
        h = h[: -1 << k] * power + h[1 << k :]
    h = np.sort(_mix(h))
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


_EDGES = (np.arange(HASHES, dtype=np.uint64) * np.uint64((1 << 64) // HASHES)).astype(np.uint64)
#: Where an empty bin takes its value from, attempt by attempt.
_OTHERS = np.random.Generator(np.random.PCG64(23)).integers(0, HASHES, (HASHES, 64))


def min_hashes(hashed: np.ndarray) -> np.ndarray:
    """64 mixed bits of each of HASHES min-hashes: the least hash of each of as many equal bins. An empty bin takes the value of
    the first full one in an order of its own, so two sets of the same runs agree, and others as often as by their similarity."""
    at = np.searchsorted(hashed, _EDGES)
    ends = np.append(at[1:], len(hashed))
    full = at < ends
    low = hashed[np.minimum(at, len(hashed) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = full[_OTHERS[empty]]
        tries[~tries.any(axis=1), 0] = True
        low[empty] = low[_OTHERS[empty, tries.argmax(axis=1)]]
    return _mix(low ^ np.arange(1, HASHES + 1, dtype=np.uint64) * _MIX)


def words_of(m: np.ndarray) -> np.ndarray:
    """The SEGMENTS words of 23 bits of records' min-hashes, a row each."""
    part = m.reshape(len(m), SEGMENTS, len(BITS))
    words = np.zeros(part.shape[:2], np.int32)
    for k, bits in enumerate(BITS):
        words = words << bits | (part[:, :, k] & np.uint64((1 << bits) - 1)).astype(np.int32)
    return words


def sketches(m: np.ndarray) -> np.ndarray:
    """The SKETCH_WORDS words of the sketch of each row, of bits that the fingerprint does not use."""
    bits = np.concatenate([(m >> np.uint64(k) & np.uint64(1)).astype(np.uint8) for k in (20, 21)], axis=1)
    return np.packbits(bits, axis=1).view(np.int64)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit key) of the fingerprints of records, a row of words each: for every pair of segments the nearest indices of
    both, and of either with the further ones of the other."""
    n = len(words)
    got = golay.nearest(words.astype(np.int64).reshape(-1, 1) ^ golay.FLIPS).reshape(n, SEGMENTS, -1)
    near = got[:, :, 0]
    further = np.sort(got, axis=2)
    new = np.ones(further.shape, bool)
    new[:, :, 1:] = further[:, :, 1:] != further[:, :, :-1]
    new &= further != near[:, :, None]
    x, y = near[:, FIRST], near[:, FIRST + 1]
    tag = np.arange(PAIRS)[None, :] << 24
    row, pair, k = np.nonzero(new[:, FIRST])
    one = further[row, FIRST[pair], k] << 12 | y[row, pair] | pair << 24
    row2, pair2, k2 = np.nonzero(new[:, FIRST + 1])
    two = x[row2, pair2] << 12 | further[row2, FIRST[pair2] + 1, k2] | pair2 << 24
    rows = np.concatenate([np.repeat(np.arange(n), PAIRS), row, row2])
    return rows, np.concatenate([(tag | x << 12 | y).ravel(), one, two])


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Numbers of runs in both sets and in either."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


_PRINTS = "doc bigint, class binary, runs int, words binary, " + ", ".join(f"s{k} bigint" for k in range(SKETCH_WORDS))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, number of runs, fingerprint and sketch of each row of LEAST_CHARS or more."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [normal(t) if t else "" for t in part.column(1).to_pylist()]
            wide = [k for k, t in enumerate(texts) if len(t) >= LEAST_CHARS]
            sets = [runs(texts[k]) for k in wide]
            m = np.array([min_hashes(s) for s in sets], np.uint64).reshape(-1, HASHES)
            sketch = sketches(m)
            columns = [
                part.column(0).take(pa.array(wide, pa.int64())),
                pa.array([_digest(texts[k]) for k in wide], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([w.tobytes() for w in words_of(m)], pa.binary()),
                *(pa.array(sketch[:, k]) for k in range(SKETCH_WORDS)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PRINTS.split(", ")])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int32).reshape(-1, SEGMENTS)
            row, k = keys(words)
            yield pa.RecordBatch.from_arrays([pa.array(k), part.column(0).take(pa.array(row))], ["k", "doc"])


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) of rows (doc, text, class) whose normal text is that of the class."""
    for batch in batches:
        texts = [normal(t) if t else "" for t in batch.column(1).to_pylist()]
        keep = [k for k, (t, c) in enumerate(zip(texts, batch.column(2).to_pylist())) if _digest(t) == c]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([texts[k] for k in keep], pa.string())], ["doc", "text"]
        )


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep, common, either = [], [], []
            for k, (a, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_a", "text_a", "text_b")))):
                if last[0] != a:
                    last = (a, runs(ta))
                i, u = similarity(last[1], runs(tb))
                if i >= threshold * u - 1e-9:
                    keep.append(k)
                    common.append(i)
                    either.append(u)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_a").take(take), batch.column("doc_b").take(take), pa.array(common, pa.int32()), pa.array(either, pa.int32())],
                ["doc_a", "doc_b", "common", "either"],
            )

    return run


class NearDuplicates:
    """Near-duplicates of a table (key bigint, text): classes of equal texts and links between classes.

    Null keys and texts of fewer than LEAST_CHARS characters after normalising take no part. Rows of
    one key should have one text; of several the one with the least digest is taken. Tables: ``members`` (doc, class, first), first being the
    least key of the class, and ``links`` (doc_a, doc_b, common, either) between first keys, doc_a < doc_b. A similarity below SIMILARITY
    needs a fingerprint of its own.
    """

    def __init__(self, df: DataFrame, key: str, text: str, threshold: float = SIMILARITY):
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
        prints = materialize(rows.mapInArrow(_fingerprints, _PRINTS), "fingerprints")
        self.members = materialize(_members(prints), "classes")
        firsts = self.members.filter("doc = first").select("doc", "class")
        reps = materialize(prints.join(firsts, ["doc", "class"], "left_semi").dropDuplicates(["doc"]), "representatives")
        self.candidates = materialize(self._candidates(reps, threshold), "candidates")
        ends = self.candidates.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct()
        wanted = rows.join(ends.join(firsts, "doc"), "doc").select("doc", "text", "class")
        texts = wanted.mapInArrow(_of_class, "doc bigint, text string").groupBy("doc").agg(F.first("text").alias("text"))
        texts = materialize(texts, "texts")
        told = self.candidates.join(texts.withColumnsRenamed({"doc": "doc_b", "text": "text_b"}), "doc_b").join(
            texts.withColumnsRenamed({"doc": "doc_a", "text": "text_a"}), "doc_a"
        )
        schema = "doc_a bigint, doc_b bigint, common int, either int"
        self.links = materialize(told.select("doc_a", "text_a", "doc_b", "text_b").mapInArrow(_verified(threshold), schema), "links")

    @staticmethod
    def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
        """(doc_a, doc_b) with a common key whose sizes and sketches allow the similarity; both are compared inside the join."""
        every = reps.select("doc", "words").mapInArrow(_keys, "k bigint, doc bigint")
        held = every.withColumn("n", F.count("*").over(Window.partitionBy("k"))).filter("n > 1")
        looks = ["runs", *(f"s{k}" for k in range(SKETCH_WORDS))]
        shared = materialize(held.join(reps.select("doc", *looks), "doc"), "shared-keys")
        a, b = F.col("a.doc"), F.col("b.doc")
        flips = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(1, SKETCH_WORDS)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
        alike = (F.least("a.runs", "b.runs") >= threshold * F.greatest("a.runs", "b.runs") - 1e-9) & (flips <= SKETCH_FLIPS)
        few = shared.filter(F.col("n") <= BLOCK)
        pairs = few.alias("a").join(few.alias("b"), (F.col("a.k") == F.col("b.k")) & (a < b) & alike).select(a.alias("doc_a"), b.alias("doc_b"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        many = shared.filter(F.col("n") > BLOCK).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        left = many.withColumn("x", F.col("block")).withColumn("y", F.explode(F.expr("sequence(block, blocks - 1)")))
        right = many.withColumn("y", F.col("block")).withColumn("x", F.explode(F.expr("sequence(0, block)")))
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("k", "x", "y")]
        cells = left.alias("a").join(right.alias("b"), on[0] & on[1] & on[2] & ((F.col("a.x") < F.col("a.y")) | (a < b)) & alike)
        return pairs.unionByName(cells.select(F.least(a, b).alias("doc_a"), F.greatest(a, b).alias("doc_b"))).distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b) of all similar records, doc_a < doc_b, links between classes and copies expanded."""
        m = self.members
        a = m.select(F.col("first").alias("doc_a"), F.col("doc").alias("a"))
        b = m.select(F.col("first").alias("doc_b"), F.col("doc").alias("b"))
        across = self.links.join(a, "doc_a").join(b, "doc_b").select("a", "b")
        within = a.join(b.withColumnRenamed("doc_b", "doc_a"), "doc_a").filter("a < b").select("a", "b")
        both = across.unionByName(within)
        return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))

    def groups(self) -> DataFrame:
        """(doc, class_id, group_id, n_links): per record its class of equal texts, the group of classes that links connect,
        and the number of other classes its own is linked to."""
        ends = self.links.select(F.explode(F.array("doc_a", "doc_b")).alias("first"))
        degree = ends.groupBy("first").agg(F.count("*").cast("int").alias("n_links"))
        labels = components(self.links)
        out = self.members.join(degree, "first", "left").join(labels.withColumnRenamed("node", "first"), "first", "left")
        return out.select(
            "doc", F.col("first").alias("class_id"), F.coalesce("label", "first").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )



def _members(prints: DataFrame) -> DataFrame:
    """(doc, class, first) of fingerprinted rows. The least key of a class is joined in parts, for a class may hold a third of all rows."""
    docs = prints.groupBy("doc").agg(F.min("class").alias("class"))
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    copied = docs.groupBy("class").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copied = copied.select("class", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return docs.withColumn("salt", salt).join(copied, ["class", "salt"], "left").select("doc", "class", F.coalesce("first", "doc").alias("first"))


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the value m of their u. Nodes of many edges are joined by broadcast, so the edges of a giant component's least node stay spread;
    there are at most as many such nodes as edges / BLOCK, and beyond MOST_HUBS of them the join of all is left to Spark's own splitting."""
    hubs = materialize(least.filter(F.col("n") > BLOCK).select("u", "m"), "hubs")
    if not 0 < hubs.count() <= MOST_HUBS:
        return edges.join(least.select("u", "m"), "u")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    rest = marked.filter("m IS NULL").select("u", "v").join(least.filter(F.col("n") <= BLOCK).select("u", "m"), "u")
    return marked.filter("m IS NOT NULL").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of the connected component of each node, by alternating large and small stars.

    Every round is written to the shared folder. Labels only fall, so the rounds end; they grow with the logarithm of the number of nodes.
    """
    edges = materialize(links.select(F.col("doc_b").alias("u"), F.col("doc_a").alias("v")), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _beside(both, materialize(least, "least")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        new = _beside(large, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(new.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if not new.join(edges, ["u", "v"], "left_anti").count() and new.count() == edges.count():
            break
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
