"""The engine on four small documents, and on files."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry import queries
from docquarry.api import Engine
from docquarry.operators import evaluation, index, matching, pagerank, ranking
from docquarry.plans.compiler import Options, compile_query
from docquarry.plans.parser import parse
from docquarry.sources import corpus
from docquarry.sources.corpus import DOCS, read_patent_xml
from docquarry.streaming import incremental
from tests.conftest import rows

ROWS = [
    (1, 110101, "Laser scanner", "A scanning laser device. The laser scans a surface.", "A laser.", "Text of the laser.", [2, 9]),
    (2, 110101, "Surface cleaner", "Cleans a surface.", "A cleaner.", "", [1]),
    (3, 110108, "Magnet", None, "A magnet near a laser surface.", "Magnetic laser. Surface laser scanner.", [1, 2]),
    (4, 110108, "Laser laser", "", None, None, None),
]
STOPS = frozenset({"the", "of"})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumn("token", F.lit("clash")).withColumn("ct", F.lit(1))


@pytest.fixture(scope="module")
def idx(docs):
    return index.build(docs.drop("token", "ct"), STOPS)


def found(idx, text, **options):
    return sorted(r["doc_id"] for r in compile_query(parse(text, STOPS), idx, Options(**options)).docs().collect())


def test_clashing_columns_are_not_read(docs):
    assert index.build(docs, STOPS).postings.count() == index.build(docs.drop("token", "ct"), STOPS).postings.count()


def test_positions_count_stop_words(idx):
    r = idx.postings.filter("token = 'laser' AND doc_id = 1 AND ct = 'Description'").first()
    assert r["positions"] == [3] and r["tf"] == 1
    lens = {(r["doc_id"], r["ct"]): r["len"] for r in idx.doc_len.collect()}
    assert lens[1, "Description"] == 4 and lens[2, "Description"] == 0 and lens[4, "Claims"] == 0 and len(lens) == 16


def test_collection_size_is_sum(idx):
    assert idx.stats.first()["c"] == idx.lexicon.agg(F.sum("cf")).first()[0] and idx.stats.first()["n_docs"] == 4


def test_stemmed_cells_are_those_of_occurrences(spark, docs, monkeypatch):
    plain = docs.drop("token", "ct")
    monkeypatch.setattr(index, "_AT_ONCE", 4)  # several parts a batch
    monkeypatch.setattr(index, "_CELLS", 2)
    for stops, stem in ((STOPS, True), (STOPS, False), (frozenset(), True)):
        told = index.build(plain, stops, stem)
        for mode in ("zones", "occurrences"):
            got = index.build(plain, stops, stem, mode, local=True)
            assert rows(got.lexicon) == rows(index.build_lexicon(told.postings, mode))
        assert rows(got.postings) == rows(told.postings) and rows(got.doc_len) == rows(told.doc_len)
    r = index.build(plain, STOPS, True, local=True).postings.filter("token = 'scan' AND ct = 'Abstract'").first()
    assert (r["doc_id"], r["tf"], r["len"], r["positions"]) == (1, 2, 7, [0, 5])  # scanning, scans; "A" is no token


def test_stemmed_lexicon_moves_documents_once(spark, data):
    """Occurrences are not moved, nor do they wait for a stemmer with the tokens of their zones."""
    plan = queries.QUERIES["stemmed_lexicon"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "EvalPython" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_index_keeps_documents_once_and_moves_packed_postings(spark, docs, tmp_path, monkeypatch):
    """An index is stored without a second copy of its documents, and postings are sorted as packed rows; documents with several rows keep theirs."""
    plain = docs.drop("token", "ct")
    names, real = [], index.materialize
    monkeypatch.setattr(index, "materialize", lambda df, name: names.append(name) or real(df, name))
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    engine = Engine.index(plain, str(tmp_path / "one"), STOPS)
    assert names == ["packed", "lengths"] and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    assert rows(engine.tables.postings) == rows(index.build(plain, STOPS, True).postings)
    odd = plain.unionByName(plain.filter("doc_id = 3").withColumn("title", F.lit("Magnets of scanners")))
    names.clear()
    engine = Engine.index(odd, str(tmp_path / "odd"), STOPS)
    told = index.build(odd, STOPS, True)
    assert "packed" not in names and rows(engine.tables.postings) == rows(told.postings) and rows(engine.tables.lexicon) == rows(told.lexicon)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    ids = np.append(rng.choice(10**6, 299, replace=False) - 500_000, 2**62)
    words = ["laser", "scans", "scanning", "the", "valve", "-"]
    zones = [pa.array([[words[k] for k in rng.integers(0, 6, rng.integers(0, 300))] for _ in ids], pa.list_(pa.string())) for _ in range(4)]
    got = index._pack(ids, zones, STOPS, True)
    assert max(got["n"].to_pylist()) == 64 and sum(got["occ"].to_pylist()) == sum(w != "the" for z in zones for d in z.to_pylist() for w in d)
    values = index._numbers(np.frombuffer(b"".join(got["cells"].to_pylist()), np.uint8))
    assert len(values) == 3 * sum(got["n"].to_pylist()) + sum(got["occ"].to_pylist())
    few = np.array([0, 127, 128, 2**32, 2**64 - 1, 5], np.uint64)
    assert (index._numbers(index._varints(few)[0]) == few).all()


def test_matching(idx):
    assert found(idx, "laser") == [1, 3, 4]
    assert found(idx, "magnet*") == [3]
    assert found(idx, '"scanning laser"') == [1]
    assert found(idx, '"laser surface"') == [3]
    assert found(idx, "laser AND surface") == [1, 3]
    assert found(idx, "laser NOT surface") == [4]
    assert found(idx, "cleaner OR magnet") == [2, 3]
    assert found(idx, "LinkTo:1") == [2, 3]
    assert found(idx, "surface AND LinkTo:1") == [2, 3]
    assert found(idx, "laser AND qqqqqqqq") == [1, 3, 4]
    assert found(idx, "laser AND qqqqqqqq", strict_and=True) == []
    assert found(idx, '"surface laser scanner"') == [3]
    assert found(idx, '"laser surface laser"') == [3] and found(idx, '"scanner laser"') == [] and found(idx, "") == []


def test_phrase_checks_neighbours_only(spark):
    rows = [(1, 1, "aa bb", "x", "bb cc", "", None), (2, 1, "aa bb dd bb cc", "", "", "", None)]
    idx = index.build(spark.createDataFrame(rows, DOCS))
    assert found(idx, '"aa bb cc"') == [2] and found(idx, '"aa bb cc"', strict_phrase=True) == []


def test_spelling(idx):
    hits = compile_query(parse("lasre"), idx)
    assert hits.corrections == {"laser": "lasre"} and sorted(r[0] for r in hits.docs().collect()) == [1, 3, 4]
    assert compile_query(parse("lasre"), idx, Options(correct_spelling=False)).docs().count() == 0


def test_last_operand_wins(idx):
    hits = compile_query(parse('"laser device" laser'), idx)
    cells = hits.cells.filter("token = 'laser' AND doc_id = 1")
    assert cells.count() == cells.select("ct").distinct().count() == 4


def test_ranking(idx):
    hits = compile_query(parse("laser surface"), idx)
    got = [r["doc_id"] for r in ranking.top(ranking.score(idx, hits, 2), 2).collect()]
    assert sorted(got) == [1, 3]
    every = ranking.top(ranking.score(idx, hits, -1), -1).collect()
    assert len(every) == 4 and [r["rank"] for r in every] == [1, 2, 3, 4]
    nan = ranking.top(ranking.score(idx, hits, -1, None, True), -1).collect()
    assert sum(r["score"] != r["score"] for r in nan) == 3
    assert [r["doc_id"] for r in ranking.most_recent(idx, hits, 2).collect()] == [4, 3]


def test_score_equals_dense_formula(idx):
    from math import log

    from docquarry.schemas import ZONES

    hits = compile_query(parse("laser surface"), idx)
    c = idx.size()
    cf = {r["token"]: r["cf"] for r in idx.lexicon.collect()}
    tf = {(r["token"], r["doc_id"], r["ct"]): r["tf"] for r in idx.postings.collect()}
    lens = {(r["doc_id"], r["ct"]): r["len"] for r in idx.doc_len.collect()}
    for r in ranking.score(idx, hits, -1).collect():
        d = r["doc_id"]
        dense = sum(
            w * sum(log((0.8 * tf.get((t, d, z), 0) / lens[d, z] if lens[d, z] else 0) + 0.2 * cf[t] / c) for t in ("laser", "surface"))
            for z, w in ZONES.items()
        )
        assert abs(dense - r["score"]) < 1e-9


def test_pagerank(spark, docs):
    got = {r["doc_id"]: r["page_rank"] for r in pagerank.pagerank(docs, index.build_citations(docs)).collect()}
    ranks = dict.fromkeys((1, 2, 3, 4), 0.25)
    for _ in range(45):
        ranks = {
            1: 0.0375 + 0.85 * (ranks[2] + ranks[3] / 2), 2: 0.0375 + 0.85 * (ranks[1] / 2 + ranks[3] / 2), 3: 0.0375, 4: 0.0375
        }
    assert all(abs(got[k] - ranks[k]) < 1e-12 for k in ranks)
    assert pagerank.pagerank(docs.limit(0), index.build_citations(docs.limit(0))).count() == 0


def test_all_results_are_numbered_over_ranges(spark, idx):
    scored = spark.createDataFrame([(k, float(k * 7 % 50)) for k in range(500)], "doc_id long, score double")
    got = ranking.top(scored.repartition(5), -1).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(r["score"], r["doc_id"]) for r in got] == sorted(((float(k * 7 % 50), k) for k in range(500)), key=lambda x: (-x[0], x[1]))
    recent = ranking.most_recent(idx, compile_query(parse("laser"), idx), -1).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in recent] == [(1, 4), (2, 3), (3, 1)]


def test_and_runs_nothing_while_compiled(spark, idx):
    from docquarry.operators.matching import both, match_link, match_tokens

    sides = [match_tokens(idx, ["laser"]), match_tokens(idx, ["surface"]), match_tokens(idx, ["qqq"]), match_link(idx, 1), match_link(idx, 77)]
    chained = both(both(both(*sides[:2]), sides[2]), both(sides[3], sides[4]))  # empty sides are ignored
    assert sorted(r["doc_id"] for r in chained.docs().collect()) == [3]
    spark.sparkContext.setJobGroup("compile", "")
    both(both(*sides[:2]), both(*sides[2:4]))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("compile")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_native_filter_loses_no_candidate(spark):
    import random

    from docquarry.functions.distance import damerau_levenshtein
    from docquarry.operators import spelling

    rng = random.Random(4)
    words = sorted({"v" + "".join(rng.choices("alve", k=rng.randint(2, 6))) for _ in range(300)})
    lexicon = spark.createDataFrame([(w, 1, 1) for w in words], "token string, cf long, df long")
    got = {r["token"]: r["distance"] for r in spelling.candidates(lexicon, "vlavae").collect()}
    assert got == {w: n for w in words if abs(len(w) - 6) <= 2 and (n := damerau_levenshtein(w, "vlavae")) <= 3}


def test_corrections_are_of_matched_tokens(spark, idx):
    engine = Engine(spark, idx)
    got = engine.search("lasre surface", 5).collect()
    assert all([tuple(c) for c in r["corrections"]] == [("lasre", "laser")] for r in got) and got
    assert all(r["corrections"] == [] for r in engine.search("cleaner NOT lasre", 5).collect())
    with pytest.raises(ValueError):
        engine.format("laser", -1)


def test_lookups_read_part_of_the_stored_index(spark, tmp_path):
    """A stored table is sorted by its key, so a lookup's filter reaches the scan and leaves out files by their ranges."""
    rows = [(k, 1, f"word{k:04d} common", "", "", "", [k + 1]) for k in range(0, 3000)]
    built = index.build(spark.createDataFrame([(k, 1, t.replace("0", "a").replace("1", "b").replace("2", "c"), *rest) for k, _, t, *rest in rows], DOCS))
    index.save(built, str(tmp_path / "i"))
    loaded = index.load(spark, str(tmp_path / "i"))
    plan = loaded.postings.filter("token = 'common'").select("doc_id", "tf")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,common)" in plan and "positions" not in plan.split("ReadSchema")[1]
    files = [sorted(r["token"] for r in spark.read.parquet(f).select("token").distinct().collect()) for f in loaded.lexicon.inputFiles()]
    spans = sorted((x[0], x[-1]) for x in files if x)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_postings_algebra(idx):
    from docquarry.operators import postings as P

    cells = compile_query(parse("laser surface"), idx).cells
    assert P.contains(cells, "laser") and P.contains(cells, doc_id=2) and P.contains(cells, "surface", 2) and not P.contains(cells, "laser", 2)
    less = P.remove(cells, "laser")
    assert not P.contains(less, "laser") and P.contains(P.remove(cells, "laser", 1), "laser") and P.remove(cells).count() == cells.count()
    one = cells.filter("ct = 'Title'")
    put = P.put_all(cells, one)
    assert put.filter("token = 'laser' AND doc_id = 1").count() == 1 and put.filter("token = 'surface' AND doc_id = 3").count() == 2
    assert tuple(P.sizes(cells.limit(0)).first()) == (0, 0, 0, 0)
    assert {r["doc_id"]: r["tokens"] for r in P.token_sets(cells).collect()}[2] == ["surface"]


def test_ndcg(spark):
    gold = spark.createDataFrame([(k, f"{k:07d}") for k in range(1, 9)], "rank int, doc_id string")
    for p in (1, 3, 20):
        assert evaluation.ndcg(gold, gold, p).first()[0] == pytest.approx(1.0)
    other = spark.createDataFrame([(1, "x"), (2, "0000001")], "rank int, doc_id string")
    assert 0 < evaluation.ndcg(gold, other, 5).first()[0] < 1
    assert evaluation.ndcg(gold.limit(0), other, 5).first()[0] is None


def test_facade(spark, docs, tmp_path):
    for compress in (True, False):
        engine = Engine.index(docs, str(tmp_path / f"index{compress}"), STOPS, compress=compress)
        got = engine.search("lasers #2", 3).collect()
        assert [r["rank"] for r in got] == [1, 2, 3] and {r["doc_id"] for r in got} == {1, 3, 4}
        assert next(r for r in got if r["doc_id"] == 4)["snippet"] == ""
        assert engine.format('"laser device" scanner', 2)[0].startswith("1 \033[1m")
        assert engine.search("laser NOT surface").first()["doc_id"] == 4
        assert engine.ndcg(["8000001", "8000002"], ["8000001 x", "8000002 y"], 2) == pytest.approx(1.0)


def grant(number, cites="", title="Laser", extra=""):
    return (
        f"<us-patent-grant lang='EN'><us-bibliographic-data-grant><publication-reference><document-id><country>US</country>"
        f"<doc-number>{number}</doc-number><kind>B2</kind></document-id></publication-reference><invention-title>{title}</invention-title>"
        f"{cites}</us-bibliographic-data-grant><abstract><p>One.</p><p>Two &amp; three.</p></abstract><description><p>First <b>bold</b> text.</p></description>"
        f"<claims><claim><claim-text>A device<claim-text> with a part</claim-text>.</claim-text></claim></claims>{extra}</us-patent-grant>"
    )


def test_xml_source(spark, tmp_path):
    def cite(country, number, kind, date):
        return f"<us-citation><patcit><document-id><country>{country}</country><doc-number>{number}</doc-number><kind>{kind}</kind><date>{date}</date></document-id></patcit></us-citation>"

    cites = "<us-references-cited>" + cite("US", "8000001", "B2", 20110816) + cite("DE", "123", "A1", 20120101) + cite("US", "8000003", "B1", 20100101) + "</us-references-cited>"
    sub = tmp_path / "deep"
    sub.mkdir()
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    (sub / "ipg110816.xml").write_text(head + grant("08000001") + "\n" + head + grant("08000002", cites) + head + grant("D123"))
    (tmp_path / "other.xml").write_text(grant("08000009"))
    got = {r["doc_id"]: r for r in read_patent_xml(spark, str(tmp_path)).collect()}
    assert set(got) == {8000001, 8000002}
    r = got[8000002]
    assert r["cites"] == [8000001] and r["file_id"] == 110816 and r["abstract"] == "One.Two & three." and r["claims"] == "A device with a part."
    assert r["description"] == "First bold text."


def test_xml_entities_and_rejects(spark, tmp_path):
    head = '<?xml version="1.0"?>\n<!DOCTYPE us-patent-grant SYSTEM "x.dtd" [<!ENTITY own "declared">\n<!ENTITY pic SYSTEM "a.tif" NDATA TIF>]>\n'
    text = head + grant("08000001", title="A &alpha; &own; &amp; &unheard; B") + "\n" + head + grant("08000003")[:300] + head + grant("08000004") + "<us-patent-grant><a>"
    (tmp_path / "ipg110817.xml").write_text(text, encoding="utf-8")
    got = {r["doc_id"]: r["title"] for r in corpus.read_patent_xml(spark, str(tmp_path)).collect()}
    assert got == {8000001: "A α declared & &unheard; B", 8000004: "Laser"}
    assert tuple(corpus.rejected_patent_xml(spark, str(tmp_path)).first()) == (110817, 4, 2)
    (tmp_path / "stops.txt").write_text("The of\n\n  And the\n")
    assert corpus.stop_words_file(spark, str(tmp_path / "stops.txt")) == {"the", "of", "and"}


def test_stream_of_changed_documents(spark, tmp_path):
    """A document that comes again takes its former counts out of the lexicon."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 1, "aa bb", "aa", "", "", None), (2, 1, "bb", "", "", "", [1])], [(1, 1, "cc bb", "", "", "", [2])], [(3, 1, "aa", "", "", "", None), (2, 1, "dd", "", "", "", None)]]
    for rows in batches:
        spark.createDataFrame(rows, DOCS).write.mode("append").parquet(source)
        incremental.index_stream(spark.readStream.schema(DOCS).parquet(source), path, str(tmp_path / "cp")).awaitTermination()
    whole, got = index.build(spark.createDataFrame([batches[1][0], *batches[2]], DOCS)), incremental.read(spark, path)
    for name in ("lexicon", "stats", "doc_map", "citations"):
        a, b = (getattr(x, name) for x in (got, whole))
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), name


def test_streaming(spark, docs, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    plain = spark.createDataFrame(ROWS, DOCS)
    plain.filter("doc_id < 3").write.parquet(source)
    for part in (None, "doc_id >= 3"):
        if part:
            plain.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DOCS).parquet(source)
        incremental.index_stream(stream, path, str(tmp_path / "cp"), STOPS).awaitTermination()
    whole, got = index.build(plain, STOPS), incremental.read(spark, path, STOPS)
    assert sorted(map(str, got.postings.select("token", "doc_id", "ct", "tf", "positions").collect())) == sorted(map(str, whole.postings.select("token", "doc_id", "ct", "tf", "positions").collect()))
    assert got.stats.first() == whole.stats.first()
    assert sorted(r[0] for r in matching.match_link(got, 1).links.collect()) == [2, 3]
