"""Queries of the search engine's operators over the patent tables, and their SQL.

Documents are the patents with a number, the row loaded last per number. Oracle-checked queries run unstemmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.api import Engine
from docquarry.functions import snippets, stemmer
from docquarry.functions.distance import distance_column
from docquarry.functions.stemmer import stem_column
from docquarry.functions.text import tokens_sql
from docquarry.operators import evaluation, feedback, index, pagerank, postings, ranking, spelling
from docquarry.plans.compiler import Options, compile_query
from docquarry.plans.parser import parse
from docquarry.schemas import ZONE_COLUMNS, ZONES
from docquarry.session import list_path, move_path, scratch_path, table
from docquarry.sources import corpus
from docquarry.sources.corpus import DOCS, patent_docs, stop_words
from docquarry.stem_sql import stem_ctes
from docquarry.streaming import incremental

#: Terms of the sample queries.
WORD, OTHER, RARE, PREFIX, DOC = "housing", "valve", "laser", "magnet", 1000001
PHRASE2, PHRASE3 = ("housing", "stores"), ("said", "housing", "stores")
MISSPELT = "hosuing"
TOP = 10


def docs(spark: SparkSession, d: str) -> DataFrame:
    return patent_docs(table(spark, d, "patents"))


def stops(spark: SparkSession, d: str) -> frozenset[str]:
    return stop_words(table(spark, d, "stop_words"))


def tables(spark: SparkSession, d: str, stem: bool = False) -> index.Index:
    return index.build(docs(spark, d), stops(spark, d), stem, local=stem)


_stored: dict[tuple, index.Index] = {}


def stored(spark: SparkSession, d: str) -> index.Index:
    """The unstemmed index of a data directory, built and written once per application, then read from its tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        words, path = stops(spark, d), scratch_path(spark, "index")
        index.save(index.build(docs(spark, d), words, written=True), path)
        _stored[key] = index.load(spark, path, words)
    return _stored[key]


def match(text: str, options: Options = Options()):
    """A query giving the document numbers a search string matches."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return compile_query(parse(text, stops(spark, d)), stored(spark, d), options).docs()

    return run


def rank(text: str, k: int = TOP):
    def run(spark: SparkSession, d: str) -> DataFrame:
        idx = stored(spark, d)
        got = ranking.top(ranking.score(idx, compile_query(parse(text, idx.stop_words), idx), k), k)
        return got.select("rank", "doc_id", F.round("score", 6).alias("score"))

    return run


def recent(text: str, k: int = TOP):
    def run(spark: SparkSession, d: str) -> DataFrame:
        idx = stored(spark, d)
        return ranking.most_recent(idx, compile_query(parse(text, idx.stop_words), idx), k).select("rank", "doc_id")

    return run


def cells(text: str, options: Options = Options()):
    """A query giving the matched cells of a search string."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return compile_query(parse(text, stops(spark, d)), stored(spark, d), options).cells.select("token", "doc_id", "ct", "tf")

    return run


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return index.occurrences(index.zone_tokens(docs(spark, d))).drop("len")


def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return index.occurrences(index.zone_tokens(docs(spark, d)), stops(spark, d)).drop("len")


def doc_length(spark: SparkSession, d: str) -> DataFrame:
    return index.build_doc_len(index.zone_tokens(docs(spark, d)))


def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d).postings.drop("len").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def postings_stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings table brought to cells: repeated rows once, tokens trimmed and in lower case, nulls out."""
    occ = table(spark, d, "postings").select(F.lower(F.trim("token")).alias("token"), "doc_id", "ct", "pos").dropna().distinct()
    return index.build_postings(occ.withColumn("len", F.lit(0))).select("token", "doc_id", "ct", "tf")


def spell_correct(spark: SparkSession, d: str) -> DataFrame:
    lexicon = stored(spark, d).lexicon
    parts = [spelling.correction(lexicon, t) for t in (MISSPELT, "vlave", "lazer", "qqqqqq")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def dl_distance(spark: SparkSession, d: str) -> DataFrame:
    words = tables(spark, d).lexicon.select("token")
    return words.select("token", distance_column("token", F.lit(WORD)).alias("distance"))


def page_rank(spark: SparkSession, d: str) -> DataFrame:
    ds = docs(spark, d)
    return pagerank.pagerank(ds, index.build_citations(ds)).select("doc_id", F.round("page_rank", 9).alias("page_rank"))


def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").filter("country = 'US' AND kind IN ('B1', 'B2') AND cited_date > 20110000 AND cited_date < 20160000")
    number = F.regexp_replace(F.regexp_replace("doc_number", "[ ,]", ""), "^US", "")
    c = c.select("src", F.when(number.rlike("^[0-9]+$"), number.try_cast("bigint")).alias("dst"))
    return c.filter("dst > 0").distinct()


def ndcg(spark: SparkSession, d: str) -> DataFrame:
    gold, results = rank(f"{WORD} {OTHER}", 50)(spark, d), rank(WORD, 50)(spark, d)
    return evaluation.ndcg(gold, results, 10).select(F.round("ndcg", 9).alias("ndcg"))


def _first_round(spark: SparkSession, d: str, k: int):
    idx = stored(spark, d)
    hits = compile_query(parse(f"{RARE} {OTHER}", idx.stop_words), idx)
    return idx, hits, ranking.top(ranking.score(idx, hits, k), k)


def prf_terms(spark: SparkSession, d: str) -> DataFrame:
    idx, _, ranked = _first_round(spark, d, 3)
    texts = ranked.join(idx.contents, "doc_id")
    return feedback.frequent_terms(texts, "abstract", idx.stop_words)


def prf_rank(spark: SparkSession, d: str) -> DataFrame:
    """A round of feedback with the whole abstracts of the three best documents."""
    idx, _, _ = _first_round(spark, d, 3)
    more = [r["token"] for r in prf_terms(spark, d).collect()]
    query = parse(f"{RARE} {OTHER}", idx.stop_words).extended(more)
    got = ranking.top(ranking.score(idx, compile_query(query, idx, Options(correct_spelling=False)), TOP, [RARE, OTHER]), TOP)
    return got.select("rank", "doc_id", F.round("score", 6).alias("score"))


def coord_level(spark: SparkSession, d: str) -> DataFrame:
    hits = compile_query(parse(f"{WORD} {OTHER} {RARE} {PREFIX}*", stops(spark, d)), stored(spark, d))
    return ranking.coordination(ranking.matched(hits.cells), TOP)


def highlight(spark: SparkSession, d: str) -> DataFrame:
    marked = snippets.highlight_column("title", F.array(F.lit(WORD), F.lit(OTHER)))
    return docs(spark, d).select("doc_id", F.concat(F.lit(snippets.BOLD), marked, F.lit(snippets.BOLD_OFF)).alias("title"))


def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, stored(spark, d))


def format_result(spark: SparkSession, d: str) -> DataFrame:
    """The printed results of a keyword query."""
    return _engine(spark, d).formatted(f"{RARE} {OTHER}", TOP)


def search_prf(spark: SparkSession, d: str) -> DataFrame:
    """A search with feedback from the snippets of the three best documents, unstemmed."""
    return _engine(spark, d).search(f"{RARE} {OTHER} #3", TOP).select("rank", "doc_id", F.round("score", 6).alias("score"))


def search_corrected(spark: SparkSession, d: str) -> DataFrame:
    """A search with a misspelt word, and what was corrected."""
    got = _engine(spark, d).search(f"{MISSPELT} {OTHER}", TOP).select("rank", "doc_id", F.round("score", 6).alias("score"), F.explode("corrections").alias("c"))
    return got.select("rank", "doc_id", "score", "c.original", "c.corrected")


def stem(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d).lexicon.select("token", stem_column("token").alias("stem"))


def stemmed_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, stem=True).lexicon


def sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = docs(spark, d).select("doc_id", F.posexplode(snippets.sentences_column("abstract")).alias("n", "sentence"))
    return parts


def sentence_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The token position at which each sentence of an abstract begins."""
    from pyspark.sql import Window

    n = F.size(F.regexp_extract_all("sentence", F.lit("[a-zA-Z_-]{2,}"), F.lit(0)))
    before = F.sum(n).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return sentences(spark, d).select("doc_id", "n", F.coalesce(before, F.lit(0)).alias("first_token"))


def sentence_map(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each match of a word in the abstracts: an equi-join by document, then a range condition."""
    from pyspark.sql import Window

    at = sentence_offsets(spark, d).withColumn("next", F.lead("first_token").over(Window.partitionBy("doc_id").orderBy("n")))
    hits = stored(spark, d).postings.filter((F.col("token") == WORD) & (F.col("ct") == "Abstract")).select("doc_id", F.explode("positions").alias("pos"))
    inside = (F.col("pos") >= F.col("first_token")) & (F.col("next").isNull() | (F.col("pos") < F.col("next")))
    return hits.join(at, "doc_id").filter(inside).select("doc_id", "pos", "n")


def search(spark: SparkSession, d: str) -> DataFrame:
    """The whole path: stemmed index stored and loaded, mixed query, snippets."""
    path = scratch_path(spark, "index")
    engine = Engine.index(docs(spark, d), path, stops(spark, d))
    got = engine.search(f'"{PHRASE2[0]} {PHRASE2[1]}" {OTHER}', TOP)
    return got.select("rank", "doc_id", F.round("score", 6).alias("score"), "title")


def _xml_folder(spark: SparkSession, d: str) -> str:
    """The XML payloads of grants_raw written as weekly files, each a folder's one file, as the XML source expects them."""
    path = scratch_path(spark, "xml")
    rows = table(spark, d, "grants_raw").filter("fmt = 'xml' AND payload IS NOT NULL").select("file_id", "payload")
    rows.repartition("file_id").write.partitionBy("file_id").text(path)
    for folder in list_path(spark, path):  # names of files only
        if folder.startswith("file_id="):
            for n, part in enumerate(x for x in list_path(spark, f"{path}/{folder}") if x.startswith("part-")):
                move_path(spark, f"{path}/{folder}/{part}", f"{path}/{folder}/{n}/ipg{folder[8:]}.xml")
    return path


def xml_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents read from files of XML records; their claims without white space, which the SQL cannot tell from that between claim texts."""
    got = corpus.read_patent_xml(spark, _xml_folder(spark, d)).withColumn("claims", F.regexp_replace("claims", "\\s", ""))
    return got.withColumn("cites", F.array_join(F.col("cites").cast("array<string>"), ","))


def xml_rejected(spark: SparkSession, d: str) -> DataFrame:
    return corpus.rejected_patent_xml(spark, _xml_folder(spark, d))


def stop_file(spark: SparkSession, d: str) -> DataFrame:
    """The stop words read from a text file."""
    path = scratch_path(spark, "stop-words")
    table(spark, d, "stop_words").select(F.coalesce("word", F.lit(""))).write.text(path)
    return spark.createDataFrame([(w,) for w in sorted(corpus.stop_words_file(spark, path))], "word string")


def _streamed(spark: SparkSession, d: str) -> index.Index:
    """The index that two micro-batches of a file stream have built."""
    source, out, at = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "at"))
    every = docs(spark, d).persist()
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):  # both halves: the second arrives after the first is indexed
        every.filter(part).write.mode("append").parquet(source)
        incremental.index_stream(spark.readStream.schema(DOCS).parquet(source), out, at, stops(spark, d)).awaitTermination()
    every.unpersist()
    return incremental.read(spark, out, stops(spark, d))


def stream_index(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d).postings.select("token", "doc_id", "ct", "tf")


def stream_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d).lexicon


def snippet(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of the best documents of a keyword query, unstemmed."""
    idx = stored(spark, d)
    hits = compile_query(parse(f"{RARE} {OTHER}", idx.stop_words), idx)
    shown = feedback.snippets(ranking.top(ranking.score(idx, hits, TOP), TOP), hits.cells, idx.contents)
    return shown.select("rank", "doc_id", "snippet", F.array_join("tokens", " ").alias("tokens"))


def strict_phrase(spark: SparkSession, d: str) -> DataFrame:
    return match('"' + " ".join(PHRASE3) + '"', Options(strict_phrase=True))(spark, d)


# SQL

_DOCS = """docs AS MATERIALIZED (SELECT doc_id, file_id, title, abstract, claims, description, cites FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM patents WHERE doc_id IS NOT NULL) p WHERE rn = 1)"""
_STOPS = "stops AS MATERIALIZED (SELECT DISTINCT lower(trim(word, ' ')) AS w FROM stop_words WHERE trim(word, ' ') <> '')"
_ZONED = "zoned AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, '{z}' AS ct, coalesce({tokens_sql(c)}, []) AS toks FROM docs" for z, c in ZONE_COLUMNS.items()) + ")"
_ALL = "everything AS (SELECT doc_id, ct, unnest(toks) AS token, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos FROM zoned)"
_OCC = "occ AS MATERIALIZED (SELECT token, doc_id, ct, pos FROM everything WHERE token NOT IN (SELECT w FROM stops))"
_POST = "post AS MATERIALIZED (SELECT token, doc_id, ct, CAST(count(*) AS INTEGER) AS tf, list(pos ORDER BY pos) AS positions FROM occ GROUP BY token, doc_id, ct)"
_LEX = "lex AS MATERIALIZED (SELECT token, count(*) AS cf, count(DISTINCT doc_id) AS df FROM post GROUP BY token)"
_LEN = "doc_len AS MATERIALIZED (SELECT doc_id, ct, CAST(len(toks) AS INTEGER) AS len FROM zoned)"
_CITES = "links AS MATERIALIZED (SELECT DISTINCT doc_id AS src, dst FROM (SELECT doc_id, unnest(cites) AS dst FROM docs) c WHERE dst > 0)"
_STEMMED = (
    stem_ctes("SELECT token FROM lex") + ", spost AS MATERIALIZED (SELECT stem AS token, doc_id, ct, CAST(count(*) AS INTEGER) AS tf, list(pos ORDER BY pos) AS positions"
    " FROM occ JOIN stems USING (token) WHERE stem <> '' GROUP BY stem, doc_id, ct), slex AS MATERIALIZED (SELECT token, count(*) AS cf, count(DISTINCT doc_id) AS df FROM spost GROUP BY token)"
)
BASE = "WITH " + ", ".join([_DOCS, _STOPS, _ZONED, _ALL, _OCC, _POST, _LEX, _LEN, _CITES])


def _docs_of(condition: str) -> str:
    return f"SELECT DISTINCT doc_id FROM post WHERE {condition}"


def _phrase_cells(words: tuple[str, ...]) -> str:
    """CTEs s0 to sn: the cells that stay at each step of a phrase."""
    out = [f"s0 AS (SELECT token, doc_id, ct, tf, positions FROM post WHERE token = '{words[0]}')"]
    for k, w in enumerate(words[1:], 1):
        out.append(
            f"s{k} AS (SELECT * FROM post c WHERE token = '{w}' AND EXISTS (SELECT 1 FROM s{k - 1} b WHERE b.doc_id = c.doc_id AND b.ct = c.ct"
            f" AND list_has_any(list_transform(b.positions, lambda x: x + 1), c.positions)))"
        )
    return ", ".join(out)


def _phrase_docs(words: tuple[str, ...]) -> str:
    return f"{BASE}, {_phrase_cells(words)} SELECT DISTINCT doc_id FROM s{len(words) - 1}"


_W = "CASE ct " + " ".join(f"WHEN '{z}' THEN {w}" for z, w in ZONES.items()) + " END"


def _score_ctes(hits: str, k: int, prefix: str = "", original: str | None = None) -> str:
    """CTEs that rank the cells of a table by name, ending in one named <prefix>ranked."""
    p, f = prefix, "1.0" if original is None else f"CASE WHEN token IN ({original}) THEN 1.0 ELSE 0.25 END"
    return f"""
    {p}level AS (SELECT doc_id, count(DISTINCT token) AS n FROM {hits} GROUP BY doc_id),
    {p}cand AS (SELECT doc_id FROM (SELECT doc_id, rank() OVER (ORDER BY n DESC) AS r FROM {p}level) l WHERE r <= {k}),
    {p}terms AS (SELECT token, cf, {f} AS f FROM lex WHERE token IN (SELECT token FROM {hits})),
    {p}grid AS (SELECT c.doc_id, z.ct, t.token, t.cf, t.f, z.len FROM {p}cand c JOIN doc_len z ON z.doc_id = c.doc_id, {p}terms t),
    {p}scored AS (SELECT g.doc_id, sum(({_W.replace("ct ", "g.ct ", 1)}) * ln(g.f * (0.8::DOUBLE * CASE WHEN g.len > 0 THEN coalesce(h.tf, 0) / g.len::DOUBLE ELSE 0 END
        + 0.2::DOUBLE * g.cf / (SELECT sum(cf) FROM lex)))) AS score FROM {p}grid g LEFT JOIN {hits} h ON h.doc_id = g.doc_id AND h.ct = g.ct AND h.token = g.token GROUP BY g.doc_id),
    {p}ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM {p}scored QUALIFY rank <= {k})"""


def _rank_sql(condition: str, k: int = TOP) -> str:
    return f"{BASE}, hits AS MATERIALIZED (SELECT * FROM post WHERE {condition}), {_score_ctes('hits', k)} SELECT rank, doc_id, round(score, 6) AS score FROM ranked"


def _page_rank_sql() -> str:
    steps = ["r0 AS MATERIALIZED (SELECT doc_id, 1.0::DOUBLE / (SELECT count(*) FROM docs) AS r FROM docs)"]
    for k in range(pagerank.ITERATIONS):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT d.doc_id, 0.15::DOUBLE / (SELECT count(*) FROM docs) + 0.85::DOUBLE * coalesce(s, 0) AS r FROM docs d LEFT JOIN"
            f" (SELECT dst, sum(r / degree) AS s FROM edges JOIN r{k} ON r{k}.doc_id = src GROUP BY dst) x ON x.dst = d.doc_id)"
        )
    edges = "edges AS MATERIALIZED (SELECT l.src, l.dst, g.degree FROM links l JOIN (SELECT src, count(*) AS degree FROM links GROUP BY src) g USING (src) WHERE l.dst IN (SELECT doc_id FROM docs))"
    return f"WITH {_DOCS}, {_CITES}, {edges}, {', '.join(steps)} SELECT doc_id, round(r, 9) AS page_rank FROM r{pagerank.ITERATIONS}"


_GAIN = "CASE WHEN {0} > 0 THEN 1 + floor(10 * pow(0.5::DOUBLE, 0.1::DOUBLE * {0})) ELSE 0 END"
_DCG = "sum(g / CASE WHEN rank > 1 THEN log2(rank) ELSE 1 END)"


def _ndcg_sql() -> str:
    first = f"gold_hits AS MATERIALIZED (SELECT * FROM post WHERE token IN ('{WORD}', '{OTHER}')), res_hits AS MATERIALIZED (SELECT * FROM post WHERE token = '{WORD}')"
    gold, res = _score_ctes("gold_hits", 50, "gold_"), _score_ctes("res_hits", 50, "res_")
    actual = f"(SELECT {_DCG} FROM (SELECT r.rank, {_GAIN.format('coalesce(g.rank, 0)')} AS g FROM res_ranked r LEFT JOIN gold_ranked g USING (doc_id)) a WHERE rank <= 10)"
    ideal = f"(SELECT {_DCG} FROM (SELECT rank, {_GAIN.format('rank')} AS g FROM gold_ranked) b WHERE rank <= 10)"
    return f"{BASE}, {first}, {gold}, {res} SELECT round({actual} / {ideal}, 9) AS ndcg"


def _prf_ctes() -> str:
    hits = f"first_hits AS MATERIALIZED (SELECT * FROM post WHERE token IN ('{RARE}', '{OTHER}'))"
    return (
        f"{BASE}, {hits}, {_score_ctes('first_hits', 3, 'first_')}, prf AS MATERIALIZED (SELECT token, count(*) AS n FROM"
        f" (SELECT unnest({tokens_sql('abstract')}) AS token FROM docs WHERE doc_id IN (SELECT doc_id FROM first_ranked)) t"
        " WHERE token NOT IN (SELECT w FROM stops) GROUP BY token ORDER BY n DESC, token LIMIT 10)"
    )


def _prf_rank_sql() -> str:
    tokens = f"SELECT token FROM prf UNION SELECT '{RARE}' UNION SELECT '{OTHER}'"
    return (
        f"{_prf_ctes()}, hits AS MATERIALIZED (SELECT * FROM post WHERE token IN ({tokens})),"
        f" {_score_ctes('hits', TOP, '', f"'{RARE}', '{OTHER}'")} SELECT rank, doc_id, round(score, 6) AS score FROM ranked"
    )


def _nearest(t: str) -> str:
    return (
        f"SELECT * FROM (SELECT '{t}' AS token, token AS corrected, CAST(damerau_levenshtein(token, '{t}') AS INTEGER) AS distance, cf FROM lex"
        f" WHERE starts_with(token, '{t[0]}') AND abs(len(token) - {len(t)}) <= 2 AND damerau_levenshtein(token, '{t}') <= 3 ORDER BY distance, cf DESC, corrected LIMIT 1)"
    )


def _spell_sql() -> str:
    parts = " UNION ALL ".join(_nearest(t) for t in (MISSPELT, "vlave", "lazer", "qqqqqq"))
    return f"{BASE} SELECT token, corrected, distance FROM ({parts})"


def _corrected(t: str) -> str:
    return f"SELECT corrected FROM ({_nearest(t)})"


def _sentence_ctes() -> str:
    """CTEs sents (doc_id, n, sentence) and offs (also first_token): a mark is set after each end of a sentence, and the text split at it."""
    marked = "regexp_replace(abstract, '([.!?][''\"]?)(\\s)', '\\1' || chr(1) || '\\2', 'g')"
    cut = f"list_transform(string_split({marked}, chr(1)), lambda x: trim(regexp_replace(x, '^[.!?\\s]+', ''), ' ' || chr(9) || chr(10) || chr(13)))"
    return (
        f"cuts AS (SELECT doc_id, list_filter({cut}, lambda x: x <> '') AS xs FROM docs WHERE abstract IS NOT NULL),"
        " sents AS MATERIALIZED (SELECT doc_id, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS n, unnest(xs) AS sentence FROM cuts),"
        " offs AS MATERIALIZED (SELECT *, CAST(coalesce(sum(len(regexp_extract_all(sentence, '[a-zA-Z_-]{2,}'))) OVER"
        " (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_token FROM sents)"
    )


def _snippet_ctes(ranked: str, hits: str) -> str:
    """CTEs ending in snip (rank, doc_id, snippet, toks): the cover of two tokens by one sentence or two."""
    return f"""{_sentence_ctes()},
    spots AS (SELECT h.doc_id, h.token, h.pos, max(o.n) AS n FROM (SELECT doc_id, token, unnest(positions) AS pos FROM {hits} WHERE ct = 'Abstract') h
        JOIN offs o ON o.doc_id = h.doc_id AND o.first_token <= h.pos GROUP BY ALL),
    per AS (SELECT doc_id, n, count(DISTINCT token) AS kinds, count(*) AS total, list_sort(list(DISTINCT token)) AS toks FROM spots GROUP BY doc_id, n),
    one AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kinds DESC, total DESC, n) = 1),
    two AS (SELECT p.* FROM per p JOIN one o ON o.doc_id = p.doc_id WHERE len(list_filter(p.toks, lambda x: NOT list_contains(o.toks, x))) > 0
        QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY p.total DESC, p.n) = 1),
    snip AS MATERIALIZED (SELECT r.rank, r.doc_id,
            CASE WHEN one.n IS NULL THEN coalesce(s0.sentence, '') ELSE s1.sentence || CASE WHEN one.n > 0 AND two.n <> one.n + 1 THEN '{snippets.GAP}' ELSE '' END || coalesce(s2.sentence, '') END AS snippet,
            coalesce(one.toks, []) || list_filter(coalesce(two.toks, []), lambda x: NOT list_contains(one.toks, x)) AS toks
        FROM {ranked} r LEFT JOIN one ON one.doc_id = r.doc_id LEFT JOIN two ON two.doc_id = r.doc_id LEFT JOIN sents s0 ON s0.doc_id = r.doc_id AND s0.n = 0
        LEFT JOIN sents s1 ON s1.doc_id = r.doc_id AND s1.n = one.n LEFT JOIN sents s2 ON s2.doc_id = r.doc_id AND s2.n = two.n)"""


def _first_ctes() -> str:
    hits = f"first_hits AS MATERIALIZED (SELECT * FROM post WHERE token IN ('{RARE}', '{OTHER}'))"
    return f"{BASE}, {hits}, {_score_ctes('first_hits', TOP, 'first_')}, {_snippet_ctes('first_ranked', 'first_hits')}"


def _search_prf_sql() -> str:
    more = (
        f"more AS MATERIALIZED (SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('snippet')}) AS token FROM snip WHERE rank <= 3) t"
        " WHERE token NOT IN (SELECT w FROM stops) GROUP BY token ORDER BY n DESC, token LIMIT 10)"
    )
    hits = f"hits AS MATERIALIZED (SELECT * FROM post WHERE token IN (SELECT token FROM more UNION SELECT '{RARE}' UNION SELECT '{OTHER}'))"
    first = "SELECT token FROM first_hits WHERE doc_id IN (SELECT doc_id FROM first_ranked)"
    return f"{_first_ctes()}, {more}, {hits}, {_score_ctes('hits', TOP, '', first)} SELECT rank, doc_id, round(score, 6) AS score FROM ranked"


def _search_corrected_sql() -> str:
    hits = f"hits AS MATERIALIZED (SELECT * FROM post WHERE token = '{OTHER}' OR token = ({_corrected(MISSPELT)}))"
    return f"{BASE}, {hits}, {_score_ctes('hits', TOP)} SELECT rank, doc_id, round(score, 6) AS score, '{MISSPELT}' AS original, ({_corrected(MISSPELT)}) AS corrected FROM ranked"


def _search_sql() -> str:
    one, two, other = (stemmer.stem(w) for w in (*PHRASE2, OTHER))
    cells = _phrase_cells((one, two)).replace("FROM post", "FROM spost")
    hits = f"hits AS MATERIALIZED (SELECT * FROM s0 WHERE doc_id IN (SELECT doc_id FROM s1) UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM spost WHERE token = '{other}')"
    scored = _score_ctes("hits", TOP).replace("FROM lex", "FROM slex")
    return f"{BASE}, {_STEMMED}, {cells}, {hits}, {scored} SELECT rank, doc_id, round(score, 6) AS score, nullif(title, '') AS title FROM ranked JOIN docs USING (doc_id)"


def _marked(text: str, tokens: str) -> str:
    """A text with the sample words among its tokens highlighted."""
    for w in sorted((RARE, OTHER)):
        text = f"CASE WHEN list_contains({tokens}, '{w}') THEN regexp_replace({text}, '\\b({w})\\b', chr(27) || '[32m\\1' || chr(27) || '[39m', 'gi') ELSE {text} END"
    return text


def _format_sql() -> str:
    titles = "titles AS (SELECT doc_id, list(DISTINCT token) AS toks FROM first_hits WHERE ct = 'Title' GROUP BY doc_id)"
    shown = f"CAST(s.doc_id AS VARCHAR) || ' ' || {_bold(_marked("coalesce(d.title, '')", 'coalesce(t.toks, [])'))} || chr(10) || {_marked('s.snippet', 's.toks')}"
    return (
        f"{_first_ctes()}, {titles} SELECT s.rank, CASE WHEN nullif(d.title, '') IS NULL AND nullif(d.abstract, '') IS NULL THEN CAST(s.doc_id AS VARCHAR) ELSE {shown} END AS text"
        " FROM snip s JOIN docs d ON d.doc_id = s.doc_id LEFT JOIN titles t ON t.doc_id = s.doc_id"
    )


def _xml_text(path: str) -> str:
    """The text of all matches of an element path in a record, mark-up taken out and entities replaced."""
    text = f"array_to_string(regexp_extract_all(body, '{path}', 1), '')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{ch}')"
    return f"nullif(replace(replace({text}, chr(2), '<'), chr(3), '&'), '')"


#: A record's own number, as it is written; where it is no number, those of the citations after it must not count.
_PUBLISHED = "trim(regexp_extract(payload, '(?s)<publication-reference>.*?<doc-number>([^<]*)</doc-number>', 1), ' ' || chr(9) || chr(10) || chr(13))"


def _xml_sql() -> str:
    """Records by patterns: comments go, character data is kept with its marks replaced, and records without an end are left out."""
    cdata = "regexp_replace(payload, '(?s)<!--.*?-->', '', 'g')"
    pieces = f"list_transform(string_split({cdata}, '<![CDATA['), lambda x, i: CASE WHEN i = 1 THEN x ELSE replace(replace(split_part(x, ']]>', 1), '<', chr(2)), '&', chr(3)) || split_part(x, ']]>', 2) END)"
    number = _PUBLISHED.replace("payload", "body")
    cited = "unnest(regexp_extract_all(coalesce(regexp_extract(body, '(?s)<(?:us-)?references-cited>(.*)</(?:us-)?references-cited>', 1), ''), '(?s)<document-id>(.*?)</document-id>', 1))"
    f = lambda x: f"trim(regexp_extract(c, '<{x}>([^<]*)</{x}>', 1))"
    keep = f"{f('country')} = 'US' AND {f('kind')} IN ('B1', 'B2') AND try_cast({f('date')} AS INTEGER) > 20110000 AND try_cast({f('date')} AS INTEGER) < 20160000 AND regexp_full_match({f('doc-number')}, '[0-9]+')"
    inner = lambda outer, x: f"(?s)<{x}(?:\\s[^>]*)?>(.*?)</{x}>"
    zone = lambda outer: f"coalesce(regexp_extract(whole, '(?s)<{outer}(?:\\s[^>]*)?>(.*)</{outer}>', 1), '')"
    texts = {"title": ("us-bibliographic-data-grant", inner("", "invention-title")), "abstract": ("abstract", inner("", "p")), "claims": ("claims", inner("", "claim")), "description": ("description", inner("", "p"))}
    columns = ", ".join(f"{_xml_text(path).replace('body', zone(outer))} AS {z}" for z, (outer, path) in texts.items())
    columns = columns.replace(" AS claims", " AS spaced") + ", regexp_replace(spaced, '\\s', '', 'g') AS claims"
    return (
        f"WITH recs AS MATERIALIZED (SELECT raw_id, file_id, array_to_string({pieces}, '') AS body FROM grants_raw WHERE fmt = 'xml' AND trim(payload, ' ' || chr(10)) LIKE '%</us-patent-grant>'),"
        f" own AS (SELECT raw_id, file_id, body, body AS whole, CASE WHEN regexp_full_match({number}, '[0-9]+') THEN try_cast({number} AS BIGINT) END AS doc_id FROM recs),"
        f" links AS (SELECT raw_id, string_agg(CAST(CAST({f('doc-number')} AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS cites FROM"
        f" (SELECT raw_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS c FROM (SELECT raw_id, {cited[7:-1]} AS xs FROM recs) l) m WHERE {keep} GROUP BY raw_id)"
        f" SELECT * EXCLUDE (spaced) FROM (SELECT doc_id, file_id, {columns}, coalesce(cites, '') AS cites FROM own LEFT JOIN links USING (raw_id) WHERE doc_id IS NOT NULL) x"
    )


def _citing(doc: int) -> str:
    return f"SELECT DISTINCT src AS doc_id FROM links WHERE dst = {doc}"


def _bold(text: str) -> str:
    return f"chr(27) || '[1m' || {text} || chr(27) || '[22m'".replace("[22m", snippets.BOLD_OFF[1:])


def postings_put(spark: SparkSession, d: str) -> DataFrame:
    """A phrase's cells put over those of a word: the phrase keeps a word in fewer zones."""
    idx = stored(spark, d)
    one, two = (compile_query(parse(t), idx).cells for t in (f"{PHRASE2[0]} {RARE}", '"' + " ".join(PHRASE2) + '"'))
    return postings.put_all(one, two).select("token", "doc_id", "ct", "tf")


def postings_removed(spark: SparkSession, d: str) -> DataFrame:
    cells = compile_query(parse(f"{WORD} {OTHER} {RARE}"), stored(spark, d)).cells
    return postings.remove(postings.remove(postings.remove(cells, token=OTHER), doc_id=DOC), WORD, DOC + 1).select("token", "doc_id", "ct", "tf")


QUERIES = {
    "postings_put": postings_put,
    "postings_removed": postings_removed,
    "postings_sizes": lambda s, d: postings.sizes(stored(s, d).postings),
    "token_sets": lambda s, d: postings.token_sets(stored(s, d).postings).withColumn("tokens", F.array_join("tokens", " ")),
    "document_range": lambda s, d: postings.document_range(docs(s, d)),
    "tokenize": tokenize,
    "stopword_filter": stopword_filter,
    "doc_length": doc_length,
    "doc_total_length": lambda s, d: index.build_doc_len(index.zone_tokens(docs(s, d))).groupBy("doc_id").agg(F.sum("len").alias("len")),
    "postings_build": postings_build,
    "postings_stored": postings_stored,
    "term_freq": lambda s, d: tables(s, d).postings.select("token", "doc_id", "ct", "tf"),
    "coll_freq": lambda s, d: tables(s, d).lexicon,
    "coll_freq_occurrences": lambda s, d: index.build(docs(s, d), stops(s, d), cf_mode="occurrences").lexicon,
    "coll_size": lambda s, d: tables(s, d).stats,
    "index_stats": lambda s, d: index.entries(tables(s, d)),
    "term_lookup": cells(WORD),
    "prefix_lookup": cells(f"{PREFIX}*"),
    "lexicon_prefix": lambda s, d: stored(s, d).lexicon.filter(F.col("token").startswith(PREFIX)),
    "doc_map": lambda s, d: tables(s, d).doc_map,
    "doc_lookup": lambda s, d: stored(s, d).doc_map.filter(F.col("doc_id") == DOC),
    "content_lookup": lambda s, d: stored(s, d).contents.filter(F.col("doc_id") == DOC),
    "zone_extract": lambda s, d: docs(s, d).select("doc_id", "title", "abstract", "claims", "description"),
    "zone_filter": lambda s, d: stored(s, d).postings.filter("ct = 'Abstract'").select("token", "doc_id", "tf"),
    "field_concat": lambda s, d: docs(s, d).select("doc_id", F.array_join(F.array(*ZONE_COLUMNS.values()), "").alias("text")),
    "keyword_or": match(f"{WORD} {RARE}"),
    "bool_or": match(f"{RARE} OR {PREFIX}*"),
    "bool_and": match(f"{RARE} AND {OTHER}"),
    "bool_and_empty": match(f"{RARE} AND qqqqqqqqqq"),
    "strict_and": match(f"{RARE} AND {PREFIX}*", Options(strict_and=True)),
    "strict_and_empty": match(f"{RARE} AND qqqqqqqqqq", Options(strict_and=True, correct_spelling=False)),
    "search_misspelt": match(f"{MISSPELT} {RARE}"),
    "bool_not": match(f"{OTHER} NOT {RARE}"),
    "bool_chain": match(f"{OTHER} NOT {RARE} OR {PREFIX}*"),
    "bool_link": match(f"{OTHER} AND LinkTo:{DOC}"),
    "bool_recent": recent(f"{OTHER} NOT {RARE}"),
    "link_to": match(f"LinkTo:{DOC}"),
    "citation_edges": citation_edges,
    "phrase_2": match('"' + " ".join(PHRASE2) + '"'),
    "phrase_2_arrays": match('"' + " ".join(PHRASE2) + '"', Options(strict_phrase=True)),
    "phrase_3": match('"' + " ".join(PHRASE3) + '"'),
    "phrase_2_cells": cells('"' + " ".join(PHRASE2) + '"'),
    "strict_phrase": strict_phrase,
    "mixed_query": cells(f'"{PHRASE2[0]} {PHRASE2[1]}" {RARE} {PHRASE2[0]}'),
    "mixed_words_first": cells(f'{RARE} "{PHRASE2[0]} {PHRASE2[1]}" #2'),
    "coord_level": coord_level,
    "rank_ql": rank(f"{RARE} {OTHER} {WORD}"),
    "rank_ql_prefix": rank(f"{RARE} {PREFIX}*"),
    "rank_phrase": rank('"' + " ".join(PHRASE2) + '"'),
    "spell_correct": spell_correct,
    "dl_distance": dl_distance,
    "pagerank": page_rank,
    "ndcg": ndcg,
    "prf_terms": prf_terms,
    "prf_rank": prf_rank,
    "highlight": highlight,
    "format_result": format_result,
    "stem": stem,
    "stemmed_lexicon": stemmed_lexicon,
    "sentences": sentences,
    "sentence_offsets": sentence_offsets,
    "sentence_map": sentence_map,
    "search": search,
    "snippet": snippet,
    "search_prf": search_prf,
    "search_corrected": search_corrected,
    "stream_index": stream_index,
    "stream_lexicon": stream_lexicon,
    "xml_files": xml_files,
    "xml_rejected": xml_rejected,
    "stop_file": stop_file,
}

_POSTED = "SELECT token, doc_id, ct, tf FROM post"
SQL = {
    "postings_put": f"{BASE}, {_phrase_cells(PHRASE2)}, two AS (SELECT token, doc_id, ct, tf FROM s0 WHERE doc_id IN (SELECT doc_id FROM s1) UNION ALL SELECT token, doc_id, ct, tf FROM s1)"
    f" SELECT * FROM two UNION ALL {_POSTED} WHERE token IN ('{PHRASE2[0]}', '{RARE}') AND (token, doc_id) NOT IN (SELECT (token, doc_id) FROM two)",
    "postings_removed": f"{BASE} {_POSTED} WHERE token IN ('{WORD}', '{RARE}') AND doc_id <> {DOC} AND NOT (token = '{WORD}' AND doc_id = {DOC + 1})",
    "postings_sizes": f"{BASE} SELECT count(DISTINCT token) AS n_tokens, count(DISTINCT doc_id) AS n_docs, count(DISTINCT (token, doc_id)) AS n_cells, CAST(coalesce(sum(tf), 0) AS BIGINT) AS occurrences FROM post",
    "token_sets": f"{BASE} SELECT doc_id, string_agg(DISTINCT token, ' ' ORDER BY token) AS tokens FROM post GROUP BY doc_id",
    "document_range": f"WITH {_DOCS} SELECT min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT doc_id) AS n_docs FROM docs",
    "tokenize": f"WITH {_DOCS}, {_ZONED}, {_ALL} SELECT token, doc_id, ct, pos FROM everything",
    "stopword_filter": f"{BASE} SELECT token, doc_id, ct, pos FROM occ",
    "doc_length": f"WITH {_DOCS}, {_ZONED}, {_LEN} SELECT * FROM doc_len",
    "postings_build": f"{BASE} SELECT token, doc_id, ct, tf, array_to_string(positions, ',') AS positions FROM post",
    "postings_stored": "SELECT token, doc_id, ct, CAST(count(*) AS INTEGER) AS tf FROM (SELECT DISTINCT lower(trim(token, ' ')) AS token, doc_id, ct, pos FROM postings WHERE token IS NOT NULL AND doc_id IS NOT NULL AND ct IS NOT NULL AND pos IS NOT NULL) p GROUP BY token, doc_id, ct",
    "term_freq": f"{BASE} {_POSTED}",
    "coll_freq": f"{BASE} SELECT token, cf, df FROM lex",
    "coll_freq_occurrences": f"{BASE} SELECT token, CAST(sum(tf) AS BIGINT) AS cf, count(DISTINCT doc_id) AS df FROM post GROUP BY token",
    "coll_size": f"{BASE} SELECT CAST(coalesce(sum(cf), 0) AS BIGINT) AS c, (SELECT count(*) FROM docs) AS n_docs FROM lex",
    "index_stats": f"{BASE} SELECT 'inverted' AS table_name, count(*) AS entries FROM lex UNION ALL SELECT 'documents', count(*) FROM docs"
    " UNION ALL SELECT 'contents', count(*) FROM docs UNION ALL SELECT 'citations', count(DISTINCT dst) FROM links",
    "term_lookup": f"{BASE} {_POSTED} WHERE token = '{WORD}'",
    "prefix_lookup": f"{BASE} {_POSTED} WHERE starts_with(token, '{PREFIX}')",
    "lexicon_prefix": f"{BASE} SELECT token, cf, df FROM lex WHERE starts_with(token, '{PREFIX}')",
    "zone_extract": f"WITH {_DOCS} SELECT doc_id, title, abstract, claims, description FROM docs",
    "zone_filter": f"{BASE} SELECT token, doc_id, tf FROM post WHERE ct = 'Abstract'",
    "field_concat": f"WITH {_DOCS} SELECT doc_id, concat(title, abstract, claims, description) AS text FROM docs",
    "keyword_or": f"{BASE} {_docs_of(f"token IN ('{WORD}', '{RARE}')")}",
    "bool_or": f"{BASE} {_docs_of(f"token = '{RARE}' OR starts_with(token, '{PREFIX}')")}",
    "bool_and": f"{BASE} {_docs_of(f"token = '{RARE}'")} INTERSECT {_docs_of(f"token = '{OTHER}'")}",
    "bool_and_empty": f"{BASE} {_docs_of(f"token = '{RARE}'")}",
    "strict_and": f"{BASE} {_docs_of(f"token = '{RARE}'")} INTERSECT {_docs_of(f"starts_with(token, '{PREFIX}')")}",
    "strict_and_empty": f"{BASE} {_docs_of("token = 'qqqqqqqqqq'")}",
    "search_misspelt": f"{BASE} {_docs_of(f"token = '{RARE}' OR token = ({_corrected(MISSPELT)})")}",
    "bool_not": f"{BASE} {_docs_of(f"token = '{OTHER}'")} EXCEPT {_docs_of(f"token = '{RARE}'")}",
    "bool_chain": f"{BASE} SELECT doc_id FROM ({_docs_of(f"token = '{OTHER}'")} EXCEPT {_docs_of(f"token = '{RARE}'")}) a UNION {_docs_of(f"starts_with(token, '{PREFIX}')")}",
    "bool_link": f"{BASE} {_docs_of(f"token = '{OTHER}'")} INTERSECT {_citing(DOC)}",
    "bool_recent": f"{BASE} SELECT CAST(row_number() OVER (ORDER BY doc_id DESC) AS INTEGER) AS rank, doc_id FROM ({_docs_of(f"token = '{OTHER}'")} EXCEPT {_docs_of(f"token = '{RARE}'")}) a QUALIFY rank <= {TOP}",
    "link_to": f"WITH {_DOCS}, {_CITES} {_citing(DOC)}",
    "citation_edges": "SELECT DISTINCT src, dst FROM (SELECT src, try_cast(CASE WHEN regexp_full_match(n, '[0-9]+') THEN n END AS BIGINT) AS dst FROM (SELECT *, regexp_replace(regexp_replace(doc_number, '[ ,]', '', 'g'), '^US', '') AS n"
    " FROM citations WHERE country = 'US' AND kind IN ('B1', 'B2') AND cited_date > 20110000 AND cited_date < 20160000) c) e WHERE dst > 0",
    "phrase_2": _phrase_docs(PHRASE2),
    "phrase_3": _phrase_docs(PHRASE3),
    "phrase_2_cells": f"{BASE}, {_phrase_cells(PHRASE2)} SELECT token, doc_id, ct, tf FROM s0 WHERE doc_id IN (SELECT doc_id FROM s1) UNION ALL SELECT token, doc_id, ct, tf FROM s1",
    "strict_phrase": f"{BASE} SELECT DISTINCT a.doc_id FROM occ a JOIN occ b ON b.doc_id = a.doc_id AND b.ct = a.ct AND b.pos = a.pos + 1 JOIN occ c ON c.doc_id = a.doc_id AND c.ct = a.ct AND c.pos = a.pos + 2"
    f" WHERE a.token = '{PHRASE3[0]}' AND b.token = '{PHRASE3[1]}' AND c.token = '{PHRASE3[2]}'",
    "mixed_query": f"{BASE}, {_phrase_cells(PHRASE2)} SELECT token, doc_id, ct, tf FROM s1 UNION ALL SELECT token, doc_id, ct, tf FROM post WHERE token IN ('{RARE}', '{PHRASE2[0]}')",
    "mixed_words_first": f"{BASE}, {_phrase_cells(PHRASE2)} SELECT token, doc_id, ct, tf FROM s0 WHERE doc_id IN (SELECT doc_id FROM s1) UNION ALL SELECT token, doc_id, ct, tf FROM s1 UNION ALL {_POSTED} WHERE token = '{RARE}'",
    "coord_level": f"{BASE} SELECT doc_id, n_tokens FROM (SELECT *, rank() OVER (ORDER BY n_tokens DESC) AS r FROM (SELECT doc_id, count(DISTINCT token) AS n_tokens FROM post"
    f" WHERE token IN ('{WORD}', '{OTHER}', '{RARE}') OR starts_with(token, '{PREFIX}') GROUP BY doc_id) a) b WHERE r <= {TOP}",
    "rank_ql": _rank_sql(f"token IN ('{RARE}', '{OTHER}', '{WORD}')"),
    "rank_ql_prefix": _rank_sql(f"token = '{RARE}' OR starts_with(token, '{PREFIX}')"),
    "rank_phrase": f"{BASE}, {_phrase_cells(PHRASE2)}, hits AS MATERIALIZED (SELECT token, doc_id, ct, tf FROM s0 WHERE doc_id IN (SELECT doc_id FROM s1) UNION ALL SELECT token, doc_id, ct, tf FROM s1), {_score_ctes('hits', TOP)}"
    " SELECT rank, doc_id, round(score, 6) AS score FROM ranked",
    "spell_correct": _spell_sql(),
    "dl_distance": f"{BASE} SELECT token, CAST(damerau_levenshtein(token, '{WORD}') AS INTEGER) AS distance FROM lex",
    "pagerank": _page_rank_sql(),
    "ndcg": _ndcg_sql(),
    "prf_terms": f"{_prf_ctes()} SELECT token, n FROM prf",
    "prf_rank": _prf_rank_sql(),
    "doc_map": f"{BASE} SELECT doc_id, file_id, {', '.join(f"max(CASE WHEN ct = '{z}' THEN len END) AS len_{c}" for z, c in ZONE_COLUMNS.items())}, -1.0::DOUBLE AS page_rank FROM docs JOIN doc_len USING (doc_id) GROUP BY doc_id, file_id",
    "content_lookup": f"WITH {_DOCS} SELECT doc_id, nullif(title, '') AS title, nullif(abstract, '') AS abstract FROM docs WHERE doc_id = {DOC}",
    "highlight": f"WITH {_DOCS} SELECT doc_id, {_bold(f"regexp_replace(title, '\\b({WORD}|{OTHER})\\b', chr(27) || '[32m\\1' || chr(27) || '[39m', 'gi')")} AS title FROM docs",
    "format_result": _format_sql(),
    "sentences": f"WITH {_DOCS}, {_sentence_ctes()} SELECT doc_id, n, sentence FROM sents",
    "sentence_offsets": f"WITH {_DOCS}, {_sentence_ctes()} SELECT doc_id, n, first_token FROM offs",
    "sentence_map": f"{BASE}, {_sentence_ctes()} SELECT h.doc_id, h.pos, max(o.n) AS n FROM (SELECT doc_id, unnest(positions) AS pos FROM post WHERE token = '{WORD}' AND ct = 'Abstract') h"
    " JOIN offs o ON o.doc_id = h.doc_id AND o.first_token <= h.pos GROUP BY ALL",
    "stem": f"{BASE}, {stem_ctes('SELECT token FROM lex')} SELECT token, stem FROM stems",
    "stemmed_lexicon": f"{BASE}, {_STEMMED} SELECT token, cf, df FROM slex",
    "search": _search_sql(),
    "snippet": f"{_first_ctes()} SELECT rank, doc_id, snippet, array_to_string(toks, ' ') AS tokens FROM snip",
    "search_prf": _search_prf_sql(),
    "search_corrected": _search_corrected_sql(),
    "xml_files": _xml_sql(),
    "xml_rejected": "SELECT file_id, count(*) AS n_records, count(*) FILTER (WHERE NOT (trim(payload, ' ' || chr(10)) LIKE '%</us-patent-grant>')"
    f" OR NOT regexp_full_match({_PUBLISHED}, '[0-9]+')) AS n_rejected FROM grants_raw WHERE fmt = 'xml' AND payload IS NOT NULL"
    " AND regexp_matches(payload, '<us-patent-grant[\\s>]') GROUP BY file_id",
    "stop_file": "SELECT DISTINCT unnest(string_split_regex(lower(trim(word, ' ')), '\\s+')) AS word FROM stop_words WHERE trim(word, ' ') <> ''",
}
SQL["doc_total_length"] = f"WITH {_DOCS}, {_ZONED}, {_LEN} SELECT doc_id, CAST(sum(len) AS BIGINT) AS len FROM doc_len GROUP BY doc_id"
SQL["stream_index"] = SQL["term_freq"]
SQL["stream_lexicon"] = SQL["coll_freq"]
# the exploded form of the phrase: positions joined one by one
SQL["phrase_2_arrays"] = (
    f"{BASE} SELECT DISTINCT a.doc_id FROM occ a JOIN occ b ON b.doc_id = a.doc_id AND b.ct = a.ct AND b.pos = a.pos + 1 WHERE a.token = '{PHRASE2[0]}' AND b.token = '{PHRASE2[1]}'"
)
SQL["doc_lookup"] = f"SELECT * FROM ({SQL['doc_map']}) m WHERE doc_id = {DOC}"
