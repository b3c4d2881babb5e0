"""Nested payloads: numbering, shapes, and what counts."""

import json

from pyspark.sql import functions as F

from docquarry.operators import nested

XML = """<?xml version="1.0"?><us-patent-grant><us-bibliographic-data-grant><invention-title>T</invention-title>
<us-references-cited><us-citation><patcit><document-id><country>US</country><doc-number>0012</doc-number><kind>B2</kind><date>20120101</date></document-id>
<document-id><country>DE</country><doc-number>9</doc-number></document-id></patcit></us-citation><us-citation><nplcit><othercit>A book</othercit></nplcit></us-citation></us-references-cited>
</us-bibliographic-data-grant><!-- <claim/> --><claims><claim num="1"><claim-text>A &lt;b<b>12</b><claim-text>inner<claim-text/></claim-text><claim-text><![CDATA[<claim-text>]]></claim-text></claim-text></claim></claims>
<abstract><p/></abstract><description><p>one<ul><li>x<ul><li>y</li></ul></li><li/></ul></p><p>two</p><heading>H</heading></description></us-patent-grant>"""
JSON = {
    "us-patent-grant": {
        "us-bibliographic-data-grant": {"references-cited": None, "us-references-cited": {"us-citation": {"patcit": {"document-id": [{"country": "US", "doc-number": "7", "date": None}, None]}}}},
        "claims": {"claim": [{"num": "1", "claim-text": {"text": "a", "claim-text": ["b", {"text": "c", "claim-text": []}, None]}}, {"claim-text": ""}]},
        "abstract": None,
        "description": {"p": {"text": "t", "ul": {"li": ["x", {"text": "y", "ul": {"li": "z"}}]}}},
    }
}


def keys(payload, fmt):
    tree = nested.parse(payload, fmt)
    return {(r[0], r[2], r[3]): r for r in nested.rows_of(tree)} if tree else {}


def test_xml():
    got = keys(XML, "xml")
    assert set(got) == {
        ("claim", "1", ""), ("claim_text", "1.1", "1"), ("claim_text", "1.1.1", "1.1"), ("claim_text", "1.1.1.1", "1.1.1"), ("claim_text", "1.1.2", "1.1"),
        ("abstract_p", "1", ""), ("description_p", "1", ""), ("description_p", "2", ""), ("list_item", "1.1", "1"), ("list_item", "1.1.1", "1.1"),
        ("list_item", "1.2", "1"), ("citation", "1", ""), ("citation", "2", ""), ("document_id", "1.1", "1"), ("document_id", "1.2", "1"),
    }
    assert got["claim_text", "1.1", "1"][1] == "nested" and got["claim_text", "1.1", "1"][4] == "A <b12"
    assert got["claim_text", "1.1.2", "1.1"][4] == "<claim-text>" and got["claim_text", "1.1.1.1", "1.1.1"][1] == "empty"
    assert got["document_id", "1.1", "1"][1] == "dated" and got["document_id", "1.2", "1"][1] == "undated"
    assert got["citation", "2", ""][1] == "other" and got["citation", "2", ""][4] == "A book" and got["claim", "1", ""][5] == "1"


def test_json():
    got = keys(json.dumps(JSON), "json")
    assert set(got) == {
        ("claim", "1", ""), ("claim", "2", ""), ("claim_text", "1.1", "1"), ("claim_text", "1.1.1", "1.1"), ("claim_text", "1.1.2", "1.1"), ("claim_text", "2.1", "2"),
        ("description_p", "1", ""), ("list_item", "1.1", "1"), ("list_item", "1.2", "1"), ("list_item", "1.2.1", "1.2"), ("citation", "1", ""), ("document_id", "1.1", "1"),
    }


def test_ill_formed():
    for payload, fmt in ((None, "xml"), ("", "xml"), ("  ", None), (XML[:-5], "xml"), ('{"a": NaN}', "json"), ("{", None), ("[" * 100_000, "json"), (XML, "json")):
        assert nested.parse(payload, fmt) is None
    assert keys("<other/>", "xml") == {}
    deep = "<us-patent-grant><claims><claim>" + "<claim-text>" * 5000 + "</claim-text>" * 5000 + "</claim></claims></us-patent-grant>"
    assert len(keys(deep, "xml")) == 5001


def test_deep_json():
    texts = [JSON, [], {}, [1.50, -2e3, "a\u00e9\n\\", None, True, {"a": [{}, []]}], "x", {"a": {"a": 1, "b": [[["]"]]]}}]
    for text in map(json.dumps, texts):
        assert nested.deep_json(text) == json.loads(text, object_pairs_hook=nested._Members, parse_int=str, parse_float=str)
    for text in ("[", "]", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "1 2", "", '"a', "[01]", '{a:1}', "[,1]", '{"a":1]', "nul"):
        try:
            nested.deep_json(text)
            raise AssertionError(text)
        except ValueError:
            pass
    deep = '{"us-patent-grant": {"claims": {"claim": ' + '{"claim-text": ' * 20_000 + '""' + "}" * 20_000 + "}}}"
    tree = nested.parse(deep, "json")
    assert len(tree.labels) == 20_003
    assert keys('{"us-patent-grant": {"abstract": {"p": ' + "7" * 5000 + "}}}", "json")["abstract_p", "1", ""][4] == "7" * 5000


def test_tables(spark, tmp_path):
    rows = [(1, "xml", XML), (2, "json", json.dumps(JSON)), (3, "xml", None), (None, None, XML), (1, "xml", XML)]
    df = spark.createDataFrame(rows, "raw_id long, fmt string, payload string").withColumns({"kind": F.lit(0), "key": F.lit(1)})
    flat = nested.flatten(df, "raw_id", "fmt", "payload")
    assert flat.filter("raw_id = 1").count() == 30 and flat.filter("raw_id IS NULL").count() == 15 and flat.filter("raw_id = 3").count() == 0
    tables = nested.Tables.write(df, "raw_id", "fmt", "payload", f"file://{tmp_path}/grants")
    assert sorted(map(str, tables.supertype().collect())) == sorted(map(str, flat.select("raw_id", "kind", "variant", "node_no", "parent_no").collect()))
    ids = tables.typed("document_id", "dated")
    assert ids.columns == ["raw_id", "node_no", "parent_no", "country", "number", "doc_number", "kind_code", "date"]
    assert [(r["number"], r["date"]) for r in ids.collect()] == [(12, 20120101)] * 3
    assert tables.typed("citation", "patent").columns == ["raw_id", "node_no", "parent_no"] and tables.typed("citation", "other").first()["text"] == "A book"
    assert tables.of_kind("document_id").count() == flat.filter("kind = 'document_id'").count()
    assert sum(tables.typed(k, v).count() for k in nested.KINDS for v in nested.TYPED[k]) == flat.count()
    empty = nested.Tables.write(df.limit(0), "raw_id", "fmt", "payload", f"file://{tmp_path}/none")
    assert empty.of_kind("claim").count() == 0
    assert [tuple(r) for r in nested.rejected(df, "raw_id", "fmt", "payload").collect()] == [(3, "null")]
    children = flat.alias("c").join(flat.alias("p"), F.expr("c.raw_id = p.raw_id AND c.parent_no = p.node_no AND c.kind IN ('claim_text', 'list_item') AND p.kind IN ('claim', 'claim_text', 'description_p', 'list_item')"))
    assert children.count() > 0 and nested.flatten(df.limit(0), "raw_id", "fmt", "payload").count() == 0
