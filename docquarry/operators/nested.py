"""Deeply nested records to flat tables: a tree automaton over XML and JSON payloads.

Both formats become one tree of elements. A bottom-up run of the automaton gives every element the
shape of its subtree (the variant) from its label, its text and its children's shapes; a top-down
run gives it its place (the kind), so that an element counts only on its proper path. All elements
of a kind share the supertype keys (record, kind, node number, parent number); each kind and
variant is routed to a typed table of its own with the same keys, and with columns of its own.

The work is one narrow stage: a record is parsed where it is read, nothing is shuffled, and a record's
elements leave as rows, so nothing is collected. ``Tables`` writes all of them in one parse.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import html5
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of elements: (place of the parent, label) to the element's own. Lower-case places are kinds with rows; the
#: others are on the way to them, and a row's parent is the nearest kind above.
PLACES = {
    ("", "us-patent-grant"): "GRANT",
    ("GRANT", "claims"): "CLAIMS",
    ("GRANT", "abstract"): "ABSTRACT",
    ("GRANT", "description"): "DESCRIPTION",
    ("GRANT", "us-bibliographic-data-grant"): "BIBLIOGRAPHIC",
    ("BIBLIOGRAPHIC", "references-cited"): "REFERENCES",
    ("BIBLIOGRAPHIC", "us-references-cited"): "REFERENCES",
    ("CLAIMS", "claim"): "claim",
    ("claim", "claim-text"): "claim_text",
    ("claim_text", "claim-text"): "claim_text",
    ("ABSTRACT", "p"): "abstract_p",
    ("DESCRIPTION", "p"): "description_p",
    ("description_p", "ul"): "LIST",
    ("list_item", "ul"): "LIST",
    ("LIST", "li"): "list_item",
    ("REFERENCES", "citation"): "citation",
    ("REFERENCES", "us-citation"): "citation",
    ("citation", "patcit"): "PATENT",
    ("PATENT", "document-id"): "document_id",
}
KINDS = ("claim", "claim_text", "abstract_p", "description_p", "list_item", "citation", "document_id")

#: Elements that hold others rather than text of the element above.
STRUCTURE = {label for _, label in PLACES} | {"country", "doc-number", "kind", "date", "nplcit", "othercit", "heading"}
#: Leaf elements kept as fields of the element above: (label, field).
FIELDS = {"country": "country", "doc-number": "doc_number", "kind": "kind_code", "date": "date", "othercit": "other"}

#: Bottom-up states of subtrees.
EMPTY, TEXT, MARKED, NESTED, PATENT, OTHER, DATED, UNDATED, PARTIAL = (
    "empty", "text", "marked", "nested", "patent", "other", "dated", "undated", "partial",
)

SCHEMA = (
    "key {key}, kind string, variant string, node_no string, parent_no string, text string, num string,"
    " country string, doc_number string, kind_code string, date string"
)


def shape(label: str, has_text: bool, below: set[tuple[str, str]]) -> str:
    """The automaton's transition: the state of an element from its label, text and the (label, state) of its children."""
    labels = {x for x, _ in below}
    if label == "document-id":
        if not below and not has_text:
            return EMPTY
        if not {"country", "doc-number"} <= labels:
            return PARTIAL
        return DATED if ("date", TEXT) in below else UNDATED
    if label in ("citation", "us-citation"):
        return PATENT if "patcit" in labels else OTHER if "nplcit" in labels else EMPTY
    if labels & STRUCTURE:
        return NESTED
    if below:
        return MARKED
    return TEXT if has_text else EMPTY


class _Tree:
    """Elements in document order: label, parent, attribute num, and text as (place in the document, characters)."""

    def __init__(self) -> None:
        self.labels: list[str] = []
        self.parents: list[int] = []
        self.nums: list[str | None] = []
        self.texts: list[list[tuple[int, str]]] = []
        self.place = 0

    def add(self, label: str, parent: int, num: str | None = None) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.nums.append(num)
        self.texts.append([])
        return len(self.labels) - 1

    def say(self, at: int, text: str) -> None:
        self.texts[at].append((self.place, text))
        self.place += 1


def joined(texts: list[tuple[int, str]]) -> str:
    """Characters in document order."""
    return "".join(x for _, x in sorted(texts))


def read_xml(payload: str, foreign: bool = False) -> _Tree:
    """The tree of a well-formed document; comments count for nothing, CDATA is text. Raises expat.error otherwise.

    Entities that the document declares are replaced. With foreign, a declaration outside the document is taken for granted: of the entities it
    may declare, those with a public name become their characters, and others stay as they are written.
    """
    tree, stack = _Tree(), [-1]
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    if foreign:
        parser.UseForeignDTD(True)
        parser.SkippedEntityHandler = lambda name, is_parameter: None if is_parameter else tree.say(stack[-1], html5.get(f"{name};", f"&{name};"))

    def start(name, attributes):
        stack.append(tree.add(name, stack[-1], attributes.get("num")))

    def chars(text):
        tree.say(stack[-1], text)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = chars
    parser.Parse(payload.encode("utf-8"), True)
    return tree


_JSON_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|$)'
)
_END = ""


def deep_json(payload: str):
    """The value of a JSON text nested to any depth, read without recursion; like ``json.loads`` with ``_Members`` and numbers as texts."""
    at = 0

    def token() -> tuple[str, str | None, str | None]:
        nonlocal at
        m = _JSON_TOKEN.match(payload, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        return m[1] or _END, m[2], m[3]

    words = {"true": True, "false": False, "null": None}
    top: list = []
    open_: list = [top]  # the containers being read
    names: list[str] = []  # the member names of the objects among them
    mark, text, word = token()
    while True:
        if mark in ("{", "["):  # a value begins
            inside = _Members() if mark == "{" else []
            open_.append(inside)
            first = True
        else:
            if text is None and word is None:
                raise ValueError(f"no value at {at}")
            value = json.loads(text) if text is not None else words.get(word, word)
            open_[-1].append((names.pop(), value) if isinstance(open_[-1], _Members) else value)
            first = False
        while True:  # to the next value
            now = open_[-1]
            if now is top:
                if token() != (_END, None, None):
                    raise ValueError("more after the value")
                return top[0]
            mark, text, word = token()
            closing = "}" if isinstance(now, _Members) else "]"
            if mark == closing:
                open_.pop()
                up = open_[-1]
                up.append((names.pop(), now) if isinstance(up, _Members) else now)
                first = False
                continue
            if not first:
                if mark != ",":
                    raise ValueError(f"no comma at {at}")
                mark, text, word = token()
            if isinstance(now, _Members):
                if text is None or token()[0] != ":":
                    raise ValueError(f"no member at {at}")
                names.append(json.loads(text))
                mark, text, word = token()
            break


class _Members(list):
    """The members of a JSON object in their order, repeated names included."""


def _no_constant(name):
    raise ValueError(f"{name} is no JSON")


def read_json(payload: str) -> _Tree:
    """The tree of a JSON object: members are elements, arrays repeated elements, nulls nothing. Raises ValueError."""
    try:
        top = json.loads(payload, object_pairs_hook=_Members, parse_constant=_no_constant, parse_int=str, parse_float=str)
    except RecursionError:
        top = deep_json(payload)
    tree = _Tree()
    todo = [("", -1, top)]
    while todo:
        label, parent, value = todo.pop()
        if value is None:
            continue
        if isinstance(value, list) and not isinstance(value, _Members):
            todo.extend((label, parent, x) for x in reversed(value))
        elif isinstance(value, _Members):
            at = tree.add(label, parent) if label else -1
            for name, x in reversed(value):
                if name == "text" and at >= 0 and isinstance(x, str):
                    tree.say(at, x)
                elif name == "num" and at >= 0 and not isinstance(x, list):
                    tree.nums[at] = None if x is None else str(x)
                else:
                    todo.append((name, at, x))
        elif label:
            text = value if isinstance(value, str) else json.dumps(value)
            tree.say(tree.add(label, parent), text)
    return tree


def rows_of(tree: _Tree) -> Iterator[tuple]:
    """(kind, variant, node_no, parent_no, text, num, country, doc_number, kind_code, date) of a tree's elements."""
    n = len(tree.labels)
    below: list[set] = [set() for _ in range(n)]
    states = [""] * n
    for k in range(n - 1, -1, -1):  # children come after their parents
        states[k] = shape(tree.labels[k], any(x.strip() for _, x in tree.texts[k]), below[k])
        if tree.parents[k] >= 0:
            below[tree.parents[k]].add((tree.labels[k], states[k]))
    places = [""] * n
    owner = [-1] * n  # the nearest element with rows, at or above
    numbers = [""] * n
    text: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    fields: list[dict] = [{} for _ in range(n)]
    counts: dict[tuple[int, str], int] = {}
    made = []
    for k in range(n):
        up = tree.parents[k]
        place = PLACES.get((places[up] if up >= 0 else "", tree.labels[k]), "")
        above = owner[up] if up >= 0 else -1
        if place in KINDS:
            counts[above, place] = number = counts.get((above, place), 0) + 1
            numbers[k] = f"{numbers[above]}.{number}" if above >= 0 else str(number)
            owner[k] = k
            made.append((k, above, place))
            text[k].extend(tree.texts[k])
        else:
            owner[k] = above
            if above >= 0:
                field = FIELDS.get(tree.labels[k])
                if field:
                    fields[above].setdefault(field, joined(tree.texts[k]))
                elif tree.labels[k] not in STRUCTURE:
                    text[above].extend(tree.texts[k])  # mark-up inside text
        places[k] = place or "-"
    for k, above, kind in made:
        f = fields[k]
        words = joined(text[k]) if kind not in ("citation", "document_id") else f.get("other")
        parent = numbers[above] if above >= 0 else ""
        yield (kind, states[k], numbers[k], parent, words, tree.nums[k], f.get("country"), f.get("doc_number"), f.get("kind_code"), f.get("date"))


def parse(payload: str | None, fmt: str | None, foreign: bool = False) -> _Tree | None:
    """The tree of a payload, or None if it is null, blank or not well-formed. Without a format, "{" begins JSON. foreign: see ``read_xml``."""
    if payload is None or not payload.strip():
        return None
    if fmt is None:
        fmt = "json" if payload.lstrip().startswith("{") else "xml"
    try:
        return read_json(payload) if fmt.strip().lower() == "json" else read_xml(payload, foreign)
    except (ValueError, expat.ExpatError):
        return None


def flatten(df: DataFrame, key: str, fmt: str, payload: str) -> DataFrame:
    """The supertype table: (key, kind, variant, node_no, parent_no, text, num, country, doc_number, kind_code, date).

    Null, blank and ill-formed payloads give no rows; repeated payloads give rows under their own keys;
    a null key is kept. Empty elements count; nulls and empty arrays do not.
    """
    names = [c.split()[0] for c in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in names]
                for k, f, p in zip(*(part.column(c).to_pylist() for c in range(3))):
                    tree = parse(p, f)
                    for row in rows_of(tree) if tree else ():
                        for column, v in zip(out, (k, *row)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], batch.schema.field(0).type), *(pa.array(x, pa.string()) for x in out[1:])], names
                )

    source = df.select(F.col(key).alias("key"), F.col(fmt).alias("fmt"), F.col(payload).alias("payload"))
    schema = SCHEMA.format(key=df.schema[key].dataType.simpleString())
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def rejected(df: DataFrame, key: str, fmt: str, payload: str) -> DataFrame:
    """(key, reason): the payloads that give no rows, being null, blank or ill-formed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, reasons = [], []
            for k, (f, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if parse(p, f) is None:
                    keep.append(k)
                    reasons.append("null" if p is None else "ill-formed" if p.strip() else "blank")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(reasons, pa.string())], ["key", "reason"])

    source = df.select(F.col(key).alias("key"), F.col(fmt).alias("fmt"), F.col(payload).alias("payload"))
    return source.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, reason string").withColumnRenamed("key", key)


_NUMBER = "try_cast(ltrim('0', doc_number) AS bigint) AS number"
_WORDS = {EMPTY: [], TEXT: ["text"], MARKED: ["text"], NESTED: ["text"]}
#: The columns of the typed tables: kind to variant to columns beside the supertype's keys.
TYPED: dict[str, dict[str, list[str]]] = {
    "claim": {v: ["num", *columns] for v, columns in _WORDS.items()},
    **{kind: _WORDS for kind in ("claim_text", "abstract_p", "description_p", "list_item")},
    "citation": {PATENT: [], OTHER: ["text"], EMPTY: []},
    "document_id": {
        DATED: ["country", _NUMBER, "doc_number", "kind_code", "try_cast(date AS int) AS date"],
        UNDATED: ["country", _NUMBER, "doc_number", "kind_code"],
        PARTIAL: ["country", "doc_number", "kind_code", "date AS date_text"],
        EMPTY: [],
    },
}


class Tables:
    """The typed tables of a collection of records, written in one parse: a folder per kind and variant."""

    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str):
        self.key = key
        fields = SCHEMA.format(key=key_type).split(", ")
        self.rows = spark.read.schema(", ".join([f"`{key}` {key_type}", *fields[1:]])).parquet(path)

    @classmethod
    def write(cls, df: DataFrame, key: str, fmt: str, payload: str, path: str) -> Tables:
        """Parses the payloads, routes each element to its kind and variant, and opens what was written."""
        flatten(df, key, fmt, payload).write.mode("overwrite").partitionBy("kind", "variant").parquet(path)
        return cls(df.sparkSession, path, key, df.schema[key].dataType.simpleString())

    def supertype(self) -> DataFrame:
        """(key, kind, variant, node_no, parent_no) of all elements."""
        return self.rows.select(self.key, "kind", "variant", "node_no", "parent_no")

    def typed(self, kind: str, variant: str) -> DataFrame:
        """(key, node_no, parent_no, the variant's own columns); only its folder is read."""
        rows = self.rows.filter((F.col("kind") == kind) & (F.col("variant") == variant))
        return rows.selectExpr(f"`{self.key}`", "node_no", "parent_no", *TYPED[kind][variant])

    def of_kind(self, kind: str) -> DataFrame:
        """(key, variant, node_no, parent_no, the columns of all variants) of a kind, columns a variant lacks being null."""
        out = None
        for variant in TYPED[kind]:
            one = self.typed(kind, variant).withColumn("variant", F.lit(variant))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out
