"""Problem 9: keyword-stuffed and link-list pages, by rank-frequency curves and divergence from prose.

Three steps over the texts, which are moved to find the distinct ones of prose and the records to be verified:

1. per language, the pairs of neighbouring terms that its distinct prose texts have in common (pairs held by few
   are left out, so the table is bounded: its entries times COMMON are at most the pairs of a record);
   texts zoned as prose that are spam by the pairs of a fifth of it are left out of the prose;
2. per record, the spectrum of its rank-frequency curve (how many terms occur how often) and its
   likeness to prose, the share of such pairs in it. SQL windows turn the spectrum into ranks, and a
   straight line is fitted through log frequency over log rank; the slope, the residual and the
   likeness are compared with the quantiles of prose of the same language and a comparable length;
3. records beyond the quantiles are verified: the characters in link lists, anchor texts, tags and
   repeated key words are counted, and more than half of the text must belong to them.

Common pairs beyond what is sent to the workers are joined with the pairs of the texts instead, so every language has its whole
profile, whatever their number.

Terms are runs of letters, and single characters in scripts without blanks between words. Statistics
come from all records, never from a sample.

Defined results: null, empty and blank texts are no cases; repeated rows are judged alike; a null key
is kept; a record without a language, or unlike the prose of its own, is judged by the language it is most like.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.encoding import _slices
from docquarry.session import materialize

#: Pairs of terms held by at least this share of a language's prose are its common pairs.
COMMON = 0.02
#: Pairs held by this share are common whatever a group of pages, all of them spam, adds to the prose. Prose that is spam by
#: these pairs alone is no prose.
SURELY_COMMON = 0.2
#: Quantiles of prose beyond which a page is verified: the likeness, and either side of slope and residual.
LIKENESS_QUANTILE, CURVE_QUANTILES = 0.10, (0.005, 0.995)
#: A record less like its own language than this is compared with every language.
UNLIKE = 0.15
#: Prose records that a language and length must have for quantiles of its own.
LEAST_PROSE = 30
#: Common pairs that are sent to the workers at most (16 bytes each), those of most texts first; the others are joined with the pairs of the
#: texts. The sizes of so many languages are broadcast, those with the most prose; the others are joined.
MOST_PAIRS, MOST_LANGUAGES = 8_000_000, 10_000
SPAM_SHARE = 0.5
#: For each language the pairs of a text that are common in it and were not sent.
_REST = "array<struct<lang:string,pairs:array<bigint>>>"

_MULTIPLIER = 0x9E3779B97F4A7C15
_LETTER, _SINGLE, _THAI = 1, 2, 3
#: Thai words are of many characters, so for Thai a "pair" is a run of so many.
THAI_RUN = 8


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class (letter, single character, other) and the lower case of every code point."""
    import regex

    from docquarry.llm.bytebpe import class_table

    kind = (class_table() == 0).astype(np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    unspaced = ((r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}]", _SINGLE), (r"\p{Script=Thai}", _THAI))
    for pattern, value in ((r"\p{M}", _LETTER), *unspaced):
        kind[[ord(c) for c in regex.findall(pattern, every)]] = value
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in regex.findall(r"[\p{Lu}\p{Lt}]", every):
        low = c.lower()
        if len(low) == 1:
            lower[ord(c)] = ord(low)
    return kind, lower


@lru_cache(1)
def _powers(n: int = 1 << 16) -> np.ndarray:
    return np.cumprod(np.full(n, _MULTIPLIER, np.uint64))


def terms(data: np.ndarray, offsets: np.ndarray):
    """(text number, 64-bit hash, first character, character after it, Thai or not) of every term of concatenated UTF-8
    texts; characters count from the first text on. The last array holds the texts' first characters."""
    from docquarry.llm.bytebpe import code_points

    kinds, lower = _tables()
    base = offsets[0]
    lead, points = code_points(data[base : offsets[-1]])
    starts = np.searchsorted(lead, offsets[:-1] - base)
    none = np.zeros(0, np.int64)
    if not len(lead):
        return none, np.zeros(0, np.uint64), none, none, none.astype(bool), starts
    kind, points = kinds[points], lower[points].astype(np.uint64)
    begin = kind != 0
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] >= _SINGLE)
    first = starts[starts < len(kind)]
    begin[first] = kind[first] != 0
    ends = np.append(kind[1:] != kind[:-1], True) | (kind >= _SINGLE)
    ends[first[first > 0] - 1] = True
    ends &= kind != 0
    a, b = np.flatnonzero(begin), np.flatnonzero(ends) + 1
    mixed = (points + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    sums = _term_sums(mixed, a, b)
    sums ^= sums >> np.uint64(31)
    text = np.searchsorted(starts, a, "right") - 1
    return text, sums * np.uint64(_MULTIPLIER), a, b, kind[a] == _THAI, starts


def _term_sums(mixed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit sums of the slices a to b."""
    n = b - a
    ends = np.cumsum(n)
    place = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)
    weighted = mixed[place + np.repeat(a, n)] * _powers()[np.minimum(place, len(_powers()) - 1)]
    return np.add.reduceat(weighted, ends - n) if len(n) else np.zeros(0, np.uint64)


def pairs(text: np.ndarray, term: np.ndarray, a: np.ndarray, b: np.ndarray, thai: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it is a pair) of each term and the next: of one text and at most a character apart. Of a Thai character
    it is the run of THAI_RUN that it begins."""
    if len(term) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    near = (text[1:] == text[:-1]) & (a[1:] - b[:-1] <= 1)
    h = (term[:-1] ^ (term[:-1] >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) + term[1:]
    if thai.any():
        near[thai[:-1]] = False
        n = max(len(term) - THAI_RUN + 1, 0)
        at = np.flatnonzero(thai[:n])
        last = at + THAI_RUN - 1
        at = at[(a[last] - a[at] == THAI_RUN - 1) & (text[last] == text[at]) & thai[last]]
        runs = np.zeros(len(at), np.uint64)
        for k in range(THAI_RUN):
            runs = (runs ^ term[at + k]) * np.uint64(_MULTIPLIER)
        h[at], near[at] = runs, True
    return h ^ (h >> np.uint64(29)), near


def _mixed(text: np.ndarray, term: np.ndarray) -> np.ndarray:
    """One 64-bit key of a text's number and a term."""
    return term ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def _counted(text: np.ndarray, term: np.ndarray):
    """(text, term, tf) of the distinct terms of each text, in no order. One sort of a key mixed from both."""
    key = _mixed(text, term)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return text[order[at]], term[order[at]], np.diff(np.append(at, len(key)))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, pair, n) of a partition's prose, combined and sent on whenever many pairs have gathered."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            t, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.string()), pa.array(t.view(np.int64)), pa.array(n)], ["lang", "term", "n"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for x, y, data, off in _slices(batch.column(1)):
            text, term, a, b, thai, _ = terms(data, off)
            pair, near = pairs(text, term, a, b, thai)
            text, pair, _ = _counted(text[: len(pair)][near], pair[near])
            names, codes = np.unique(langs[x:y].astype(str), return_inverse=True)
            of = codes[text]
            for code, lang in enumerate(names.tolist()):
                held.setdefault(lang, []).append(pair[of == code])
            size += len(pair)
            if size > 2_000_000:
                yield from out()
                held.clear()
                size = 0
    yield from out()


class _Index:
    """Sorted keys, each with the codes it occurs with."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        order = np.lexsort((codes, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.ends = np.append(first, len(keys)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        self.codes = codes[order].astype(np.int32)

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of wanted keys that are held, where they are)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[k] == wanted)
        return hit, k[hit]

    def codes_of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, code) of the wanted keys, once for every code of theirs."""
        hit, k = self.places(wanted)
        first = self.ends[k].astype(np.int64)
        many = self.ends[k + 1] - first
        entry = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        return np.repeat(hit, many), self.codes[entry]


class _Profile:
    """The common pairs that are sent, each with the languages it is common in. A language's code is its place in the sorted names of all
    languages that have common pairs, sent or not."""

    def __init__(self, names: list[str], codes=(), pairs=()):
        self.names = sorted(names)
        self.code = {lang: k for k, lang in enumerate(self.names)}
        self.sent = _Index(np.asarray(pairs, np.int64).view(np.uint64), np.asarray(codes, np.int32))

    def rest(self, column: pa.Array) -> _Index | None:
        """The pairs that a join has found for texts, by _mixed keys."""
        if column.null_count == len(column):
            return None
        of, (langs, lists) = pc.list_parent_indices(column).to_numpy(), column.flatten().flatten()
        codes = np.array([self.code[lang] for lang in langs.to_pylist()], np.int32)
        entry = pc.list_parent_indices(lists).to_numpy()
        return _Index(_mixed(of[entry], lists.flatten().to_numpy().view(np.uint64)), codes[entry])

    def judge(self, langs: np.ndarray, text: np.ndarray, pair: np.ndarray, near: np.ndarray, n: int, rest: _Index | None = None):
        """(likeness, language, known) of n texts and their pairs: the likeness is the share of known pairs among all."""
        of = text[: len(pair)]
        inside = text[1:] == text[:-1] if len(text) > 1 else np.zeros(0, bool)
        every = np.maximum(np.bincount(of[inside], minlength=n), 1)
        pairs_at = np.flatnonzero(near)
        at, code = self.sent.codes_of(pair[pairs_at])
        if rest is not None:
            more, other = rest.codes_of(_mixed(of[pairs_at], pair[pairs_at]))
            at, code = np.concatenate([at, more]), np.concatenate([code, other])
        at = pairs_at[at]
        chosen = np.array([self.code.get(lang, -1) for lang in langs], np.int64)
        like = np.bincount(of[at[code == chosen[of[at]]]], minlength=n) / every
        best = langs.copy()
        doubtful = ((like < UNLIKE) | (langs == ""))[of[at]]
        if doubtful.any():
            key, many = np.unique(of[at[doubtful]] << 32 | code[doubtful], return_counts=True)
            t, c = key >> 32, key & ((1 << 32) - 1)
            order = np.lexsort((c, -many, t))  # of each text the language with the most pairs, the first by name of equals
            order = order[np.append(True, np.diff(t[order]) != 0)]
            order = order[many[order] / every[t[order]] > like[t[order]]]
            t, c = t[order], c[order]
            like[t], chosen[t] = many[order] / every[t], c
            best[t] = np.array(self.names, object)[c]
        known = np.zeros(len(pair), bool)
        known[at[code == chosen[of[at]]]] = True
        return like, best, known


def _curves(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile: _Profile = sent.value
        for batch in batches:
            langs = np.array(batch.column(3).to_pylist(), object)
            for x, y, data, off in _slices(batch.column(4)):
                n = y - x
                text, term, a, b, thai, _ = terms(data, off)
                pair, near = pairs(text, term, a, b, thai)
                like, best, _ = profile.judge(langs[x:y], text, pair, near, n, profile.rest(batch.column(5).slice(x, n)))
                text, term, tf = _counted(text, term)
                total = np.bincount(text, tf, n)
                # the spectrum: for each text and frequency, the number of terms
                line, many = np.unique(text << 32 | ((1 << 32) - 1 - tf), return_counts=True)
                f = (1 << 32) - 1 - (line & ((1 << 32) - 1))
                ends = np.append(0, np.cumsum(np.bincount(line >> 32, minlength=n)))
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int32)))
                cols = [batch.column(c).slice(x, n) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(best, pa.string()), pa.array(total.astype(np.int32)), pa.array(like), lists(f), lists(many)],
                    ["key", "row", "prose", "lang", "n_terms", "likeness", "frequency", "terms"],
                )

    return run


_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_ANCHOR = re.compile(r"<a\s[^>]*>.*?</a>|<a\s[^>]*>|</a>|\[[^\[\]\n]+\]\((?:https?://|www\.)[^\s()]*\)", re.S | re.I)
#: A product tag: a code with a digit, a name, a brand in brackets and a price. The price is looked for first, and the code in the text before it.
_PRICE = re.compile(r"\[[^\[\]\n]+\][ \t]*\D{0,3}\d[\d.,]*")
_CODE = re.compile(r"[^\s\[\]]*\d[^\s\[\]]*[ \t]+[^\s\[\]]")
_LINKED, _PRICED = re.compile(r"</?a[\s>]|\]\("), re.compile(r"\][ \t]*\D{0,3}\d")
_HASH = re.compile(r"[#＃][^\s#＃]{2,}")
_NUMBER = re.compile(r"\s*(?:\[\d+\]|\d+[a-z]?[.)]?)(?:\s+|$)")
#: A numbered line is a claim by its content if it names another claim by number or has a claim's linking word.
_CLAIM = re.compile(
    r"\b(?:claims?|anspr[uü]ch\w*|revendications?|reivindicaci[oó]n\w*|rivendicazion\w*|reivindica\w*|пункт\w*|п\.)\s*\d|請求項\s*\d|权利要求\s*\d|제\s*\d+\s*항"
    r"|\b(?:comprising|wherein|umfassend|dadurch gekennzeichnet|comprenant|caractérisée?|отличающ\w+)\b",
    re.I,
)
#: The words between number and link of a bibliographic reference: a name, which has no small initial, and further fields.
_REFERENCE = re.compile(r"(?=[^\W\d_])(?![a-zß-öø-ÿа-я])[^,，、;；\n]+(?:[,，、;；][^,，、;；\n]+)+[,，、;；.:]?\s*")
#: References are beside running text if it is this share of the characters at least; without, they are a list of links.
BESIDE = 0.2
_STOP = re.compile(r"[.!?。！？؟।]+[\"”’»›」』）)\]]*(?=\s|$|[^\W\d_])")
_SYLLABLES = "\u0e00-\u0e7f\u1100-\u11ff\u3040-\u30ff\u3130-\u318f\u3400-\u9fff\uac00-\ud7af"
_LETTERS = re.compile(rf"[{_SYLLABLES}]+|(?:(?![{_SYLLABLES}])[^\W\d_]|[\u0900-\u0963\u064b-\u065f])+")
_RUN = re.compile(r"(.)\1{4,}")
#: A piece of text is running text if the share of common pairs in it is this part, at least, of the median of its
#: language's prose; the second is taken for the median where there is no prose.
RUNNING, USUAL_LIKENESS = 0.6, 0.55
#: Numbered sentences are mostly claims, which are terse: this part of the share makes them running text.
NUMBERED = 0.5
#: The share of a piece's letters that must lie in repeated runs for key words; how often a repeated run occurs, and once more for every
#: so many runs in doubt, as in a long text of any kind most runs come again.
REPEATED_SHARE, REPEATED, REPEATED_PER = 0.4, 3, 5000
#: Key words that make a list.
LEAST_WORDS = 8
_SYLLABIC = re.compile(f"[{_SYLLABLES}]")
_BULLET = re.compile(r"\s*[*•·▪‣>»–-]\s")
_LINE_END = re.compile(r"[^\w\n]*(?:\n|$)")
#: Links, tags or anchors of a list.
LIST = 2
SHORT_LINE = 8
#: Characters before a link that may be its title though they read like prose.
TITLE = 80


def _pieces(text: str) -> list[tuple[int, int, float]]:
    """(from, to, part of the usual share that makes it running text): sentences of long lines, and runs of short lines as
    one piece. The part is 0 for claims by wording and NUMBERED for other numbered sentences."""
    out: list[tuple[int, int, float]] = []
    at, short = 0, -1
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        a, at = at, at + len(line)
        number = _NUMBER.match(line)
        words = a + number.end() if number else a  # the period of a number ends nothing
        claim = bool(number and _CLAIM.search(line))
        if not claim and len(text[words:at].split()) < SHORT_LINE and not _STOP.search(text, words, at):
            short = a if short < 0 else short
            continue
        if short >= 0:
            out.append((short, a, 1.0))
            short = -1
        part, begin = 0.0 if claim else NUMBERED if number else 1.0, a
        for m in _STOP.finditer(text, words, at) if not claim else ():
            out.append((begin, m.end(), part))
            begin = m.end()
        if begin < at:
            out.append((begin, at, part))
    if short >= 0:
        out.append((short, at, 1.0))
    return out


def _grams(word: str) -> list[tuple[int, str]]:
    """(place, run) of the runs of three letters of a word, two where a letter is a syllable or more: near-misses of a key
    word still share most. A shorter word is its own run."""
    size = 2 if _SYLLABIC.search(word) else 3
    if len(word) <= size:
        return [(0, word)]
    return [(k, word[k : k + size]) for k in range(len(word) - size + 1)]


def _tags(text: str) -> Iterator[tuple[int, int]]:
    """The places of product tags: each price with the text before it, from the first code on. Every character is looked at once."""
    last = 0
    for m in _PRICE.finditer(text):
        begin = max(last, text.rfind("\n", last, m.start()) + 1, text.rfind("]", last, m.start()) + 1)
        code = _CODE.search(text, begin, m.start())
        if code:
            yield code.start(), m.end()
        last = m.end()


def _covered(word: str, grams: list[tuple[int, str]], counts: dict[str, int], least: int) -> int:
    """The number of letters of a word that lie in runs repeated so often."""
    total, reach = 0, 0
    for k, g in grams:
        if counts[g] >= least:
            total += k + len(g) - max(reach, k)
            reach = k + len(g)
    return total


def spam_share(text: str, starts: np.ndarray, known: np.ndarray, running_share: float) -> float:
    """The share of a text's characters in link lists, anchor texts, tags, and pieces of repeated key words.

    starts: the first character of each term; known: whether it and the next term are a common pair of prose; running_share:
    the share of such pairs that makes running text.
    """
    n = len(text)
    marked = np.zeros(n, bool)
    sums = np.concatenate([[0], np.cumsum(known)]).tolist()
    places = starts.tolist()

    def running(a: int, b: int, part: float = 1.0) -> bool:
        x, y = bisect_left(places, a), bisect_left(places, b) - 1
        return y > x and sums[y] - sums[x] >= part * running_share * (y - x)

    def spans_of(pattern: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in pattern.finditer(text)]

    for find, mark, least in (
        (lambda: spans_of(_ANCHOR), _LINKED, LIST),
        (lambda: [t for t in _tags(text) if t[1] - t[0] <= TITLE or not running(*t)], _PRICED, LIST + 1),
        (lambda: spans_of(_HASH), _HASH, LIST + 2),
    ):
        if sum(1 for _ in islice(mark.finditer(text), least)) < least:
            continue  # the mark is cheap to look for and in every match
        spans = find()
        if len(spans) >= least:
            for a, b in spans:
                marked[a:b] = True

    links = [m.span() for m in _URL.finditer(text) if not marked[m.start()]]
    pieces = _pieces(text)
    items, references, last = [], [], 0
    for a, b in links:
        begin = max(text.rfind("\n", 0, a) + 1, last)
        number = _NUMBER.match(text, begin, a)
        lead = text[number.end() if number else begin : a]
        if number and _REFERENCE.fullmatch(lead):
            references.append((begin, b))
        elif not _STOP.search(lead.strip()):
            titled = len(lead) <= TITLE and (_BULLET.match(lead) or (number and _LINE_END.match(text, b)))
            if titled or not running(begin, a):
                items.append((begin, b))
        last = b
    cited = np.zeros(n, bool)
    for a, b in references:
        cited[a:b] = True
    if references and sum(b - a for a, b, _ in pieces if cited[a:b].mean() < 0.5 and running(a, b)) < BESIDE * n:
        items += references
        cited[:] = False
    if len(items) >= LIST:
        for a, b in items:
            marked[a:b] = True
    doubtful = []
    grams: dict[str, int] = {}
    for a, b, part in pieces:
        if cited[a:b].mean() > 0.5 or running(a, b, part) or marked[a:b].mean() > 0.6:
            continue
        words = [w.group().lower() for w in _LETTERS.finditer(text, a, b) if not marked[w.start()]]
        words = [w for w in (_RUN.sub(r"\1", w) for w in words) if w]
        cut = [(w, _grams(w)) for w in words]
        doubtful.append((a, b, cut))
        for _, gs in cut:
            for _, g in gs:
                grams[g] = grams.get(g, 0) + 1
    if sum(len(cut) for _, _, cut in doubtful) < LEAST_WORDS:
        doubtful = []
    often = REPEATED + sum(grams.values()) // REPEATED_PER
    for a, b, cut in doubtful:
        size = sum(len(w) for w, _ in cut)
        if size and sum(_covered(w, gs, grams, often) for w, gs in cut) >= REPEATED_SHARE * size:
            marked[a:b] = True
    # white space and separators between marked places belong to them
    edge = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if not re.search(r"\w", text[a:b]):
            marked[a:b] = True
    return float(marked.mean()) if n else 0.0


def _shares(sent: Broadcast, typical: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile: _Profile = sent.value
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            out: list[float] = []
            for x, y, data, off in _slices(batch.column(2)):
                text, term, a, b, thai, starts = terms(data, off)
                pair, near = pairs(text, term, a, b, thai)
                _, best, known = profile.judge(langs[x:y], text, pair, near, y - x, profile.rest(batch.column(3).slice(x, y - x)))
                known = np.append(known, False)
                cut = np.searchsorted(text, np.arange(y - x + 1))
                for k, t in enumerate(batch.column(2).slice(x, y - x).to_pylist()):
                    i, j = cut[k], cut[k + 1]
                    least = RUNNING * typical.get(best[k], USUAL_LIKENESS)
                    out.append(spam_share(t or "", a[i:j] - starts[k], known[i:j], least))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["key", "share"])

    return run


def curve_features(df: DataFrame, profile: Broadcast, kind: str, rest: DataFrame | None = None) -> DataFrame:
    """(row, prose, lang, n_terms, likeness, slope, residual) of records (key, row, prose, lang, text); rest: rest_pairs of them."""
    schema = f"key {kind}, row bigint, prose boolean, lang string, n_terms int, likeness double, frequency array<int>, terms array<int>"
    got = _with_rest(df, rest).select("key", "row", "prose", "lang", "text", "rest").mapInArrow(_curves(profile), schema)
    spectrum = got.select("key", "row", "prose", "lang", "n_terms", "likeness", F.explode(F.arrays_zip("frequency", "terms")).alias("s"))
    spectrum = spectrum.select("key", "row", "prose", "lang", "n_terms", "likeness", F.col("s.frequency").alias("f"), F.col("s.terms").alias("m"))
    ranks = Window.partitionBy("key", "row").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.sum("m").over(ranks)
    x, y = F.log(top - (F.col("m") - 1) / 2), F.log("f")
    points = spectrum.withColumn("x", x).withColumn("y", y)
    m = F.col("m")
    sums = points.groupBy("key", "row").agg(
        *[F.first(c).alias(c) for c in ("prose", "lang", "n_terms", "likeness")],
        F.sum(m).alias("w"),
        F.sum(m * F.col("x")).alias("sx"),
        F.sum(m * F.col("y")).alias("sy"),
        F.sum(m * F.col("x") * F.col("x")).alias("sxx"),
        F.sum(m * F.col("x") * F.col("y")).alias("sxy"),
        F.sum(m * F.col("y") * F.col("y")).alias("syy"),
    )
    sums = sums.withColumn("vx", F.expr("sxx - sx * sx / w")).withColumn("vxy", F.expr("sxy - sx * sy / w")).withColumn("vy", F.expr("syy - sy * sy / w"))
    slope = F.expr("CASE WHEN vx > 1e-9 THEN vxy / vx ELSE 0D END")
    residual = F.expr("CASE WHEN vx > 1e-9 THEN greatest(vy - vxy * vxy / vx, 0D) / w ELSE vy / w END")
    return sums.select("key", "row", "prose", "lang", "n_terms", "likeness", slope.alias("slope"), F.sqrt(F.greatest(residual, F.lit(0.0))).alias("residual"))


def rank_curves(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_terms, slope, residual): the rank-frequency curve of every text with a term; repeated rows of a key and text give one row."""
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.lit(False).alias("prose"), F.lit("").alias("lang"), F.col(text).alias("text")).filter(F.trim("text") != "")
    nothing = df.sparkSession.sparkContext.broadcast(_Profile([]))
    got = curve_features(rows, nothing, df.schema[key].dataType.simpleString())
    return got.select(F.col("key").alias(key), "n_terms", "slope", "residual")


def language(lang: Column) -> Column:
    """The language code of its spellings: en-XX, EN and " en " are en; null and blank become the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(lang), "^[A-Za-z]+", 0)), F.lit(""))


def spam_pages(df: DataFrame, key: str, text: str, lang: str, prose: Column) -> DataFrame:
    """(key, share) of the records found; prose: which records count as prose for comparison."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(
        F.col(key).alias("key"),
        F.xxhash64(text).alias("row"),
        F.coalesce(prose, F.lit(False)).alias("prose"),
        language(F.col(lang)).alias("lang"),
        F.col(text).alias("text"),
    ).filter(F.trim("text") != "")
    told = materialize(prose_texts(rows), "prose")
    counts = materialize(pair_counts(told), "pairs")
    spam = materialize(spam_in_prose(told, counts), "prose-spam")
    sent, unsent = divided(common_pairs(told, counts, spam))
    rest = rest_pairs(rows, sent, unsent)
    features = materialize(curve_features(rows, sent, kind, rest), "curves")
    unfit = spam.select(F.col("row").alias("unfit")).distinct()
    features = features.join(unfit, F.col("row") == F.col("unfit"), "left").withColumn("prose", F.expr("prose AND unfit IS NULL")).drop("unfit")
    median = F.percentile_approx("likeness", F.lit(0.5)).alias("m")
    known = features.filter("prose").dropDuplicates(["lang", "row"])
    typical = {r["lang"]: r["m"] for r in known.groupBy("lang").agg(median).collect() if r["lang"] in sent.value.code}  # a row per language
    flagged = beyond_prose(features).select(F.col("key").alias("fkey"), F.col("row").alias("frow"))
    doubt = rows.join(flagged, (F.col("row") == F.col("frow")) & F.col("key").eqNullSafe(F.col("fkey")), "left_semi")
    doubt = _with_rest(doubt, rest).select("key", "lang", "text", "rest")
    shares = doubt.mapInArrow(_shares(sent, typical), f"key {kind}, share double").filter(F.col("share") > SPAM_SHARE)
    return shares.withColumnRenamed("key", key)


def prose_texts(rows: DataFrame) -> DataFrame:
    """(lang, row, text) of the distinct texts of prose with a language: copies count once."""
    return rows.filter("prose AND lang <> ''").groupBy("lang", "row").agg(F.first("text").alias("text"))


def pair_counts(told: DataFrame) -> DataFrame:
    """(lang, term, n): in how many texts of a language a pair is."""
    partial = told.select("lang", "text").mapInArrow(_document_frequencies, "lang string, term bigint, n bigint")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _common(told: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """(lang, term, n) of the pairs held by a share of each language's texts, written out."""
    sizes = told.groupBy("lang").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    sizes = materialize(sizes, "languages")
    large = F.broadcast(sizes.orderBy(F.desc("size"), "lang").limit(MOST_LANGUAGES))
    sized = counts.join(large, "lang")
    if sizes.count() > MOST_LANGUAGES:
        small = sizes.join(large, "lang", "left_anti")
        sized = sized.unionByName(counts.join(large, "lang", "left_anti").join(small, "lang"))
    common = sized.filter((F.col("n") >= share * F.col("size")) & (F.col("n") > 1))
    return materialize(common.select("lang", "term", "n"), "common-pairs")


def divided(common: DataFrame) -> tuple[Broadcast, DataFrame | None]:
    """The profile of MOST_PAIRS pairs at most, sent, and (lang, term) of the others, if any. A pair is sent for all its languages or for none,
    and those of most texts are sent, so that what is left to a join has no hot key."""
    names = [r["lang"] for r in common.select("lang").distinct().collect()]  # a row per language
    rest = None
    if common.count() > MOST_PAIRS:
        held = common.groupBy("term").agg(F.floor(F.log2(F.sum("n")) * 16).alias("level"))
        common = materialize(common.join(held, "term").select("lang", "term", "level"), "pair-levels")
        total, least = 0, 1 << 20
        for r in common.groupBy("level").agg(F.count("*").alias("pairs")).orderBy(F.desc("level")).collect():  # 16 rows for a power of two
            total += r["pairs"]
            if total > MOST_PAIRS:
                break
            least = r["level"]
        rest, common = common.filter(F.col("level") < least).select("lang", "term"), common.filter(F.col("level") >= least)
    got = common.select("lang", "term").toArrow()  # MOST_PAIRS at most
    codes = pc.index_in(got["lang"], value_set=pa.array(sorted(names), pa.string()))
    profile = _Profile(names, codes.to_numpy(), got["term"].to_numpy())
    return common.sparkSession.sparkContext.broadcast(profile), rest


def _unsent(sent: Broadcast):
    """(row, term) of the distinct pairs of each text that were not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile: _Profile = sent.value
        for batch in batches:
            for x, y, data, off in _slices(batch.column(1)):
                text, term, a, b, thai, _ = terms(data, off)
                pair, near = pairs(text, term, a, b, thai)
                text, pair, _ = _counted(text[: len(pair)][near], pair[near])
                left = np.ones(len(pair), bool)
                left[profile.sent.places(pair)[0]] = False
                rows = batch.column(0).slice(x, y - x).take(pa.array(text[left]))
                yield pa.RecordBatch.from_arrays([rows, pa.array(pair[left].view(np.int64))], ["row", "term"])

    return run


def rest_pairs(rows: DataFrame, sent: Broadcast, unsent: DataFrame | None) -> DataFrame | None:
    """(row, rest): by language, the pairs of each text that are common and were not sent; nothing if all were."""
    if unsent is None:
        return None
    held = rows.select("row", "text").mapInArrow(_unsent(sent), "row bigint, term bigint").join(unsent, "term")
    held = held.groupBy("row", "lang").agg(F.collect_set("term").alias("pairs"))
    return materialize(held.groupBy("row").agg(F.collect_list(F.struct("lang", "pairs")).cast(_REST).alias("rest")), "rest-pairs")


def _with_rest(rows: DataFrame, rest: DataFrame | None) -> DataFrame:
    return rows.withColumn("rest", F.lit(None).cast(_REST)) if rest is None else rows.join(rest, "row", "left")


def spam_in_prose(told: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, row, text) of the texts zoned as prose that are spam by the surely common pairs alone."""
    common = _common(told, counts, SURELY_COMMON)
    sums = lambda of: {r["lang"]: r["n"] for r in of.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # noqa: E731  a row per language
    every = sums(counts)
    usual = {lang: n / every[lang] for lang, n in sums(common).items()}
    sent, unsent = divided(common)
    judged = _with_rest(told, rest_pairs(told, sent, unsent)).select("lang", "row", "text", "rest")
    return judged.mapInArrow(_unlike_prose(sent, usual), "lang string, row bigint, text string")


def _unlike_prose(sent: Broadcast, usual: dict[str, float]):
    """Texts with too few known pairs for running text whose verified share is that of spam. A language without known pairs has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile: _Profile = sent.value
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            found: list[int] = []
            for x, y, data, off in _slices(batch.column(2)):
                text, term, a, b, thai, starts = terms(data, off)
                pair, near = pairs(text, term, a, b, thai)
                like, best, known = profile.judge(langs[x:y], text, pair, near, y - x, profile.rest(batch.column(3).slice(x, y - x)))
                known = np.append(known, False)
                cut = np.searchsorted(text, np.arange(y - x + 1))
                for k in range(y - x):
                    u = usual.get(best[k])
                    if u is not None and like[k] < RUNNING * u:
                        i, j = cut[k], cut[k + 1]
                        if spam_share(batch.column(2)[x + k].as_py(), a[i:j] - starts[k], known[i:j], RUNNING * u) > SPAM_SHARE:
                            found.append(x + k)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in range(3)], ["lang", "row", "text"])

    return run


def common_pairs(told: DataFrame, counts: DataFrame, spam: DataFrame) -> DataFrame:
    """(lang, term, n) of the pairs common in each language's distinct prose without its spam."""
    less = pair_counts(spam).withColumn("n", -F.col("n"))
    left = counts.unionByName(less).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    fit = told.select("lang", "row").join(spam.select("lang", "row"), ["lang", "row"], "left_anti")
    return _common(fit, left, COMMON)


def beyond_prose(features: DataFrame) -> DataFrame:
    """Records whose curve or likeness lies beyond the quantiles of prose of their language and length (in powers of two)."""
    sized = features.withColumn("size", F.floor(F.log2(F.greatest("n_terms", F.lit(1)))).cast("int"))
    quantiles = (
        sized.filter("prose")
        .dropDuplicates(["lang", "row"])
        .groupingSets([["lang", "size"], ["lang"], []], "lang", "size")
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("likeness", F.lit(LIKENESS_QUANTILE)).alias("q_like"),
            F.percentile_approx("slope", F.lit(CURVE_QUANTILES[0])).alias("q_flat"),
            F.percentile_approx("slope", F.lit(CURVE_QUANTILES[1])).alias("q_steep"),
            F.percentile_approx("residual", F.lit(CURVE_QUANTILES[1])).alias("q_residual"),
            F.grouping_id().alias("level"),
        )
        .filter((F.col("n") >= LEAST_PROSE) | (F.col("level") == 3))
    )
    out = sized
    for level, on in ((0, ["lang", "size"]), (1, ["lang"]), (3, [])):
        part = quantiles.filter(F.col("level") == level).select(
            *on, *[F.col(c).alias(f"{c}_{level}") for c in ("q_like", "q_flat", "q_steep", "q_residual")]
        )
        part = F.broadcast(part)  # a row per language and power of two, at most
        out = out.join(part, on, "left") if on else out.join(part, F.lit(True), "left")
    for c in ("q_like", "q_flat", "q_steep", "q_residual"):
        out = out.withColumn(c, F.coalesce(f"{c}_0", f"{c}_1", f"{c}_3"))
    return out.filter(
        F.col("q_like").isNull()
        | (F.col("likeness") < F.col("q_like"))
        | (F.col("slope") < F.col("q_flat"))
        | (F.col("slope") > F.col("q_steep"))
        | (F.col("residual") > F.col("q_residual"))
    ).select("key", "row", "lang", "n_terms", "likeness", "slope", "residual")
