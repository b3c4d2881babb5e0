"""Problem 4: sentence boundaries across languages and scripts, by a semi-Markov dynamic program.

Places where a sentence could end (after a run of terminators and its closing marks, at line breaks, headings and blank
lines, at blanks in Thai) are candidates with a score each. The program chooses whole spans between candidates and maximises
the sum of their scores; a span's score joins its length, its opening word, its closing word and
the balance of its quotation marks and brackets: marks are matched first, and a span that begins or ends between a mark
and its partner loses more for either end than any end gains, so a quotation of any number of sentences stays whole.

The program looks at every span. Beyond FAR characters the score of the length is constant, so for those spans the best
beginning is a running maximum; nearer ones are tried until none can be better. The work is linear in the text.

Defined results: null, empty and blank zones give no rows; a text without terminators is one unit; all
text but white space lies in exactly one unit; positions count Unicode code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import inf, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks.
TERMINATORS = ".!?。！？؟।॥…．｡‽"
CLOSERS = "\"”’»›」』）)]】］〕}“"
OPENERS = "\"“„«‹「『（([【［〔{¿¡‘"

#: Abbreviations after which a sentence goes on, whatever follows.
NEVER = set(
    """fig figs nos pat pats ser cf e.g i.e vs approx dia acc incl prof dr mr mrs wt u.s viz al eqs refs appl co dept
    sept oct nov dec jan feb aug n.b n.a
    abb bzw vgl ggf z evtl inkl sog gem zzgl mind bspw d.h z.b
    env réf mme mlle c.-à c.-à-d p.ex
    sr sra srta núm pág págs aprox ej p.ej
    рис т см табл им гл ул проф напр т.е
    डॉ मि श्री प्रो कि
    د أ""".split()
)
#: The same, but only before a number or a small letter: some are words too.
NUMBERED = set(
    """no vol vols pp p sec secs st eq ref ex app ca ch art cap col cols tab temp resp fig par para para cl ed ud uds n° chap
    nr lt hr fr tel str ziff kap
    стр г д тыс напр
    सं पृ मि""".split()
)
#: Abbreviations and units that end a sentence only if a new one seems to open.
MAYBE = set(
    """in c f n v w j inc ltd corp etc a.m p.m jr ft oz lb yd min max hrs cm mm kg m g s l
    usw u.a e.v gmbh d.h i.d.r s.a s.l мин сек долл руб см мм кг гг वगैरह मिमी किग्रा""".split()
)
#: Words that open sentences though they follow a number and a period in German.
GERMAN_OPENERS = set(
    """der die das den dem ein eine einer eines im in am an auf aus bei beim dabei laut gemäß ist sind wird werden wurde war ferner
    mit nach zum zur zu es er sie wir wenn weil da dadurch dazu durch für von vom vor über unter um so somit sofern falls als
    alle jede jeder jedes dieser diese dieses diesen weiter weiterhin außerdem zudem auch nur hier hierbei hat haben kann können
    soll muss nie niemals nicht beschreibung stand ohne zwischen neben während wie was wer wo welche nachdem bevor bis seit""".split()
)
#: Words that go on with a sentence after a closing quotation mark, in scripts without capitals.
GO_ON_AFTER_QUOTE = {
    "Arab": set("قرب على في من عند فوق تحت بجانب إلى عن مع و أو ثم حيث التي الذي".split()),
    "Deva": set("लिखा लिखी कहा पर का के की को से में और है हैं या तक नामक अंकित".split()),
    "Hang": set("라고 라는 이라고 라며 하고 의 를 을 은 는 이 가 와 과 로 으로".split()),
}
#: First characters that go on with a sentence after a closing quotation mark, in Japanese and Chinese.
GO_ON_CHARS = set("とのをはがにでもやへ、，,；;：:并的等字之和与及而，")

_STOPS = {
    "en": set("the of and to a in is for by with said or on at".split()),
    "de": set("der die das und ist mit von im zu den eine ein bei wird dem unter".split()),
    "fr": set("le la les et est du de un une des dans par pour au sur".split()),
    "es": set("el la los y es de un una en por para con al se del".split()),
}
#: A letter, or a mark that belongs to one.
_L = r"(?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0970-\u097f\u0e30-\u0e4e])"
_WORD = re.compile(rf"{_L}+(?:['’-]{_L}+)*")
_END = re.compile(
    r"(?:(?<![.\s])[.．](?:\s?[.．]){0,2}|[!?。！？؟।॥…｡‽])[.!?。！？؟।॥…．｡‽]*(?:[\"”’»›」』）)\]】］〕}“]|\s?[»”](?=\s|$|[^\w\s]))*"
)
_BLANK_LINES = re.compile(r"[^\S\n]*\n[^\S\n]*\n\s*")
_ENDED = re.compile(r"[.!?。！？؟।॥][\"”’»›」』）)\]】］〕}“]*$")
_LINE = re.compile(r"\s*\n\s*")
_SPACE = re.compile(r"\s+")
_LAST_WORD = re.compile(rf"(?:(?<![^\W\d_]){_L}\.(?:-?{_L}{{1,3}}\.)*-?{_L}{{1,3}}|(?:{_L}|\d)+(?:[’'-](?:{_L}|\d)+)*)$")
_THAI = re.compile(r"[฀-๿]")
_NUMBERED = re.compile(r"\[\d+\]\s*$")


def script(ch: str) -> str:
    """The script of a letter, as far as the rules need it."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "Latn"
    if 0x400 <= o < 0x530:
        return "Cyrl"
    if 0x590 <= o < 0x780 or 0x8A0 <= o < 0x900 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFF00:
        return "Arab"
    if 0x900 <= o < 0x980:
        return "Deva"
    if 0xE00 <= o < 0xE80:
        return "Thai"
    if 0xAC00 <= o < 0xD7B0 or 0x1100 <= o < 0x1200 or 0x3130 <= o < 0x3190:
        return "Hang"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "Hani"
    return "Latn"


def latin_language(text: str) -> str:
    """The likeliest of the Latin-script languages, by its commonest words; the lang column is often wrong or null."""
    words = Counter(_WORD.findall(text.lower()))
    return max(_STOPS, key=lambda k: sum(words[w] for w in _STOPS[k]))


_GERMAN = re.compile(rf"\b(?:{'|'.join(sorted(_STOPS['de']))})\b", re.I)


class _Language:
    """The likeliest Latin-script language of a text, found when first asked for: few texts need it; and the words learned from the corpus."""

    def __init__(self, text: str, learned: dict[str, str]):
        self.text, self.name, self.learned = text, "", learned

    def is_german(self) -> bool:
        if not self.name:
            self.name = latin_language(self.text) if _GERMAN.search(self.text) else "other"
        return self.name == "de"


#: No word of the lists is longer than this.
LONGEST = 24


def _closing(text: str, begin: int, at: int, language: _Language) -> str:
    """The class of the closing word before the terminators at position at of the part from begin: strong, maybe, never, initial or
    ordinal."""
    if text[at] not in ".．":
        return "weak" if text[at] == "…" else "strong"
    if text[at : at + 2] == ".." or (at > begin and text[at - 1] in " \n"):
        return "weak"  # suspension points
    before = text[max(begin, at - LONGEST) : at]
    m = _LAST_WORD.search(before, max(before.rfind(" "), before.rfind("\n")) + 1)
    if not m:
        return "strong"
    word = m.group().lower()
    if word[-1].isdigit():
        if word.isdigit() and len(word) <= 2 and language.is_german():
            lead = _LAST_WORD.search(before[: m.start()].rstrip(" \n."))
            if not lead or lead.group().lower() not in ("nr", "abb", "fig", "kap", "nummer"):
                return "ordinal"
        return "strong"
    if len(word) == 1 and word.isalpha():
        lead = before[: m.start()].rstrip()
        if lead[-1:] == "°" or lead[-1:].isdigit():
            return "maybe"  # a unit
        return "initial"
    if word in NEVER or "." in word and any(word[k + 1 :] in NEVER for k, c in enumerate(word) if c == "."):
        return "never"
    if word in NUMBERED:
        return "numbered"
    if word in MAYBE or "." in word:
        return "maybe"
    if word.rsplit("'", 1)[-1] in NEVER or word.rsplit("’", 1)[-1] in NEVER:
        return "never"
    if script(word[-1]) == "Deva" and len(word) < 4:
        return "never"
    return language.learned.get(word, "strong")


def _opening(text: str, at: int, end: int) -> tuple[str, str]:
    """(class, first word) of what opens at position at: upper, lower, mixed, digit, caseless, mark or none."""
    k = at
    while k < end and (text[k].isspace() or text[k] in OPENERS):
        if text[k] in "¿¡":
            return "upper", ""
        k += 1
    if k >= end:
        return "none", ""
    ch = text[k]
    if ch.isdigit() or ch in ".．" and k + 1 < end and text[k + 1].isdigit():
        return "digit", ""
    if not ch.isalpha():
        return "mark", ch
    m = _WORD.match(text, k, end)
    word = m.group() if m else ch
    if ch.isupper() or ch.istitle():
        return "upper", word
    if ch.islower():
        return ("mixed" if any(c.isupper() for c in word[1:3]) else "lower"), word
    return "caseless", word


#: Scores of a boundary between a closing and an opening class.
BOUNDARY = {
    ("strong", "upper"): 4.0, ("strong", "digit"): 3.0, ("strong", "mixed"): 3.0, ("strong", "caseless"): 4.0, ("strong", "lower"): -3.0, ("strong", "mark"): -2.0,
    ("maybe", "upper"): 2.5, ("maybe", "digit"): 0.5, ("maybe", "mixed"): 2.0, ("maybe", "caseless"): 1.5, ("maybe", "lower"): -8.0, ("maybe", "mark"): -4.0,
    ("ordinal", "upper"): -4.0, ("ordinal", "digit"): 1.0, ("ordinal", "mixed"): 1.0, ("ordinal", "caseless"): 1.0, ("ordinal", "lower"): -8.0, ("ordinal", "mark"): -4.0,
    ("weak", "upper"): 1.5, ("weak", "digit"): -2.0, ("weak", "mixed"): -2.0, ("weak", "caseless"): -3.0, ("weak", "lower"): -8.0, ("weak", "mark"): -4.0,
}
#: The score of each end of a span that lies between a mark and its partner, per pair. Two of them, as every end is also a beginning,
#: outweigh the best boundary and length.
UNBALANCED = -6.0
LENGTH_WEIGHT = 0.12
USUAL_LENGTH = 70.0
#: Spans of this many characters or more score alike by their length.
FAR = 1500
#: The score of ends that are certain (blank lines, headings, lines of a text without hard wraps), and of blanks that end a Thai sentence.
CERTAIN, THAI = 40.0, 12.0


def _boundary(text: str, begin: int, stop: int, after: int, end: int, language: _Language) -> float:
    """The score of an end, in the part from begin to end, whose terminators begin at stop and whose closing marks end at after."""
    how = _closing(text, begin, stop, language)
    if how in ("never", "initial"):
        return -9.0
    kind, word = _opening(text, after, end)
    if kind == "none":
        return 4.0
    if how == "numbered":
        if kind in ("digit", "lower", "mark"):
            return -9.0
        how = "strong"
    spaced = text[after].isspace()
    closed = text[after - 1] in CLOSERS
    if kind in ("caseless",) and closed and text[after - 1] not in ")]）】］〕}":
        known = GO_ON_AFTER_QUOTE.get(script(word[0]))
        if known is not None:
            if word in known or not spaced:
                return -9.0
        elif word[0] in GO_ON_CHARS:
            return -9.0
    if kind == "mark" and (word in "-–—,;:，、；：/%°" or not spaced):
        return -9.0
    if kind == "mark":
        return 2.0 if how == "strong" else -2.0
    if how == "ordinal" and kind == "upper" and word.lower() in GERMAN_OPENERS:
        return 3.0
    score = BOUNDARY[how, kind]
    if not spaced:  # paragraphs put together without a separator
        last = text[stop - 1] if stop > begin else ""
        letter = text[after - 1] in TERMINATORS and last.isalpha() and script(last) in ("Latn", "Cyrl")
        if kind == "digit" and text[stop] in ".．" and (not last or last.isdigit() or not closed):
            return -9.0 if last.isdigit() or letter else score
        if kind in ("lower", "mixed"):
            return -9.0 if kind == "lower" else score - 2.0
    return score


_MARKS = re.compile(r"[()（）\[\]【】［］〔〕{}„“”«»「」『』\"]")
#: Kinds of marks: an opening mark's kind, and the kinds a closing mark may close.
_OPENING = {"(": "()", "（": "()", "[": "[]", "【": "[]", "［": "[]", "〔": "[]", "{": "[]", "„": "„", "“": "“", "«": "«", "「": "「", "『": "『"}
_CLOSING = {")": ("()",), "）": ("()",), "]": ("[]",), "】": ("[]",), "］": ("[]",), "〕": ("[]",), "}": ("[]",), "”": ("“", "„"), "»": ("«",), "」": ("「",), "』": ("『",)}


def _straight(text: str, k: int, a: int, b: int, is_open: bool) -> bool:
    """Whether the straight quotation mark at k opens: by the blanks beside it, and in turn where they say nothing."""
    before, after = text[k - 1] if k > a else " ", text[k + 1] if k + 1 < b else " "
    outer, inner = before.isspace() or before in OPENERS, after.isspace() or not (after.isalnum() or after in OPENERS)
    if outer != inner:
        return outer
    return not is_open


def _depths(text: str, a: int, b: int) -> tuple[list[int], list[int]]:
    """(places, depths): the number of matched pairs of marks that are open from each place in a part on, up to the next.

    A mark without a partner opens nothing; an opening quotation mark of a kind that is open already takes the former's place.
    """
    pairs, held = [], {}
    for m in _MARKS.finditer(text, a, b):
        k, ch = m.start(), m.group()
        if ch == "\"":
            stack = held.setdefault(ch, [])
            if k > a and text[k - 1].isdigit() and not stack:
                continue  # inches
            if _straight(text, k, a, b, bool(stack)):
                held[ch] = [k]
            elif stack:
                pairs.append((stack.pop(), k))
        elif ch in _OPENING and not (ch == "“" and held.get("„")):
            stack = held.setdefault(_OPENING[ch], [])
            if ch in "„“":
                stack.clear()
            stack.append(k)
        else:
            for kind in ("„",) if ch == "“" else _CLOSING[ch]:
                if held.get(kind):
                    pairs.append((held[kind].pop(), k))
                    break
    if not pairs:
        return [], []
    changes = sorted([(k + 1, 1) for k, _ in pairs] + [(k + 1, -1) for _, k in pairs])
    return [k for k, _ in changes], list(accumulate(d for _, d in changes))


def _length(n: int) -> float:
    return -LENGTH_WEIGHT * log(max(n, 1) / USUAL_LENGTH) ** 2 - (3.0 if n < 3 else 0.0)


_LENGTHS = [_length(n) for n in range(FAR + 1)]


def _heading(line: str, following: str) -> bool:
    """A short line of its own without a terminator, before a line that opens anew."""
    line = line.strip()
    if not line or not following or len(line) > 42 or line[-1] in TERMINATORS or line[-1] in ",;:-–、，；：":
        return False
    if line[-1] in "»”\"“)」" and len(line) > 1 and line[-2] in TERMINATORS or re.search(r"[,;:.] ", line):
        return False
    kind, _ = _opening(line, 0, len(line))
    if kind == "lower" or kind == "none":
        return False
    if kind == "caseless" and script(line[0]) in ("Hani", "Thai", "Hang", "Deva", "Arab") and len(line) > 24:
        return False
    return _opening(following, 0, len(following))[0] in ("upper", "digit", "caseless", "mixed")


def _parts(text: str) -> Iterator[tuple[int, int]]:
    """Parts that certain ends divide: blank lines, headings, and the lines of a text that is not hard-wrapped."""
    at = 0
    blocks = []
    for m in _BLANK_LINES.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    wrapped = len(blocks) > 1 or max((len(x) for x in text.split("\n")), default=0) <= 90
    for a, b in blocks:
        lines = []
        start = a
        for m in _LINE.finditer(text, a, b):
            lines.append((start, m.start()))
            start = m.end()
        lines.append((start, b))
        begin = a
        for k, (x, y) in enumerate(lines):
            if k + 1 == len(lines):
                yield begin, b
                break
            following = text[lines[k + 1][0] : lines[k + 1][1]]
            ended = x == begin or _ENDED.search(text, max(begin, x - 40), lines[k - 1][1]) is not None
            own = ended and _heading(text[x:y], following)
            kind, _ = _opening(following, 0, len(following))
            if own and x != begin:
                yield begin, lines[k - 1][1]
                begin = x
            if own or (not wrapped and kind not in ("lower", "mark", "none")):
                yield begin, y
                begin = lines[k + 1][0]


def _thai(text: str, a: int, b: int) -> Iterator[tuple[int, float]]:
    """Thai: a blank ends a sentence unless a numeral, a Latin letter or a period adjoins it."""
    for m in _SPACE.finditer(text, a, b):
        beside = text[m.start() - 1], text[m.end()]
        if not any(c.isdigit() or c == "." or c.isascii() and c.isalpha() for c in beside):
            yield m.start(), THAI


def _stops(text: str, a: int, b: int, language: _Language) -> Iterator[tuple[int, float]]:
    """(end, score) of the terminators in a part after which a sentence could end."""
    last = a
    for m in _END.finditer(text, a, b):
        if m.end() >= b:
            break
        s = _boundary(text, a, m.start(), m.end(), b, language)
        if s > -9.0 and not (text[m.end() - 1] == "]" and _NUMBERED.search(text, last, m.end())):
            last = m.end()
            yield last, s


def sentences(text: str, learned: dict[str, str] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in order, without white space at their ends. learned: classes of closing words, as ``learn`` finds them."""
    language = _Language(text, learned or {})
    starts: list[int] = []
    ends: list[int] = []
    scores: list[float] = []
    depths: list[int] = []
    has_thai = _THAI.search(text) is not None
    for a, b in _parts(text):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            continue
        starts.append(a)
        thai = has_thai and len(_THAI.findall(text, a, b)) * 3 > sum(c.isalpha() for c in text[a:b])
        found = list(_thai(text, a, b) if thai else _stops(text, a, b, language))
        places, open_ = _depths(text, a, b) if found and not thai else ([], [])
        for end, score in found:
            ends.append(end)
            scores.append(score)
            k = bisect_right(places, end) - 1 if places else -1
            depths.append(open_[k] if k >= 0 else 0)
            while text[end].isspace():
                end += 1
            starts.append(end)
        ends.append(b)
        scores.append(CERTAIN)
        depths.append(0)
    return _best_spans(starts, ends, scores, depths)


def _best_spans(starts: list[int], ends: list[int], scores: list[float], depths: list[int]) -> list[tuple[int, int]]:
    """The division into spans with the greatest sum of scores. starts[k] begins after the k-th end, ends[k] closes the span or goes on."""
    n = len(ends)
    begun, most, back = [0.0] * n, [0.0] * n, [0] * n  # best sum before a span at starts[k]; the most of these up to k; its first start
    far, far_at, near = -inf, 0, 0
    for j in range(n):
        end = ends[j]
        while near < j and starts[near] <= end - FAR:
            if begun[near] > far:
                far, far_at = begun[near], near
            near += 1
        top, at, i = -inf, j, j
        while True:
            s = begun[i] + _LENGTHS[min(end - starts[i], FAR)]
            if s > top:
                top, at = s, i
            i -= 1
            if i < near or most[i] <= top:
                break
        if far + _LENGTHS[FAR] > top:
            top, at = far + _LENGTHS[FAR], far_at
        back[j] = at
        if j + 1 < n:
            # the end and the beginning after it lie at the same depth
            begun[j + 1] = top + scores[j] + 2 * UNBALANCED * depths[j]
            most[j + 1] = max(most[j], begun[j + 1])
    out, j = [], n - 1
    while j >= 0:
        out.append((starts[back[j]], ends[j]))
        j = back[j] - 1
    return out[::-1]


#: A period and what follows: a mark that goes on, or the first character after blanks.
_CONTEXT = re.compile(r"\.(?=([,;:])|\s+(\S))")
#: A word is learned as an abbreviation if it was seen so often before a period, and so large a share of these went on: with a small letter or a mark,
#: or with a number.
SEEN, GOES_ON = 50, 0.6
MOST_LEARNED = 100_000


def _closed(text: str) -> Iterator[tuple[str, str]]:
    """(word, character) of each word of two letters or more before a period, and the mark or first character that follows. Periods are
    looked for, as they are few, and the word before each."""
    for m in _CONTEXT.finditer(text):
        at = m.start()
        if at and text[at - 1].isalpha():
            before = text[max(0, at - LONGEST) : at]
            word = _LAST_WORD.search(before, max(before.rfind(" "), before.rfind("\n")) + 1)
            if word and len(word.group()) > 1:
                yield word.group().lower(), m[1] or m[2]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (word, n, n_on, n_number) of a partition, sent on whenever many words have gathered."""
    held: dict[str, list[int]] = {}

    def out():
        rows = list(held.values())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["word", "n", "n_on", "n_number"])

    for batch in batches:
        for column in batch.columns:
            for text in column.to_pylist():
                for word, follows in _closed(text or ""):
                    told = held.setdefault(word, [0, 0, 0])
                    told[0] += 1
                    told[1] += follows in ",;:" or follows.islower()
                    told[2] += follows.isdigit()
        if len(held) > 200_000:
            yield out()
            held.clear()
    yield out()


def learn(df: DataFrame, zones: dict[str, str]) -> dict[str, str]:
    """Abbreviations of a corpus, with their classes, from counts of what follows a word and a period in all its texts.

    What mostly goes on with a number is ``numbered``, with a small letter or a mark ``maybe``. The lists of the module come before it. At most
    MOST_LEARNED words, the most frequent, are sent to the driver.
    """
    schema = "word string, n bigint, n_on bigint, n_number bigint"
    counts = df.select(*zones).mapInArrow(_contexts, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "n_on", "n_number")])
    known = counts.filter((F.col("n") >= SEEN) & (F.col("n_on") + F.col("n_number") >= GOES_ON * F.col("n")))
    rows = known.orderBy(F.desc("n"), "word").limit(MOST_LEARNED).collect()
    return {r["word"]: "numbered" if r["n_number"] > r["n_on"] else "maybe" for r in rows}


def split(df: DataFrame, key: str, zones: dict[str, str]) -> DataFrame:
    """(key, ct, start_pos int, end_pos int) of the sentences of the zone columns; zones: column to its name.

    Abbreviations are learned from all texts first, by counts that are combined before their shuffle; then one narrow stage splits without a
    shuffle. A long text is worked through in memory of its own size. Repeated
    rows give repeated units; a null key is kept.
    """
    sent = df.sparkSession.sparkContext.broadcast(learn(df, zones))  # MOST_LEARNED words at most
    kind = df.schema[key].dataType.simpleString()
    names = list(zones.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, cts, starts, ends = [], [], [], []
                ids = part.column(0).to_pylist()
                for c, ct in enumerate(names, 1):
                    for k, text in zip(ids, part.column(c).to_pylist()):
                        for a, b in sentences(text, sent.value) if text else ():
                            keys.append(k)
                            cts.append(ct)
                            starts.append(a)
                            ends.append(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, part.schema.field(0).type), pa.array(cts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    ["key", "ct", "start_pos", "end_pos"],
                )

    source = df.select(F.col(key).alias("key"), *[F.col(z).alias(f"z{k}") for k, z in enumerate(zones)])
    return source.mapInArrow(run, f"key {kind}, ct string, start_pos int, end_pos int").withColumnRenamed("key", key)
