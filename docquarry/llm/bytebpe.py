"""Byte-level BPE encoding with vectorised pre-tokenisation.

No regular expression runs. Every code point gets a class, neighbouring classes are folded into a
small alphabet, and a finite automaton over that alphabet says where a piece begins. The automaton
runs as an associative scan: its transition functions form a small monoid, blocks of symbols are
composed through the monoid's table, the block results are scanned, and a second pass gives each
position its state. The pieces are byte slices; equal slices are found by exact 16-byte keys, each
distinct slice is pair-merged once and kept in a cache, and ids are gathered back by offsets.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE = range(6)

#: Symbols of the automaton.
(
    S_LETTER,  # letter
    S_NUMBER,  # number
    S_OTHER,  # anything else, the apostrophe included
    S_WHITE,  # white space that a later white space or the end of the text follows
    S_GLUE,  # a blank before text: it belongs to the piece that follows
    S_LAST,  # other white space before text
    S_SHORT,  # apostrophe before s, t, m or d
    S_LONG,  # apostrophe before re, ve or ll
) = range(8)
N_SYMBOLS = 8

#: States: what the position before was.
(Q_START, Q_LETTER, Q_NUMBER, Q_OTHER, Q_WHITE, Q_GLUE, Q_ONE, Q_TWO, Q_DONE) = range(9)
N_STATES = 9
BLOCK = 256


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at the symbol's position."""
    if state == Q_TWO:  # inside a contraction of three characters
        return Q_ONE, False
    if state == Q_ONE:  # its last character
        return Q_DONE, False
    if symbol in (S_SHORT, S_LONG) and state not in (Q_OTHER, Q_GLUE):
        return (Q_ONE if symbol == S_SHORT else Q_TWO), True
    if symbol in (S_WHITE,):
        return Q_WHITE, state != Q_WHITE
    if symbol == S_GLUE:
        return Q_GLUE, True
    if symbol == S_LAST:
        return Q_START, True
    after = {S_LETTER: Q_LETTER, S_NUMBER: Q_NUMBER}.get(symbol, Q_OTHER)
    return after, state != Q_GLUE and state != after


@lru_cache(1)
def automaton():
    """Transition and emission tables, and the monoid of transition functions with its product."""
    both = [[_step(q, s) for s in range(N_SYMBOLS)] for q in range(N_STATES)]
    # symbols from N_SYMBOLS on stand for the first position of a text: the state before is Q_START
    trans = np.array([[x[0] for x in row] + [y[0] for y in both[Q_START]] for row in both], np.uint8)
    begins = np.array([[x[1] for x in row] + [True] * N_SYMBOLS for row in both], bool)
    functions = {tuple(range(N_STATES)): 0}
    for s in range(2 * N_SYMBOLS):
        functions.setdefault(tuple(int(x) for x in trans[:, s]), len(functions))
    generators = [functions[tuple(int(x) for x in trans[:, s])] for s in range(2 * N_SYMBOLS)]
    todo, by_id = list(functions), list(functions)
    while todo:
        f = todo.pop()
        for g in [by_id[k] for k in set(generators)]:
            h = tuple(g[f[q]] for q in range(N_STATES))
            if h not in functions:
                functions[h] = len(functions)
                by_id.append(h)
                todo.append(h)
    m = len(by_id)
    product = np.zeros((m, 2 * N_SYMBOLS), np.uint16)  # element then symbol
    for i, f in enumerate(by_id):
        for s in range(2 * N_SYMBOLS):
            g = by_id[generators[s]]
            product[i, s] = functions[tuple(g[f[q]] for q in range(N_STATES))]
    apply = np.array(by_id, np.uint8)
    return trans.ravel(), begins.ravel(), product.ravel(), apply


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, from the Unicode properties L, N and White_Space."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            run = m.group()
            if ord(run[-1]) - ord(run[0]) == len(run) - 1:
                table[ord(run[0]) : ord(run[-1]) + 1] = kind
            else:
                table[[ord(c) for c in run]] = kind
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the characters of a UTF-8 buffer, and their code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    points = first.astype(np.uint32)
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        at, f = lead[wide], first[wide]
        d = np.concatenate([data, np.zeros(3, np.uint8)])
        b1, b2, b3 = (d[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        f32 = f.astype(np.uint32)
        points[wide] = np.where(
            f < 0xE0,
            (f32 & 0x1F) << 6 | b1,
            np.where(f < 0xF0, (f32 & 0x0F) << 12 | b1 << 6 | b2, (f32 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3),
        )
    return lead, points


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Automaton symbols of concatenated texts; first: the positions at which a text begins."""
    n = len(points)
    kind = class_table()[points]
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    last[n - 1] = True
    white = (kind == SPACE) | (kind == BLANK)
    text_follows = np.zeros(n, bool)
    text_follows[:-1] = ~white[1:]
    text_follows &= ~last
    sym = np.array([S_LETTER, S_NUMBER, S_WHITE, S_WHITE, S_OTHER, S_OTHER], np.uint8)[kind]
    sym[(kind == BLANK) & text_follows] = S_GLUE
    sym[(kind == SPACE) & text_follows] = S_LAST
    q = np.flatnonzero((kind == QUOTE) & ~last)
    if len(q):
        near = points[q + 1]
        sym[q[np.isin(near, np.frombuffer(b"stmd", np.uint8))]] = S_SHORT
        q2 = q[(q + 2 < n)]
        q2 = q2[~last[q2 + 1]]
        a, b = points[q2 + 1], points[q2 + 2]
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[q2[long]] = S_LONG
    sym[first] += N_SYMBOLS
    return sym


def scan(sym: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins, by a blocked associative scan of transition functions."""
    trans, begins, product, apply = automaton()
    n, width = len(sym), 2 * N_SYMBOLS
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = sym
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    element = np.zeros(blocks, np.intp)
    for j in range(BLOCK):
        element = product[element * width + columns[j]].astype(np.intp)
    # the state before each block: an inclusive scan of the blocks' transition functions by doubling steps
    function, step = apply[element], 1
    while step < blocks:
        function[step:] = np.take_along_axis(function[step:], function[:-step], axis=1)
        step *= 2
    before = np.full(blocks, Q_START, np.uint8)
    before[1:] = function[:-1, Q_START]
    out = np.empty((BLOCK, blocks), bool)
    now = before.astype(np.intp)
    for j in range(BLOCK):
        at = now * width + columns[j]
        out[j] = begins[at]
        now = trans[at].astype(np.intp)
    return np.flatnonzero(out.T.ravel()[:n])


class ByteBpe:
    """A rank file's tokenizer with a cache of merged pieces.

    ``encode`` takes the UTF-8 buffer and offsets of a string column and gives one flat id array with
    offsets, and the byte offsets of the pieces. Null and empty texts have no ids. Strings that look like special tokens
    are ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                word, rank = line.split()
                ranks[base64.b64decode(word)] = int(rank)
        self.ranks = ranks
        # only the pair merging of single pieces is used; the pattern never runs
        self.core = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.merge = self.core._core_bpe.encode_single_piece
        self.index: dict[bytes, int] = {}
        self.flat = np.empty(1 << 20, np.int32)
        self.used = 0
        self.starts = np.empty(1 << 18, np.int64)
        self.lengths = np.empty(1 << 18, np.int64)

    #: The cache is emptied beyond so many distinct pieces, which bounds a worker's memory.
    CACHE = 1_000_000

    def _number(self, piece: bytes) -> int:
        got = self.index.get(piece)
        if got is None:
            whole = self.ranks.get(piece)
            ids = [whole] if whole is not None else self.merge(piece)
            got = len(self.index)
            self.index[piece] = got
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            if got == len(self.starts):
                self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
                self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[got], self.lengths[got] = self.used, len(ids)
            self.used += len(ids)
        return got

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets at which the pieces of all texts begin."""
        lead, points = code_points(data)
        filled = offsets[:-1][np.diff(offsets) > 0]
        return lead[scan(symbols(points, np.searchsorted(lead, filled)))]

    def encode(self, data: np.ndarray, offsets: np.ndarray, counts_only: bool = False):
        """(ids, id offsets per text, piece starts in bytes, id offsets per piece); without ids if counts_only."""
        if len(self.index) > self.CACHE:
            self.index.clear()
            self.used = 0
        data = data[: offsets[-1]]
        if offsets[0]:
            data, offsets = data[offsets[0] :], offsets - offsets[0]
        if not len(data):
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), none, np.zeros(1, np.int64)
        begin = self.pieces(data, offsets)
        length = np.diff(np.append(begin, len(data)))
        number = np.empty(len(begin), np.int64)
        short = length <= 15
        self._numbers_short(data, begin, length, short, number)
        buffer = data.tobytes()
        for k in np.flatnonzero(~short).tolist():
            b = begin[k]
            number[k] = self._number(buffer[b : b + length[k]])
        count = self.lengths[number]
        ends = np.cumsum(count)
        per_piece = np.concatenate([[0], ends])
        per_text = per_piece[np.searchsorted(begin, offsets)]
        if counts_only:
            return np.zeros(0, np.int32), per_text, begin, per_piece
        at = np.arange(ends[-1]) + np.repeat(self.starts[number] - (ends - count), count)
        return self.flat[at], per_text, begin, per_piece

    def _widths(self) -> np.ndarray:
        if not hasattr(self, "widths"):
            self.widths = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for word, rank in self.ranks.items():
                self.widths[rank] = len(word)
        return self.widths

    def id_starts(self, ids: np.ndarray, per_text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The byte of its text at which each id's bytes begin."""
        width = self._widths()[ids]
        ends = np.cumsum(width)
        return ends - width - np.repeat((offsets - offsets[0])[:-1], np.diff(per_text))

    def decode(self, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray | None = None) -> pa.Array:
        """The texts of concatenated id lists of the given lengths: each id's bytes are laid at its start, where starts are retained, or one
        after another. Bytes that are no UTF-8 become replacement characters."""
        width = self._widths()
        if not hasattr(self, "word_bytes"):
            ordered = sorted(self.ranks.items(), key=lambda x: x[1])
            self.word_bytes = np.frombuffer(b"".join(w for w, _ in ordered), np.uint8)
            self.word_at = np.cumsum(width) - width
        n = width[ids]
        per_text = np.append(0, np.cumsum(lengths))
        if starts is None:
            ends = np.append(0, np.cumsum(n))
            texts, to = ends[per_text], ends[:-1]
        else:
            last = np.maximum(per_text[1:] - 1, 0)
            size = np.where(lengths > 0, (starts + n)[last] if len(ids) else 0, 0)
            texts = np.append(0, np.cumsum(size))
            to = starts + np.repeat(texts[:-1], lengths)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(texts[-1], np.uint8)
        out[place + np.repeat(to, n)] = self.word_bytes[place + np.repeat(self.word_at[ids], n)]
        made = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(texts.astype(np.int32)), pa.py_buffer(out))
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:
            buffer, cuts = out.tobytes(), texts.tolist()
            return pa.array([buffer[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())
        return made

    def _numbers_short(self, data, begin, length, short, number) -> None:
        """Cache numbers of the pieces of up to 15 bytes, which two 8-byte words and a length hold exactly."""
        which = np.flatnonzero(short)
        if not len(which):
            return
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray(len(data) + 8, "<u8", padded, 0, (1,))
        b, n = begin[which], length[which].astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        keep = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
        low = words[b] & keep[np.minimum(n, 8)]
        over = np.maximum(n, 8) - np.uint64(8)
        high = (words[b + 8] & keep[over]) | n << np.uint64(56)
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high * np.uint64(0xC2B2AE3D27D4EB4F)) & full)
        mixed ^= mixed >> np.uint64(29)
        _, one, back = np.unique(mixed, return_index=True, return_inverse=True)
        if not ((low[one[back]] == low).all() and (high[one[back]] == high).all()):
            pair = np.empty(len(low), [("a", np.uint64), ("b", np.uint64)])
            pair["a"], pair["b"] = low, high
            _, one, back = np.unique(pair, return_index=True, return_inverse=True)
        buffer, at, size = data.tobytes(), b[one].tolist(), length[which][one].tolist()
        mine = np.fromiter((self._number(buffer[p : p + k]) for p, k in zip(at, size)), np.int64, len(at))
        number[which] = mine[back]


@lru_cache(4)
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer and cache per worker process and rank file."""
    return ByteBpe(path)
