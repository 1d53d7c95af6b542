"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A batch's distinct units (a word with the mark before it, or a line break with what follows) are concatenated and indexed
by a suffix array sorted as deep as the longest piece. Binary search finds the occurrence range of every piece at once;
the occurrences, as edges between positions, are sorted by where they end and then relaxed in that order.

For a BPE model, relaxing means: the encoding of every prefix ends in exactly one piece, namely the edge (s, t, piece) whose
piece is compatible with the last piece at s, that is, merging by rank would not join across their border. So each position
gets one last piece, and walking back from the end of a unit yields the encoding that merging pair by pair would give.

Text is taken as the model takes it: a mark is put before it, blanks become marks, nothing else is normalised; runs of
marks are merged from the left. Characters without a piece are spelled in bytes, and so is a U+2581 of the text itself (the
model would take it for a blank): decoding gives back every text. A null text has null ids, an empty one none. Rows are
encoded one by one, so repeated rows give repeated results and an empty table an empty one; a very long text is a batch by
itself and is held, with its edges, by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import vocabulary
from tidewire.llm.common import released, text_chunks
from tidewire.llm.words import ranges

MARK = "▁"
#: Stands for a U+2581 of the text; a lone surrogate, which no text has.
LITERAL = "\udc00"
_SLOW = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


class Pieces:
    """Tables of a model, small enough to send to every worker. Pieces are numbered: single characters first, then merges by rank; number other stands for a character without a piece."""

    def __init__(self, path: str = vocabulary.MODEL):
        listed = vocabulary.pieces(path)
        self.text = [p for p, _, _ in listed]
        normal = {p: (s, i) for i, (p, s, kind) in enumerate(listed) if kind == "normal"}
        self.bytes = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(listed):
            if kind == "byte":
                self.bytes[int(p[3:5], 16)] = i
                b = int(p[3:5], 16)
                self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)
            elif kind != "normal":
                self.text[i] = ""
        score = {p: s for p, (s, _) in normal.items()}
        chars = sorted(p for p in normal if len(p) == 1)
        runs = {p for p in normal if len(p) > 1 and not p.strip(MARK)}
        ranked = sorted((p for p in normal if len(p) > 1 and p not in runs), key=lambda p: (-score[p], normal[p][1]))
        self.other = len(chars)
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        number = {c: i for i, c in enumerate(chars)}
        left, right, kept = list(range(len(chars) + 1)), list(range(len(chars) + 1)), []
        joins = {k: v for k, v in score.items() if k not in runs}
        for p in ranked:
            halves = None
            symbols = list(p)
            while len(symbols) > 1:
                best = max(range(len(symbols) - 1), key=lambda i: (joins.get(symbols[i] + symbols[i + 1], -np.inf), -i))
                if symbols[best] + symbols[best + 1] not in joins:
                    break
                if len(symbols) == 2:
                    halves = symbols
                symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
            if len(symbols) == 1 and halves and all(h in number for h in halves):
                number[p] = len(left)
                left.append(number[halves[0]])
                right.append(number[halves[1]])
                kept.append(p)
        self.left, self.right = np.array(left), np.array(right)
        self.id = np.array([normal[c][1] for c in chars] + [-1] + [normal[p][1] for p in kept], np.int32)
        n = len(left)
        merges = np.arange(self.other + 1, n)
        key = self.left[merges] * n + self.right[merges]
        order = np.argsort(key)
        self.pair, self.joined = key[order], merges[order]
        self.length = np.array([1] * (self.other + 1) + [len(p) for p in kept])
        self.width = int(self.length.max(initial=1))
        self.spelling = np.full((n, self.width), -1, np.int64)
        for i, p in enumerate([*chars, None, *kept]):
            if p:
                self.spelling[i, : len(p)] = np.searchsorted(self.chars, [ord(c) for c in p]) + 1
        self.run_ids = {len(p): normal[p][1] for p in runs} | {1: normal[MARK][1]}
        self.runs = frozenset(self.run_ids)

    def run(self, n: int) -> list[int]:
        """Ids of n marks: the leftmost neighbours that have a piece together are joined first, so that the longest pieces fill up from the left."""
        most = max(self.runs)
        rest = [1] * (n % most)
        while (i := next((i for i in range(len(rest) - 1) if rest[i] + rest[i + 1] in self.runs), None)) is not None:
            rest[i : i + 2] = [rest[i] + rest[i + 1]]
        return [self.run_ids[k] for k in [most] * (n // most) + rest]

    def fits(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both by rank ends in these two pieces: undoes the merges next to the border, latest first, and looks for a join across it that would have come earlier."""
        n = len(self.left)
        ok = np.ones(len(one), bool)
        live = np.arange(len(one))
        a, b, limit = one.copy(), two.copy(), np.full(len(one), np.iinfo(np.int64).max)
        while len(live):
            key = a * n + b
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            crossed = (self.pair[i] == key) & (self.joined[i] < limit)
            ok[live[crossed]] = False
            after_a, after_b = self.right[a], self.left[b]
            first = a > b
            split_a = np.where(first, after_a != a, (after_b == b) & (after_a != a))
            split_b = np.where(first, (after_a == a) & (after_b != b), after_b != b)
            limit = np.where(split_a, a, np.where(split_b, b + 1, limit))
            a, b = np.where(split_a, after_a, a), np.where(split_b, after_b, b)
            more = ~crossed & (split_a | split_b)
            live, a, b, limit = live[more], a[more], b[more], limit[more]
        return ok


def suffix_array(text: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Positions of text, ordered by the depth symbols that begin there; symbols have so many bits."""
    n = len(text)
    pack = max(1, 62 // bits)
    padded = np.concatenate([text, np.zeros(max(depth, pack) + 1, np.int64)])
    rank = np.zeros(n, np.int64)
    for i in range(pack):
        rank = rank << bits | padded[i : n + i]
    done = pack
    while True:
        order = np.argsort(rank, kind="stable")
        if done >= depth:
            return order
        ranked = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if dense[order[-1]] == n - 1:
            return order
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - done)] = dense[done:] + 1
        rank = dense * (n + 1) + behind
        done *= 2


def occurrences(text: np.ndarray, order: np.ndarray, spelling: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of the suffix array whose suffixes begin with it."""
    padded = np.concatenate([text, np.full(spelling.shape[1] + 1, -1, np.int64)])
    low, high = np.zeros(len(length), np.int64), np.full(len(length), len(order))
    high[spelling[:, 0] < 0] = 0
    for d in range(spelling.shape[1]):
        live = np.flatnonzero((length > d) & (low < high))
        if not len(live):
            break
        wanted = spelling[live, d]
        bounds = []
        for after in (0, 1):
            lo, hi = low[live].copy(), high[live].copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                less = padded[order[np.minimum(mid, len(order) - 1)] + d] < wanted + after
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            bounds.append(lo)
        low[live], high[live] = bounds
    return low, high


class Encoder:
    """Encodes texts; remembers the ids of up to limit units and the compatibility of pairs met so far."""

    def __init__(self, pieces: Pieces, limit: int = 120_000):
        self.pieces, self.limit = pieces, limit
        self.known, self.verdict = np.empty(0, np.int64), np.empty(0, bool)
        self._clear()

    def _clear(self) -> None:
        self.units: dict[str, int] = defaultdict()
        self.units.default_factory = self.units.__len__
        self.ids, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's."""
        if len(self.units) > self.limit:
            self._clear()
        parts = [self._split(t) for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        unit = np.fromiter(map(self.units.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        if new := len(self.units) - (len(self.at) - 1):
            fresh = list(islice(reversed(self.units), new))[::-1]
            for i in range(0, new, 25_000):
                ids, count = self._encode(fresh[i : i + 25_000])
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count)])
                self.ids = np.concatenate([self.ids, ids])
        size = self.at[unit + 1] - self.at[unit]
        total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
        return self.ids[ranges(self.at[unit], size)], total

    @staticmethod
    def _split(text: str) -> list[str]:
        """Units of a text; one that does not begin with a line break has a mark before it."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        if text[0] == " " or "  " in text:
            return [u[1:] if u[0] == MARK else u for u in _SLOW.findall(MARK + text.replace(" ", MARK))]
        return text.replace("\n", " \n").split(" ")

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = self.pieces
        marks = np.array([0 if u[:1] == "\n" else 1 + len(u) - len(u.lstrip(MARK)) for u in units])
        bare = [u if not m else MARK + u.lstrip(MARK) for u, m in zip(units, marks.tolist())]
        length = np.fromiter(map(len, bare), np.int64, len(bare))
        code = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = np.minimum(np.searchsorted(p.chars, code), len(p.chars) - 1)
        symbol = np.where(p.chars[symbol] == code, symbol + 1, len(p.chars) + 1)
        start = np.cumsum(length + 1) - length - 1
        text = np.zeros(int(length.sum()) + len(bare), np.int64)
        inside = ranges(start, length)
        text[inside] = symbol
        order = suffix_array(text, p.width, int(len(p.chars) + 2).bit_length())
        low, high = occurrences(text, order, p.spelling, p.length)
        count = high - low
        source = order[ranges(low, count)]
        piece = np.repeat(np.arange(len(count)), count)
        strange = np.flatnonzero(text == len(p.chars) + 1)
        source = np.concatenate([source, strange])
        piece = np.concatenate([piece, np.full(len(strange), p.other)])
        step = np.zeros(len(text), np.int64)
        step[inside] = ranges(np.zeros_like(length), length)
        last = self._relax(source, piece, step, len(text) + 1)
        token = np.full(len(text), -1, np.int64)
        at = start + length
        while len(at):
            number = last[at]
            at = at - p.length[number]
            token[at] = number
            at = at[step[at] > 0]
        where = np.flatnonzero(token >= 0)
        number = token[where]
        owner = np.searchsorted(start, where, "right") - 1
        ids = p.id[number].astype(np.int64)
        code_at = np.zeros(len(text), np.uint32)
        code_at[inside] = code
        spelled: dict[int, list[int]] = {}
        for i in np.flatnonzero(number == p.other).tolist():
            c = chr(code_at[where[i]])
            raw = (MARK if c == LITERAL else c).encode()
            ids[i] = p.bytes[raw[0]]
            if len(raw) > 1:
                spelled[i] = p.bytes[list(raw)].tolist()
        for u in np.flatnonzero(marks > 1).tolist():
            i = int(np.searchsorted(owner, u))
            alone = ids[i] == p.run_ids[1]
            run = p.run(int(marks[u]) - (not alone))
            spelled[i] = run if alone else run + spelled.get(i, [int(ids[i])])
        if spelled:
            size = np.ones(len(ids), np.int64)
            for i, s in spelled.items():
                size[i] = len(s)
            out = np.repeat(ids, size)
            first = np.cumsum(size) - size
            for i, s in spelled.items():
                out[first[i] : first[i] + len(s)] = s
            ids, owner = out, np.repeat(owner, size)
        return ids.astype(np.int32), np.bincount(owner, minlength=len(units))

    def _relax(self, source: np.ndarray, piece: np.ndarray, step: np.ndarray, nodes: int) -> np.ndarray:
        """The last piece of the encoding of every prefix. Edges are relaxed by the position within the unit where they end."""
        p = self.pieces
        target = source + p.length[piece]
        end = step[source] + p.length[piece]
        by = np.argsort(end, kind="stable")
        source, target, piece, end = source[by], target[by], piece[by], end[by]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1, [len(end)]])
        last = np.full(nodes, -1, np.int64)
        initial = step[source] == 0
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            s, t, q = source[a:b], target[a:b], piece[a:b]
            good = initial[a:b].copy()
            rest = np.flatnonzero(~good & (last[s] >= 0))
            good[rest] = self._fits(last[s[rest]], q[rest])
            last[t[good]] = q[good]
        return last

    def _fits(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        n = len(self.pieces.left)
        keys, back = np.unique(one * n + two, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        held = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        answer = np.empty(len(keys), bool)
        answer[held] = self.verdict[at[held]]
        new = ~held
        if new.any():
            answer[new] = self.pieces.fits(keys[new] // n, keys[new] % n)
            if len(self.known) < 500_000:
                place = np.searchsorted(self.known, keys[new])
                self.known, self.verdict = np.insert(self.known, place, keys[new]), np.insert(self.verdict, place, answer[new])
        return answer[back]


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of ids, without the mark put before it; bytes that are no UTF-8 become U+FFFD."""
    text = "".join(map(pieces.text.__getitem__, ids)).replace(MARK, " ")
    if not text.isascii():
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text[1:]


ENCODED = "doc_id long, n_pieces long, ids_sha256 string, exact boolean, ids array<int>"


def encode_documents(docs: DataFrame, path: str = vocabulary.MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as 32-bit little-endian numbers), exact (whether decoding gives the text back) and ids of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        encoder = Encoder(pieces)
        for chunk in text_chunks(batches, "text", 2 << 20):
            texts = chunk.column(1).to_pylist()
            ids, at = encoder([t or "" for t in texts])
            exact, digest, raw, all_ids = [], [], ids.astype("<i4").tobytes(), ids.tolist()
            for t, a, b in zip(texts, at.tolist(), at[1:].tolist()):
                exact.append(None if t is None else decode(pieces, all_ids[a:b]) == t)
                digest.append(None if t is None else hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
            none = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(none))
            yield pa.record_batch([chunk.column(0), pa.array(np.diff(at)), pa.array(digest, pa.string()), pa.array(exact, pa.bool_()), lists], ["doc_id", "n_pieces", "ids_sha256", "exact", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(run), ENCODED)
