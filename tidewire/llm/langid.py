"""Language identification with segmentation-marginalised unigrams.

Each language has probabilities over a fixed public vocabulary of pieces. The probability of a word is the sum over all its
segmentations into pieces, computed by the forward algorithm; a text's is the product over its words, and the prediction is
the language with the largest posterior under equal priors. Piece probabilities are fitted by expectation maximisation with
the same lattice, on a documented bounded sample: about SAMPLE documents of each language, chosen by a hash of doc_id.

Words are runs of letters in lower case, scored in stretches of at most STRETCH letters. Letters that no piece covers have
one small probability in all languages. A null text, and one without a letter, is "und" with score 0; so is every text if
there is nothing to learn from. Ties go to the language first by code point. Repeated rows are predicted alike, an empty
table gives an empty one, other columns are ignored. A very long text is read whole by one task. More than MOST_LANGUAGES
values of lang are an error, as the models of all languages are held by each task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import vocabulary
from tidewire.llm.common import released, text_bytes, text_chunks
from tidewire.llm.words import mix, ranges

SAMPLE, ROUNDS, STRETCH, UNKNOWN, SMOOTH, MOST_LANGUAGES = 1500, 4, 32, 1e-7, 0.01, 2000
_WORDS = re.compile(rf"[^\W\d_]{{1,{STRETCH}}}")
U64 = np.uint64
_BASE = U64(0x100000001B3)


class Lattice:
    """Finds all pieces in words. Piece number 0 stands for a letter that no piece covers."""

    def __init__(self, pieces: list[str]):
        self.width = max(map(len, pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], U64)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order + 1
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> U64(44)] = True
        self.size = len(pieces) + 1

    @staticmethod
    def _key(piece: str) -> int:
        h = np.zeros(1, U64)
        for c in piece:
            h = h * _BASE + U64(ord(c) + 1)
        return int(mix(h)[0])

    def edges(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, int]:
        """Edges (from, to, piece) between flat positions, in an order in which they can be relaxed group by group; no group has a target twice. Then the first and last position of each word, and the number of positions."""
        joined = "".join("▁" + w for w in words)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(U64)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at = np.cumsum(length) - length
        left = np.repeat(at + length, length) - np.arange(len(code))
        step = np.arange(len(code)) - np.repeat(at, length)
        node = np.arange(len(code)) + np.repeat(np.arange(len(words)), length)
        sources, spans, numbers, covered = [], [], [], np.zeros(len(code), bool)
        h = np.zeros(len(code), U64)
        for m in range(1, self.width + 1):
            live = np.flatnonzero(left >= m)
            if not len(live):
                break
            h[live] = h[live] * _BASE + code[live + m - 1] + U64(1)
            key = mix(h[live])
            maybe = self.filter[key >> U64(44)]
            live, key = live[maybe], key[maybe]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            sources.append(live[hit])
            spans.append(np.full(int(hit.sum()), m))
            numbers.append(self.number[i[hit]])
            if m == 1:
                covered[live[hit]] = True
        bare = np.flatnonzero(~covered)
        source = np.concatenate([*sources, bare])
        span = np.concatenate([*spans, np.ones(len(bare), np.int64)])
        number = np.concatenate([*numbers, np.zeros(len(bare), np.int64)])
        order = np.argsort((step[source] + span) * (self.width + 1) + span, kind="stable")
        source, span, number = source[order], span[order], number[order]
        group = (step[source] + span) * (self.width + 1) + span
        cut = np.flatnonzero(np.diff(group)) + 1
        start = node[source]
        parts = list(zip(np.split(start, cut), np.split(start + span, cut), np.split(number, cut)))
        return parts, at + np.arange(len(words)), at + np.arange(len(words)) + length, len(code) + len(words)


def forward(parts, first: np.ndarray, nodes: int, p: np.ndarray) -> np.ndarray:
    """Sum over all segmentations of the prefix that ends at each position; p: a row of probabilities for each piece."""
    a = np.zeros((nodes, p.shape[1]))
    a[first] = 1.0
    for s, t, number in parts:
        a[t] += a[s] * p[number]
    return a


def fit(lattice: Lattice, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation on words and how often they occur."""
    parts, first, last, nodes = lattice.edges(words)
    seen = np.zeros(lattice.size)
    weight = np.zeros(nodes)
    for f, l, c in zip(first, last, counts):
        weight[f:l] = c
    for s, _, number in parts:
        np.add.at(seen, number, weight[s])
    p = _normal(seen)
    for _ in range(ROUNDS):
        a = forward(parts, first, nodes, p[:, None])[:, 0]
        b = np.zeros(nodes)
        b[last] = counts / a[last]
        seen = np.zeros(lattice.size)
        for s, t, number in reversed(parts):
            through = p[number] * b[t]
            np.add.at(b, s, through)
            np.add.at(seen, number, a[s] * through)
        p = _normal(seen)
    return p


def _normal(seen: np.ndarray) -> np.ndarray:
    seen = seen.copy()
    seen[0] = 0
    p = (seen + SMOOTH) / (seen.sum() + SMOOTH * len(seen))
    p[0] = UNKNOWN
    return p


def piece_list(path: str) -> list[str]:
    """Lower-case letter pieces of the public vocabulary, with or without the mark of a word's start."""
    return [p for p, _, kind in vocabulary.pieces(path) if kind == "normal" and (p == "▁" or (w := p.removeprefix("▁")).isalpha() and w == w.lower())]


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of doc_id as text leaves that remainder; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def train(docs: DataFrame, path: str = vocabulary.MODEL) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their piece probabilities, a column each. docs: text and lang; rows with a null are left out."""
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(n) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    if not n:
        return [], np.zeros((1, 0))
    share = F.create_map(*(F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, SAMPLE / k))))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "content"):
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                seen[lang].update(_WORDS.findall(text.decode("utf-8", "replace").lower()))
            rows = [(lang, w, c) for lang, words in seen.items() for w, c in words.items()]
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows)], ["lang", "word", "n"])

    pieces = piece_list(path)

    def learn(words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("word")
        p = fit(Lattice(pieces), words["word"].tolist(), words["n"].to_numpy(np.float64))
        return pd.DataFrame({"lang": [words["lang"].iloc[0]], "p": [p]})

    counted = chosen.select("lang", text_bytes().alias("content")).mapInArrow(released(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    models = {r["lang"]: r["p"] for r in counted.groupBy("lang").applyInPandas(learn, "lang string, p array<double>").collect()}
    langs = sorted(models)
    return langs, np.array([models[x] for x in langs]).reshape(len(langs), -1).T


class Scorer:
    """Log-probabilities of texts under each language; remembers up to limit words."""

    def __init__(self, pieces: list[str], p: np.ndarray, limit: int = 100_000):
        self.lattice, self.p, self.limit = Lattice(pieces), p, limit
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.logs, self.letters = np.empty((0, self.p.shape[1])), np.empty(0, bool)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row of log-probabilities for each text, and whether it has a letter."""
        if len(self.ids) > self.limit:
            self._clear()
        words = [_WORDS.findall(t.lower()) if t else () for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if new := len(self.ids) - len(self.logs):
            fresh = list(islice(reversed(self.ids), new))[::-1]
            logs = []
            for i in range(0, new, 10_000):
                parts, first, last, nodes = self.lattice.edges(fresh[i : i + 10_000])
                logs.append(np.log(forward(parts, first, nodes, self.p)[last]))
            self.logs = np.concatenate([self.logs, *logs])
            self.letters = np.concatenate([self.letters, np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in fresh), bool, new)])
        out = np.zeros((len(texts), self.p.shape[1]))
        some = np.flatnonzero(n)
        letters = np.zeros(len(texts), bool)
        if len(some):
            at = (np.cumsum(n) - n)[some]
            out[some] = np.add.reduceat(self.logs[ids], at, axis=0)
            letters[some] = np.logical_or.reduceat(self.letters[ids], at)
        return out, letters


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, path: str = vocabulary.MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score, the posterior probability of the predicted language."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((piece_list(path), langs, p))
    kept = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, p = model.value
        scorer = Scorer(pieces, p)
        for chunk in text_chunks(batches, "content", 2 << 20):
            texts = [t.decode("utf-8", "replace") for t in chunk.column(len(keep)).to_pylist()]
            if langs:
                logs, letters = scorer(texts)
                best = logs.argmax(1)
                score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                pred = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
                score = np.where(letters, score, 0.0)
            else:
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.record_batch([*chunk.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    return docs.select(*keep, text_bytes().alias("content")).mapInArrow(released(run), schema)


def identify(docs: DataFrame, path: str = vocabulary.MODEL) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from rows whose doc_id is not held out."""
    tagged = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    langs, p = train(tagged.filter(~F.col("held_out")).select("doc_id", "text", "lang"), path)
    return predict(tagged, langs, p, path, ("doc_id", "held_out"))


def recognised(docs: DataFrame, least: float = 0.5, path: str = vocabulary.MODEL) -> DataFrame:
    """The rows of docs, with all their columns, whose language is predicted with at least that score; learns from all rows with a lang. Without any, all texts with a letter are kept: there is nothing to reject them by."""
    langs, p = train(docs.select("doc_id", "text", "lang"), path)
    model = docs.sparkSession.sparkContext.broadcast((piece_list(path), langs, p))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, p = model.value
        scorer = Scorer(pieces, p)
        for chunk in text_chunks(batches, "text", 2 << 20):
            if langs:
                logs, letters = scorer(chunk.column(text).to_pylist())
                score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                yield chunk.filter(pa.array(letters & (score >= least)))
            else:
                yield chunk.filter(pa.array([bool(t and _WORDS.search(t)) for t in chunk.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
