"""Phrase collocation mining per language: phrases that occur more often than their parts would by themselves.

Everything is exact; nothing that grows with the corpus is held by the driver or a worker:

1. Every shard of about SHARD words counts its pairs of neighbouring words under 64-bit keys; the counts are added up by
   key. Keys that reach the least count set bits of a filter of FILTER bits, its fixed size, which goes to the workers. Two
   keys that share a hash or a bit only let more through. A phrase that occurs often enough consists of such pairs, so no
   substring with another one is looked at.
2. Every shard builds the suffix automaton of what is left, down to DEPTH words. Its states are the classes of substrings
   that end at the same positions; the longest one's length, the suffix link to the next class and the number of end positions
   are kept. The automaton is built level by level from the pairs (substring before, word), for all texts of the shard at
   once, not by appending words. Its substrings are enumerated with their counts; they are added up by their words.
3. A phrase lies inside a longer one as often as it occurs itself only if a phrase longer by one word does so. In a shard that
   shows as a substring that is not the longest of its class (suffix link), or whose only transition has as many end
   positions; only phrases for which that holds in every shard are compared with the longer phrases' total counts.
4. Counts of both parts of every cut come from the same totals. Products are decimals of 38 digits: exact while counts have 15.

Words are runs without blank or tab of the pieces between . , ; : ! ? and line breaks, A-Z in lower case. A null text is
empty, a null language "und". Rows count one by one, repeated ones too; other columns are ignored. An empty table, or one
without phrases that are frequent enough, gives no rows. Ties of the score are broken by count, then by the phrase's bytes.
Shards hold whole texts, so a very long text is a shard by itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, released, text_bytes, text_chunks
from tidewire.llm.words import U64, mix

#: Words in a shard; words of the longest phrase; bits of the filter.
SHARD, DEPTH, FILTER = 3_000_000, 5, 1 << 27
#: What stands between pieces in a shard; no byte of UTF-8.
BREAK = b"\xff"
_BREAKS = bytes(255 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))


class Words:
    """The words of one language's part of a shard, taken in text by text: ids in order, 0 between pieces; words[i] is the word with the id i. Only distinct words are held."""

    def __init__(self, lang: str, texts: Sequence[bytes] = ()):
        self.lang, self._parts = lang, []
        self._number: dict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self._number[BREAK]
        self.add(texts)

    def add(self, texts: Sequence[bytes]) -> int:
        flat = BREAK.join(texts).translate(_BREAKS).replace(BREAK, b" \xff ").lower().split()
        self._parts += [np.fromiter(map(self._number.__getitem__, flat), np.int32, len(flat)), np.zeros(1, np.int32)]
        return len(flat)

    @cached_property
    def ids(self) -> np.ndarray:
        return np.concatenate(self._parts)

    @cached_property
    def words(self) -> list[bytes]:
        return list(self._number)

    @cached_property
    def keys(self) -> np.ndarray:
        return mix(np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), U64, len(self.words)) + U64(xxhash.xxh3_64_intdigest(self.lang)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that follow another one within the piece, and keys of these pairs."""
        at = np.flatnonzero((self.ids[:-1] > 0) & (self.ids[1:] > 0)) + 1
        return at, mix(self.keys[self.ids[at - 1]] * U64(0x9E3779B97F4A7C15) + self.keys[self.ids[at]])


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[Words]:
    """From rows (lang, content) the shards of their texts, one for each language that it has."""
    held: dict[str, Words] = {}
    n = 0
    for chunk in text_chunks(batches, "content"):
        texts: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
            texts[lang].append(text)
        for lang, own in texts.items():
            if lang not in held:
                held[lang] = Words(lang)
            n += held[lang].add(own)
        if n >= size:
            while held:
                yield held.popitem()[1]
            n = 0
    while held:
        yield held.popitem()[1]


class Automaton:
    """The suffix automaton, DEPTH words deep, of runs of words: run[i] tells how many words up to position i belong together.

    For each length from 1 the distinct substrings: where the first occurrence ends, how often they occur, which substring
    they leave without their first word (suffix) and without their last (prefix).
    """

    def __init__(self, ids: np.ndarray, run: np.ndarray, depth: int = DEPTH):
        at = np.flatnonzero(run >= 1)
        group = np.full(len(ids), -1, np.int64)
        ids = ids.astype(np.int64)
        value, first, group[at], count = np.unique(ids[at], return_index=True, return_inverse=True, return_counts=True)
        self.end, self.count, self.suffix, self.prefix = [at[first]], [count], [np.full(len(value), -1)], [np.full(len(value), -1)]
        width = int(ids.max(initial=0)) + 1
        for length in range(2, depth + 1):
            at = np.flatnonzero(run >= length)
            _, first, back, count = np.unique(group[at - 1] * width + ids[at], return_index=True, return_inverse=True, return_counts=True)
            end = at[first]
            self.end.append(end)
            self.count.append(count)
            self.suffix.append(group[end])
            self.prefix.append(group[end - 1])
            group = np.full(len(ids), -1, np.int64)
            group[at] = back
        self._classes()

    def _classes(self) -> None:
        """state[k][i]: the class of a substring. Of each class: the longest length, the count of end positions, the suffix link (-1 for the empty substring)."""
        self.state, self.longest, self.link, self.ends = [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for k, count in enumerate(self.count):
            if not k:
                same, up = np.zeros(len(count), bool), np.full(len(count), -1)
            else:
                same, up = count == self.count[k - 1][self.suffix[k]], self.state[k - 1][self.suffix[k]]
            state = np.where(same, up, -1)
            new = np.flatnonzero(~same)
            state[new] = len(self.longest) + np.arange(len(new))
            self.longest[up[same]] = k + 1
            self.longest, self.link, self.ends = np.concatenate([self.longest, np.full(len(new), k + 1)]), np.concatenate([self.link, up[new]]), np.concatenate([self.ends, count[new]])
            self.state.append(state)

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all substrings of a length: where the first one ends, the count, whether one word always comes before, whether one always follows."""
        k = length - 1
        before = length < self.longest[self.state[k]]
        after = np.zeros(len(before), bool)
        if length < len(self.count):
            always = self.count[length] == self.count[k][self.prefix[length]]
            after[self.prefix[length][always]] = True
        return self.end[k], self.count[k], before, after


def _keys(docs: DataFrame) -> DataFrame:
    """key, n of every pair of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            key, n = np.unique(shard.pairs()[1], return_counts=True)
            for a in range(0, len(key), 1 << 18):
                yield pa.record_batch([pa.array(key[a : a + (1 << 18)].view(np.int64)), pa.array(n[a : a + (1 << 18)])], ["key", "n"])

    return docs.mapInArrow(released(run), "key long, n long")


def _filter(keys: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bit for each key that occurs at least so often, in 64-bit words. Only words with a bit set go through the driver, bits / 64 of them at most."""
    some = keys.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = some.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & {bits - 1} & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("set").to_numpy()
    return out.view(U64)


def _passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & U64(64 * len(filter_) - 1)
    return (filter_[bit >> U64(6)] >> (bit & U64(63)) & U64(1)).astype(bool)


def left_over(shard: Words, filter_: np.ndarray) -> np.ndarray:
    """Of how many words, at most, a substring is that ends at each position and has only pairs that pass; 0 between pieces."""
    most = (shard.ids > 0).astype(np.int64)
    at, keys = shard.pairs()
    at = at[_passes(filter_, keys)]
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        most[at] = 2 + np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return most


COUNTED = "lang string, phrase string, words int, n long, before boolean, after boolean"


def _counted(docs: DataFrame, filter_: np.ndarray, least: int) -> DataFrame:
    """lang, phrase, words, n, before, after of all words and phrases that occur at least so often, and the number of all words as that of the phrase ''."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(lang: str, phrases: list[bytes], words: int, n: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
            k = len(phrases)
            return pa.record_batch([pa.array([lang] * k, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(k, words, np.int32)), pa.array(n), pa.array(before), pa.array(after)], ["lang", "phrase", "words", "n", "before", "after"])

        for shard in shards(batches):
            n = np.bincount(shard.ids, minlength=len(shard.words))
            some, no = np.flatnonzero(n[1:]) + 1, lambda k: np.zeros(k, bool)
            yield rows(shard.lang, [b""], 0, np.array([n[1:].sum()]), no(1), no(1))
            for a in range(0, len(some), 1 << 16):
                part = some[a : a + (1 << 16)]
                yield rows(shard.lang, [shard.words[i] for i in part.tolist()], 1, n[part], no(len(part)), no(len(part)))
            automaton = Automaton(shard.ids, left_over(shard, shared.value))
            for k in range(2, DEPTH + 1):
                end, n, before, after = automaton.substrings(k)
                for a in range(0, len(end), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    columns = ([shard.words[i] for i in shard.ids[end[part] - j].tolist()] for j in range(k - 1, -1, -1))
                    yield rows(shard.lang, [b" ".join(p) for p in zip(*columns)], k, n[part], before[part], after[part])

    total = docs.mapInArrow(released(run), COUNTED).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"), F.bool_and("before").alias("before"), F.bool_and("after").alias("after"))
    return materialize(total.filter((F.col("words") == 0) | (F.col("n") >= least)))


def phrases(docs: DataFrame, least: int = 100, bits: int = FILTER) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every phrase kept, of all languages."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_bytes().alias("content"))
    counted = _counted(texts, _filter(_keys(texts), least, bits), least)
    found = counted.filter("words >= 2").withColumn("parts", F.split("phrase", " "))
    longer = found.filter("words >= 3").select("lang", F.explode(F.array(F.slice("parts", F.lit(2), F.col("words") - 1), F.slice("parts", F.lit(1), F.col("words") - 1))).alias("inner"), "n")
    longer = longer.select("lang", F.array_join("inner", " ").alias("phrase"), "n").distinct()
    inside = found.filter("before or after").join(longer, ["lang", "phrase", "n"], "left_semi").select("lang", "phrase")
    kept = found.join(materialize(inside), ["lang", "phrase"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda begin, size: F.array_join(F.slice("parts", begin, size), " ")
    cuts = cuts.select("lang", "phrase", "words", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    of = lambda c, name: counted.filter("words > 0").select("lang", F.col("phrase").alias(c), F.col("n").alias(name))
    words = materialize(counted.filter("words = 0").select("lang", "n"))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(words, "lang")
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"top": exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)"), "bottom": exact("l") * exact("r")}).withColumn("score", F.expr("top div bottom"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, least: int = 100, top: int = 2000, bits: int = FILTER) -> DataFrame:
    """The first rows of each language by score, count and phrase: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases(docs, least, bits).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
