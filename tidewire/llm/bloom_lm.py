"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and of word pairs are taken over all training texts, exactly, by hash buckets. A count c is quantised to
1 + floor(log_BASE(c)) levels, and the filter holds one event (n-gram, j) for each level j up to that, in BITS bits; a
count is read back by probing j = 1, 2, ... until a probe fails. Texts are scored with

    p(w | h) = LAMBDA * c(h w) / c(h) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1)

all counts being read from the filter. Nothing is left out at any size, so the filter grows with the corpus; it is held in
one segment for each bucket and never in one place. Texts are gathered in portions. A portion sends its distinct words and
pairs, with their counts in its training texts, to their buckets; a bucket adds them up, fills its segment, and answers each
portion with the levels read back, and for words with the exact counts, which the base score needs. What a bucket and a
portion hold is bounded: the number of buckets follows the number of words.

Words are keyed by 64-bit xxh3 hashes, pairs by PAIR_BITS bits of a mix of two. Null and empty texts consist of the end
alone; repeated rows are scored, and count, repeatedly; without training texts N and V are 0 and nothing is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, released, text_bytes, text_chunks
from tidewire.llm.langid import held_out
from tidewire.llm.words import U64, WordKeys, mix, split

BASE, LAMBDA, BITS, HASHES, PAIR_BITS = 1.5, 0.35, 10, 4, 48
#: Words after which a portion is closed.
KNOWN = 1 << 20
#: Words of the corpus to a bucket, as a power of two, and the fewest buckets.
SHARE, FEWEST = 21, 64
BEGIN, END = U64(0x5BD1E995B1F0C3A7), U64(0x1B873593CC9E2D51)


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U64(0x9E3779B97F4A7C15) + second) >> U64(64 - PAIR_BITS)


def _sequence(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories and tokens of all texts, each text closed by its end; and the offsets of the texts."""
    n = np.diff(at)
    ends = np.cumsum(n + 1) - 1
    token = np.empty(len(keys) + len(n), U64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = keys, END
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[np.concatenate([[0], ends[:-1] + 1])] = BEGIN
    return history, token, np.concatenate([[0], ends + 1])


def _bits_of(key_bits: int, buckets: int) -> np.uint64:
    return U64(key_bits - (buckets.bit_length() - 1))


def _key_bits(order: int) -> int:
    return 64 if order == 1 else PAIR_BITS


def _packed(order: int, keys: np.ndarray) -> bytes:
    """Keys as bytes, without the two that are always 0 in pairs."""
    return keys.tobytes() if order == 1 else keys.view(np.uint8).reshape(-1, 8)[:, : PAIR_BITS // 8].tobytes()


def _unpacked(order: int, raw: bytes) -> np.ndarray:
    if order == 1:
        return np.frombuffer(raw, U64)
    own = np.frombuffer(raw, np.uint8).reshape(-1, PAIR_BITS // 8)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, : PAIR_BITS // 8] = own
    return out.reshape(-1).view(U64)


def _short(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max)).tobytes()


def _long(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n if n else 1]).astype(np.int64)


def _levels(counts: np.ndarray, least: int = 1) -> np.ndarray:
    return 1 + np.floor(np.log(counts / least) / math.log(BASE) + 1e-9).astype(np.int64)


def _values() -> np.ndarray:
    """Count that each number of levels read back stands for: the mean of the whole numbers it covers."""
    out = [0.0]
    for level in range(1, 96):
        low, high = math.ceil(BASE ** (level - 1) - 1e-9), math.ceil(BASE**level - 1e-9) - 1
        out.append((low + high) / 2 if high >= low else float(low))
    return np.array(out)


VALUES = _values()


class Filter:
    """Bits in segments of a fixed size, one for each bucket. All levels are held; skip is not read."""

    def __init__(self, buckets: int, segment: int, skip: dict[int, int] | None = None):
        self.buckets, self.segment = buckets, segment
        self.bits = np.empty(0, np.uint8)

    def hashes(self, order: int, keys: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the events (key, level): the first bit of their segment, and what their places within it derive from."""
        base = (keys >> _bits_of(_key_bits(order), self.buckets)) * U64(self.segment)
        return base, mix(keys * U64(2) + U64(order - 1) + np.asarray(level).astype(U64) * U64(0xD6E8FEB86659FD93))

    def place(self, base: np.ndarray, h: np.ndarray, i: int) -> np.ndarray:
        low = (h & U64(0xFFFFFFFF)) + U64(i) * ((h >> U64(32)) | U64(1))
        return base + (((low & U64(0xFFFFFFFF)) * U64(self.segment)) >> U64(32))

    def levels(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Levels read back: probed upwards, each by HASHES bits, until a bit is not set."""
        level, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for j in range(1, len(VALUES)):
            base, h = self.hashes(order, keys[live], j)
            for i in range(HASHES):
                place = self.place(base, h, i)
                on = (self.bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1).astype(bool)
                if not on.all():
                    live, base, h = live[on], base[on], h[on]
            if not len(live):
                break
            level[live] = j
        return level

    def probe(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Counts read back."""
        return VALUES[self.levels(order, keys)]


def filled(order: int, keys: np.ndarray, counts: np.ndarray) -> Filter:
    """One segment with all levels of the given counts, of BITS bits an event."""
    levels = _levels(counts)
    model = Filter(1, max(64, -(-int(levels.sum()) * BITS // 64) * 64))
    bits = np.zeros(model.segment, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        base, h = model.hashes(order, keys[levels >= j], j)
        for i in range(HASHES):
            bits[model.place(base, h, i).astype(np.int64)] = True
    model.bits = np.packbits(bits, bitorder="little")
    return model


PORTION = "portion long, gram int, bucket int, keys binary, counts binary, doc_id array<long>, held_out array<boolean>, n array<long>, words long, trained long"


def _portions(docs: DataFrame) -> DataFrame:
    """Texts of about KNOWN words in one row: their distinct word keys (the end among them), sorted; in counts the place of each word's key; doc_id, held_out and words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = WordKeys(), TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal place
            keys, at = np.unique(np.concatenate([*(h[0] for h in held), [END]]), return_inverse=True)
            ids, out = (pa.concat_arrays([h[i] for h in held]) for i in (1, 2))
            n = np.concatenate([h[3] for h in held])
            held.clear()
            place += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (ids, out, pa.array(n))]
            numbers = [pa.array([x], t) for x, t in ((place, pa.int64()), (0, pa.int32()), (0, pa.int32()))]
            return pa.record_batch([*numbers, pa.array([keys.tobytes()]), pa.array([_short(at[:-1])]), *lists, pa.array([int(n.sum())]), pa.array([len(n) - int(out.true_count)])], ["portion", "gram", "bucket", "keys", "counts", "doc_id", "held_out", "n", "words", "trained"])

        for chunk in text_chunks(batches, "content", 2 << 20):
            flat, at = split(chunk.column(2).to_pylist())
            ids = words.lookup(flat)
            held.append((words.keys[ids], chunk.column(0), chunk.column(1), np.diff(at)))
            if sum(len(h[0]) for h in held) >= KNOWN:
                yield close()
        if held:
            yield close()

    return materialize(docs.select("doc_id", "held_out", text_bytes().alias("content")).mapInArrow(released(run), PORTION))


def _read(keys: bytes, places: bytes, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a portion: word keys, the place of each token among them, offsets of the texts; pair keys, the place of each token's pair among them."""
    keys = np.frombuffer(keys, U64)
    at = np.concatenate([[0], np.cumsum(n)])
    own = _long(places, int(at[-1]))
    history, token, to = _sequence(keys[own], at)
    word = np.full(len(token), np.searchsorted(keys, END))
    inner = np.ones(len(token), bool)
    inner[to[1:] - 1] = False
    word[inner] = own
    pairs, pair = np.unique(_pairs(history, token), return_inverse=True)
    return keys, word, to, pairs, pair


def _asked(portions: DataFrame, buckets: int) -> DataFrame:
    """(portion, gram, bucket, size, keys, counts): distinct words (1) and pairs (2) of each portion by bucket, sorted, with their counts in its training texts, which may be 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                portion, places, raw, held_out, n = (batch.column(k)[i] for k in range(5))
                n = n.values.to_numpy()
                words, word, to, pairs, pair = _read(raw.as_py(), places.as_py(), n)
                learnt = np.repeat(~held_out.values.to_numpy(zero_copy_only=False), n + 1)
                rows = []
                for order, keys, ids in ((1, words, word), (2, pairs, pair)):
                    counts = np.bincount(ids[learnt], minlength=len(keys))
                    cut = np.searchsorted(keys, np.arange(1, buckets, dtype=U64) << _bits_of(_key_bits(order), buckets))
                    rows += [(portion.as_py(), order, b, len(k), _packed(order, k), _short(c)) for b, (k, c) in enumerate(zip(np.split(keys, cut), np.split(counts, cut))) if len(k)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["portion", "gram", "bucket", "size", "keys", "counts"])

    return portions.select("portion", "counts", "keys", "held_out", "n").mapInArrow(released(run), "portion long, gram int, bucket int, size long, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(portion, gram, bucket, keys, counts, words, trained): the levels (keys) of what a portion asked and, of words, the exact counts, in the same order. One row without a portion for each bucket has its tokens (words) and distinct n-grams in training texts (trained)."""

    def answer(rows: pa.Table) -> pa.Table:
        order, bucket = rows.column("gram")[0].as_py(), rows.column("bucket")[0].as_py()
        size = rows.column("size").to_numpy()
        asked = np.concatenate([_unpacked(order, k) for k in rows.column("keys").to_pylist()])
        counts = np.concatenate([_long(c, n) for c, n in zip(rows.column("counts").to_pylist(), size.tolist())])
        keys, own = np.unique(asked, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, own, counts)
        seen = total > 0
        level = filled(order, keys[seen], total[seen]).levels(order, keys)
        cut = np.cumsum(size)[:-1]
        levels = [x.astype(np.uint8).tobytes() for x in np.split(level[own], cut)] + [b""]
        exact = [_short(x) for x in np.split(total[own], cut)] + [b""] if order == 1 else [b""] * len(levels)
        n = len(levels)
        columns = [rows.column("portion").to_pylist() + [None], [order] * n, [bucket] * n, levels, exact, [0] * (n - 1) + [int(total.sum())], [0] * (n - 1) + [int(seen.sum())]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["portion", "gram", "bucket", "keys", "counts", "words", "trained"])

    return materialize(asked.groupBy("gram", "bucket").applyInArrow(answer, "portion long, gram int, bucket int, keys binary, counts binary, words long, trained long"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, held_out, text), learning from those that are not held out."""
    portions = _portions(docs)
    size = portions.agg(F.sum("words").alias("words"), F.sum("trained").alias("trained")).first()
    n_docs = size["trained"] or 0
    buckets = max(FEWEST, 1 << ((size["words"] or 0) >> SHARE).bit_length())
    answers = _answered(_asked(portions, buckets))
    found = answers.filter("portion is null and gram = 1").agg(F.sum("words").alias("total"), F.sum("trained").alias("distinct")).first()
    total, distinct = found["total"] or 0, found["distinct"] or 0
    scale = math.log10(max(1, total + distinct + 1))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("gram", "ascending"), ("bucket", "ascending")])
        gram = rows.column("gram").to_numpy()
        first = rows.slice(0, 1)
        ids, held, n = (first.column(c).combine_chunks().values for c in ("doc_id", "held_out", "n"))
        words, word, to, pairs, pair = _read(first.column("keys")[0].as_py(), first.column("counts")[0].as_py(), n.to_numpy())
        levels = rows.column("keys").to_pylist()
        counts = rows.column("counts").to_pylist()
        of = lambda order: np.frombuffer(b"".join(levels[i] for i in np.flatnonzero(gram == order)), np.uint8)
        exact = np.concatenate([_long(counts[i], len(levels[i])) for i in np.flatnonzero(gram == 1)])[word]
        read, both = VALUES[of(1)][word], VALUES[of(2)][pair]
        before = np.empty(len(word))
        before[1:] = read[:-1]
        before[to[:-1]] = n_docs
        p = (1 - LAMBDA) * (read + 1) / (total + distinct + 1) + LAMBDA * np.minimum(1.0, both / np.maximum(before, np.maximum(both, 1)))
        sums = lambda x: np.add.reduceat(x, to[:-1])
        columns = [ids, held, pa.array(np.diff(to)), pa.array(sums((exact > 0).astype(np.int64))), pa.array(np.full(len(n), total)), pa.array(sums(np.log10(exact + 1)) - np.diff(to) * scale), pa.array(sums(np.log10(p)))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    together = portions.unionByName(answers.filter("portion is not null"), allowMissingColumns=True)
    return together.groupBy("portion").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """All documents, learning from those that are not held out."""
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out")))
