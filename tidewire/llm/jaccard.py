"""Exact set-similarity join of documents on word shingles, with set-relation skipping.

Two documents link when |A & B| * den >= |A | B| * num. The stages:

1. The global order of shingles puts rare ones first: by the product of their words' counts over all documents, in
   powers of two, then by hash; shingles counted to be frequent themselves go last. This affects only the work: the join
   is exact under any order.
2. Every document becomes its set's size, digest, prefix and a parity bitmap. Equal sets become one class, whose smallest
   doc_id represents it, so copies cost nothing later on.
3. Index lists: the prefix entries of each shingle. Lists with one set are skipped at once, as are all but the first of
   lists with the same sets. Within a list, entries lie by
   set size and position in blocks of STEP, and two blocks whose sizes and positions rule out all their pairs are skipped
   unread; then size, position and bitmap rule out single pairs.
4. Answer-level skipping: a set that a list shows to be very similar to others gets its answer, the component, from one of
   them: it is tied to that one alone, the smallest if it can be, and compared only with sets its group has not reached.
   Ties are verified against the whole sets. Lists over SPLIT entries are dealt out in parts by set; the first sets of the
   parts' groups are grouped in turn. Only lists with a failed tie, and long lists that end in several components, are read
   again; there sets of different components are compared one by one, the largest component of a long list never with itself.
5. Components over the verified links.

A document without words, or with a null text, has the size 0 and links with nothing. Rows with one doc_id are one
document in the graph. A null doc_id links with nothing and has a null component. An empty table gives an empty one; other
columns are ignored, whatever their names. A very long text is read whole by one task, its bitmap has at most MOST_BITS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import drop, materialize, released, shuffles_removed, small, text_bytes, text_chunks
from tidewire.llm.components import components
from tidewire.llm.words import U64, WordKeys, ranges, shingles, split

#: Bits of a parity bitmap: LEAST_BITS up to twice as many shingles, above that the next power of two, of which MOST_BITS are enough.
LEAST_BITS, MOST_BITS = 512, 1 << 15
#: So many times as many bits at most has the wide bitmap of a set, by which the pairs of lists that are read again are told apart; WIDE bits a shingle, and up to twice as many, are enough.
WIDER, WIDE = 8, 4
#: A shingle in so many documents counts as frequent, if a chunk of text has it in at least LOCAL of its documents.
FREQUENT, LOCAL, MOST_FREQUENT = 256, 3, 1 << 20
#: A word counts as common if a chunk of text has it so often; so many of them are told apart by their counts.
COMMON, MOST_COMMON = 4, 1 << 16
#: Entries in a block of a list; pairs of entries that are compared in one numpy step.
STEP, PORTION = 16, 1 << 17
#: A longer list is dealt out to several tasks, in parts of about so many entries.
SPLIT = 256
#: Members of a group are verified in so many separate tasks at most.
SALTS = 64


def _set_rows(texts: list[bytes], words: WordKeys, width: int) -> tuple[np.ndarray, np.ndarray]:
    flat, at = split(texts)
    ids = words.lookup(flat)
    return shingles(words.keys[ids], at, width)


def _unique(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of each row."""
    for a, b in zip(at.tolist(), at[1:].tolist()):
        keys[a:b].sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    n = np.concatenate([[0], np.cumsum(first)])[at]
    return keys[first], n


def _counted(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of frequent shingles, sorted; keys of common words, sorted, and the logarithms of their counts in 16ths."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordKeys()
        for chunk in text_chunks(batches, "content"):
            flat, at = split(chunk.column(0).to_pylist())
            ids = words.lookup(flat)
            times = np.bincount(ids, minlength=1)
            common = np.flatnonzero(times >= COMMON)
            keys, _ = _unique(*shingles(words.keys[ids], at, width))
            keys, n = np.unique(keys >> U64(1), return_counts=True)
            some = n >= LOCAL
            key = np.concatenate([keys[some], words.keys[common]]).view(np.int64)
            yield pa.record_batch([pa.array(np.repeat([False, True], [int(some.sum()), len(common)])), pa.array(key), pa.array(np.concatenate([n[some], times[common]]))], ["word", "key", "n"])

    local = docs.select(text_bytes().alias("content")).mapInArrow(released(count), "word boolean, key long, n long")
    total = materialize(local.groupBy("word", "key").agg(F.sum("n").alias("n")))
    top = lambda rows, most: rows.orderBy(F.desc("n"), "key").limit(most).select("key", "n").toArrow()
    frequent = top(total.filter(~F.col("word") & (F.col("n") >= FREQUENT)), MOST_FREQUENT).column(0).to_numpy().astype(U64)
    common = top(total.filter("word"), MOST_COMMON)
    key, n = common.column(0).to_numpy().astype(U64), common.column(1).to_numpy()
    order = np.argsort(key)
    return np.sort(frequent), key[order], np.rint(16 * np.log2(np.maximum(n[order], 1))).astype(np.int64)


def _bits(n: np.ndarray) -> np.ndarray:
    return np.where(n <= 2 * LEAST_BITS, LEAST_BITS, np.minimum(MOST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)))


def _wide_bits(n: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(WIDE * n, 1))).astype(np.int64), LEAST_BITS, WIDER * _bits(n))


def _parity(keys: np.ndarray, n: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The parity bitmap, of so many bits, of each of the sets of n keys that follow each other."""
    ends = np.cumsum(bits)
    bit = np.repeat(ends - bits, n) + (keys & np.repeat(bits - 1, n).astype(U64)).astype(np.int64)
    parity = np.packbits(np.bincount(bit, minlength=int(ends[-1])) & 1, bitorder="little").tobytes()
    return [parity[b - a : b] for a, b in zip((bits // 8).tolist(), (ends // 8).tolist())]


class Order:
    """The global order of shingles. Keys in it: a bit for frequent shingles, 6 bits of the words' counts, 57 bits of hash."""

    def __init__(self, counted: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, words: WordKeys | None = None):
        self.frequent, self.common, self.weight = counted
        self.width, self.words = width, words or WordKeys()
        self.generation = self.words.generation
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.frequent >> U64(41)] = True
        self.known = np.empty(0, np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct shingles of each text, in order, and their offsets."""
        flat, at = split(texts)
        ids = self.words.lookup(flat)
        if self.generation != self.words.generation:
            self.known, self.generation = np.empty(0, np.int64), self.words.generation
        if len(fresh := self.words.keys[len(self.known) :]):
            weight = np.zeros(len(fresh), np.int64)
            if len(self.common):
                i = np.minimum(np.searchsorted(self.common, fresh), len(self.common) - 1)
                weight = np.where(self.common[i] == fresh, self.weight[i], 0)
            self.known = np.concatenate([self.known, weight])
        keys, to = shingles(self.words.keys[ids], at, self.width)
        sums = np.concatenate([[0], np.cumsum(self.known[ids])])
        begin = ranges(at[:-1], np.diff(to))
        end = np.minimum(begin + self.width, np.repeat(at[1:], np.diff(to)))
        level = np.minimum((sums[end] - sums[begin]) * 3 // (16 * self.width), 63)
        hashed = keys >> U64(1)
        keys = (keys >> U64(7)) | (level.astype(U64) << U64(57))
        maybe = np.flatnonzero(self.filter[hashed >> U64(41)])
        if len(maybe):
            i = np.minimum(np.searchsorted(self.frequent, hashed[maybe]), len(self.frequent) - 1)
            keys[maybe[self.frequent[i] == hashed[maybe]]] |= U64(1 << 63)
        return _unique(keys, to)


def _sets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, size, digest, prefix, bitmap and wide bitmap of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(_counted(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(shared.value, width)
        for chunk in text_chunks(batches, "content"):
            keys, at = order(chunk.column(1).to_pylist())
            n = np.diff(at)
            digest = [xxhash.xxh3_128_digest(keys[a:b].tobytes()) for a, b in zip(at.tolist(), at[1:].tolist())]
            need = -(-n * num // den)
            prefix = np.where(n > 0, n - need + 1, 0)
            flat = keys[ranges(at[:-1], prefix)].view(np.int64)
            yield pa.record_batch(
                [
                    chunk.column(0),
                    pa.array(n),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)), pa.array(flat)),
                    pa.array(_parity(keys, n, _bits(n)), pa.binary()),
                    pa.array(_parity(keys, n, _wide_bits(n)), pa.binary()),
                ],
                ["doc_id", "n", "digest", "prefix", "bitmap", "wide"],
            )

    return docs.select("doc_id", text_bytes().alias("content")).mapInArrow(released(run), "doc_id long, n long, digest binary, prefix array<long>, bitmap binary, wide binary")


class _Bitmaps:
    """Parity bitmaps of entries. The bitmap of a larger set is folded to the width of the smaller one's."""

    def __init__(self, raw: list[bytes]):
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.width = size
        self.row = np.zeros(len(raw), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(size).tolist():
            own = np.flatnonzero(size == w)
            self.row[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(raw[i] for i in own.tolist()), np.uint64).reshape(len(own), w // 8)

    def _at(self, i: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(i), width // 8), np.uint64)
        own = self.width[i]
        for w in np.unique(own).tolist():
            some = own == w
            x = self.rows[w][self.row[i[some]]]
            while x.shape[1] > width // 8:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[some] = x
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of how many elements only one of the two sets has."""
        width = np.minimum(self.width[a], self.width[b])
        out = np.empty(len(a), np.int64)
        for w in np.unique(width).tolist():
            some = np.flatnonzero(width == w)
            for part in np.array_split(some, -(-len(some) * w // (1 << 22))):
                out[part] = np.bitwise_count(self._at(a[part], w) ^ self._at(b[part], w)).sum(1, dtype=np.int64)
        return out


def _likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, pos: np.ndarray, bitmaps: _Bitmaps, num: int, den: int) -> np.ndarray:
    """Which entry pairs the bounds on size, position and parity bitmap leave over."""
    na, nb = n[a], n[b]
    need = -(-(na + nb) * num // (num + den))
    ok = np.flatnonzero((np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (np.minimum(na - pos[a], nb - pos[b]) >= need))
    if len(ok):
        ok = ok[bitmaps.apart(a[ok], b[ok]) <= (na + nb - 2 * need)[ok]]
    keep = np.zeros(len(a), bool)
    keep[ok] = True
    return keep


def _pairs(list_at: np.ndarray, list_n: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of the same list, in bounded portions. Entries lie by set size and position, and every STEP of them are a block, of which the least and largest size and the longest rest of a set behind its position are known: two blocks that these rule out are skipped unread."""
    blocks = -(-list_n // STEP)
    begin = np.repeat(list_at, blocks) + STEP * ranges(np.zeros_like(blocks), blocks)
    end = np.minimum(begin + STEP, np.repeat(list_at + list_n, blocks))
    least, most, rest = n[begin], n[end - 1], np.maximum.reduceat(n - pos, begin)
    own = np.arange(len(begin))
    count = np.repeat(np.cumsum(blocks), blocks) - own
    x, y = np.repeat(own, count), ranges(own, count)
    need = -(-(least[x] + least[y]) * num // (num + den))
    read = (least[y] * num <= most[x] * den) & (np.minimum(rest[x], rest[y]) >= need)
    x, y = x[read], y[read]
    wide = (end - begin)[y]
    ends = np.cumsum((end - begin)[x] * wide)
    at = 0
    while at < len(x):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        size = np.diff(ends[at:stop], prepend=ends[at - 1] if at else 0)
        k = ranges(np.zeros(stop - at, np.int64), size)
        w = np.repeat(wide[at:stop], size)
        a, b = np.repeat(begin[x[at:stop]], size) + k // w, np.repeat(begin[y[at:stop]], size) + k % w
        yield a[a < b], b[a < b]
        at = stop


def _forest(rank: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], likely: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs (a, b) that connect the entries as all likely pairs do, one for each entry but the first by rank of each group, and which entries are these first ones. Pairs already connected are not compared."""
    root, ends = np.arange(len(rank)), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a, b in pairs:
        new = root[rank[a]] != root[rank[b]]
        a, b = a[new], b[new]
        keep = likely(a, b)
        a, b = a[keep], b[keep]
        while len(a):
            ra, rb = root[rank[a]], root[rank[b]]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low < high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            joined = np.flatnonzero(root[high] == low)
            joined = joined[np.unique(high[joined], return_index=True)[1]]
            ends.append((a[joined], b[joined]))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    a, b = (np.concatenate(e) for e in zip(*ends))
    return a, b, root[rank] == rank


def _in_whole_lists(batches: Iterator[pa.RecordBatch], rows: int = 8192, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Sorted entries in tables that hold many whole lists, or parts of lists; only the list that is not complete yet is carried on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        new = np.flatnonzero(_starts(table))
        cut = int(new[-1])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table


def _starts(table: pa.Table) -> np.ndarray:
    """Which entries are the first of their list, or part of a list."""
    first = np.zeros(table.num_rows, bool)
    first[:1] = True
    for name in ("token", "low", "high"):
        column = table.column(name).to_numpy()
        first[1:] |= column[1:] != column[:-1]
    return first


ENTRY = ["token", "low", "high", "n", "pos", "node", "block", "split", "group", "bitmap"]
FOUND = "a long, b long, token long, n long, pos long, bitmap binary"


def _compared(entries: DataFrame, num: int, den: int, ties: bool) -> DataFrame:
    """From entries with the columns ENTRY, (a, b) to verify: the ties, one for each further entry of a group of likely pairs, or all likely pairs of different groups. Rows with a null b are the entries (of the set a) that stand for a group in a part of a split list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_whole_lists(batches):
            at = np.flatnonzero(_starts(rows))
            count = np.diff(np.append(at, rows.num_rows))
            token, low, high, n, pos, node, block, split, group = (rows.column(c).to_numpy() for c in ENTRY[:-1])
            bitmap = _Bitmaps(rows.column("bitmap").to_pylist())
            both_ways = low != high

            def open_(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return ~both_ways[a] | (block[a] != block[b])

            pairs = _pairs(at, count, n, pos, num, den)
            if ties:
                rank = np.empty(len(token), np.int64)
                rank[np.lexsort((node, np.repeat(at, count)))] = np.arange(len(token))
                a, b, first = _forest(rank, pairs, lambda a, b: open_(a, b) & _likely(a, b, n, pos, bitmap, num, den))
                other = node[a] != node[b]
                a, b = node[a[other]], node[b[other]]
                found = [(np.minimum(a, b), np.maximum(a, b))]
                stands = np.flatnonzero(split & first)
            else:
                found, stands = [], np.empty(0, np.int64)
                for a, b in pairs:
                    apart = (group[a] != group[b]) & open_(a, b)
                    a, b = a[apart], b[apart]
                    k = _likely(a, b, n, pos, bitmap, num, den)
                    found.append((np.minimum(node[a[k]], node[b[k]]), np.maximum(node[a[k]], node[b[k]])))
            two = np.unique(np.concatenate([np.stack(f, 1) for f in found]), axis=0) if found else np.empty((0, 2), np.int64)
            if len(two) + len(stands):
                rest = lambda x, t: pa.concat_arrays([pa.nulls(len(two), t), pa.array(x, t)])
                own = [rest(c[stands], pa.int64()) for c in (token, n, pos)]
                kept = rest(rows.column("bitmap").take(pa.array(stands)).to_pylist(), pa.binary())
                ends = pa.concat_arrays([pa.array(two[:, 1].copy()), pa.nulls(len(stands), pa.int64())])
                yield pa.record_batch([pa.array(np.concatenate([two[:, 0], node[stands]])), ends, *own, kept], ["a", "b", "token", "n", "pos", "bitmap"])

    order = ["token", "low", "high"]
    return entries.select(*ENTRY).repartition(*order).sortWithinPartitions(*order, "n", "pos", "node").mapInArrow(released(run), FOUND)


def _in_parts(entries: DataFrame, level: int, pairs: bool) -> DataFrame:
    """Entries (token, size, node, ...) of lists over SPLIT dealt by node into parts of about SPLIT: by themselves, or, if pairs, a part with every other one."""
    parts = F.ceil(F.col("size") / SPLIT)
    own = F.when(F.col("size") > SPLIT, F.pmod(F.xxhash64(F.lit(level), "node"), parts)).otherwise(F.lit(0)).cast("long")
    dealt = entries.withColumn("block", own)
    if not pairs:
        return dealt.withColumns({"low": F.col("block"), "high": F.col("block"), "split": F.col("size") > SPLIT})
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("size") > SPLIT, parts - 1).otherwise(F.lit(0)).cast("long"))))
    return met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "split": F.lit(False)})


def _ties(shared: DataFrame, long: int, num: int, den: int) -> DataFrame:
    """(a, b) to verify, which leave no likely pair of a list of at most SPLIT entries unconnected. Of longer lists, with so many entries, the parts are grouped by themselves, then the sets that stand for their groups in the same way, until a list is short or these no longer get fewer; then they are compared part with part."""
    at, found, before, level = shared, None, None, 0
    while True:
        pairs = before is not None and 2 * long > before
        out = materialize(_compared(_in_parts(at, level, pairs).withColumn("group", F.col("node")), num, den, True))
        ties = out.filter("b is not null").select("a", "b")
        found, level = ties if found is None else found.union(ties), level + 1
        if not long or pairs:
            return found.distinct()
        heads = out.filter("b is null").select("token", F.col("a").alias("node"), "n", "pos", "bitmap")
        sizes = materialize(heads.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"))
        at = heads.join(small(sizes)(sizes), "token")
        before, long = long, sizes.filter(F.col("size") > SPLIT).agg(F.sum("size")).first()[0] or 0


def _between_groups(entries: DataFrame) -> DataFrame:
    """Entries (token, size, node, group, ...) of lists with several groups, in parts. In a list over SPLIT the largest group is not compared with itself: its parts meet those of the other groups alone."""
    members = entries.groupBy("token", "group").agg(F.count("*").alias("n_group"))
    main = members.groupBy("token").agg(F.max(F.struct("n_group", "group")).alias("main"), F.sum("n_group").alias("size"), F.count("*").alias("groups")).filter("groups > 1")
    main = materialize(main.select("token", "size", F.col("main.group").alias("main"), F.ceil(F.col("main.n_group") / SPLIT).alias("parts"), F.ceil((F.col("size") - F.col("main.n_group")) / SPLIT).alias("others")))
    several = entries.drop("size").join(small(main)(main), "token")
    long, hashed = F.col("size") > SPLIT, F.xxhash64(F.lit("group"), "node")
    own = F.when(F.col("group") == F.col("main"), F.pmod(hashed, F.col("parts"))).otherwise(F.col("parts") + F.pmod(hashed, F.col("others")))
    first = F.when(F.col("group") == F.col("main"), F.col("parts")).otherwise(F.lit(0))
    dealt = several.withColumn("block", F.when(long, own).otherwise(F.lit(0)).cast("long"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.when(long, first).otherwise(F.lit(0)).cast("long"), F.when(long, F.col("parts") + F.col("others") - 1).otherwise(F.lit(0)).cast("long"))))
    return met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "split": F.lit(False)})


def _verify(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b, linked): the pairs compared on their whole sets. docs: (node, content); of a node with several texts any may link."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    asked = dealt.select("a", "salt", F.col("b").alias("node"), F.lit(False).alias("head")).union(dealt.select("a", "salt", F.col("a").alias("node"), F.lit(True).alias("head")).distinct())
    asked = materialize(asked)
    sent = docs.join(small(asked, 500_000)(asked), "node").select("a", "salt", "node", "head", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group, heads = WordKeys(), None, {}
        for chunk in text_chunks(batches, "content"):
            keys, at = _unique(*_set_rows(chunk.column(4).to_pylist(), words, width))
            out = []
            for i, (a, salt, node, head) in enumerate(zip(*(chunk.column(k).to_pylist() for k in range(4)))):
                own = keys[at[i] : at[i + 1]]
                if group != (a, salt):
                    group, heads = (a, salt), {}
                if head:
                    heads[own.tobytes()] = own
                else:
                    out.append((a, node, any(_linked(own, held, num, den) for held in heads.values())))
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], ["a", "b", "linked"])

    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("head"), "node").mapInArrow(released(run), "a long, b long, linked boolean").groupBy("a", "b").agg(F.bool_or("linked").alias("linked"))


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    short, long = (x, y) if len(x) < len(y) else (y, x)
    if not len(short):
        return False
    both = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return both * den >= (len(x) + len(y) - both) * num


def join(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; component_id is the smallest doc_id reachable by links, itself included."""
    with shuffles_removed(docs.sparkSession):
        return _joined(docs, width, num, den)


def _first_lists(entries: DataFrame) -> DataFrame:
    """(token, size): of lists with the same entries the one whose shingle comes first in the global order. Its entries lie foremost in their sets, so the bounds leave all pairs that those of the others leave; near copies share most of their prefixes, and with them as many lists."""
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "node", "n"))
    unsigned = F.col("token").bitwiseXOR(F.lit(-(1 << 63)))
    alike = entries.groupBy("token", "size").agg(mark("a").alias("a"), mark("b").alias("b")).groupBy("size", "a", "b")
    return alike.agg(F.min(unsigned).alias("first")).select(F.col("first").bitwiseXOR(F.lit(-(1 << 63))).alias("token"), "size")


def _joined(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    sets = materialize(_sets(docs, width, num, den))
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("node"), F.min_by("prefix", "doc_id").alias("prefix"), F.min_by("bitmap", "doc_id").alias("bitmap"), F.min_by("wide", "doc_id").alias("wide"))
    classes = materialize(classes)
    known = materialize(sets.select("doc_id", "n", "digest", ((F.col("n") > 0) & F.col("doc_id").isNotNull()).alias("usable")))
    drop(sets)
    usable = known.filter("usable")
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    several = materialize(entries.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"))
    met = materialize(entries.join(several, "token").select("token", "node", "n", "pos", "size"))
    lists = materialize(_first_lists(met))
    bitmaps = lambda c: classes.select(F.col("node").alias("bitmap_node"), F.col("n").alias("bitmap_n"), F.col(c).alias("bitmap"))
    own = (F.col("node") == F.col("bitmap_node")) & (F.col("n") == F.col("bitmap_n"))
    shared = materialize(met.drop("size").join(small(lists, 500_000)(lists), "token").join(bitmaps("bitmap"), own).select("token", "node", "n", "pos", "size", "bitmap"))
    drop(several)
    drop(met)
    long = lists.filter(F.col("size") > SPLIT)
    ties = _ties(shared, long.agg(F.sum("size")).first()[0] or 0, num, den)
    contents = docs.filter("doc_id is not null").select(F.col("doc_id").alias("node"), text_bytes().alias("content"))
    checked = materialize(_verify(materialize(ties), contents, width, num, den))
    # Documents with one id, but with rows of several classes, connect these.
    of_class = classes.select("digest", "n", "node")
    torn = usable.select("doc_id", "digest", "n").distinct().groupBy("doc_id").agg(F.count("*").alias("classes")).filter("classes > 1").select("doc_id")
    torn = materialize(usable.join(torn, "doc_id").join(of_class, ["digest", "n"]).select("doc_id", "node"))
    linked = checked.filter("linked").select("a", "b").union(torn.join(torn.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
    group = materialize(components(linked))
    near = small(group, 500_000)
    failed = checked.filter("not linked").select(F.col("b").alias("node")).distinct()
    # A pair that its ties leave unconnected has one that failed, or lies in a split list: only such lists are read again.
    tokens = materialize(shared.join(small(failed, 500_000)(failed), "node", "left_semi").select("token").union(long.select("token")).distinct())
    ends = group.select(F.col("node").alias("end"), "component")
    if tokens.limit(1).count():
        again = shared.join(small(tokens, 500_000)(tokens), "token", "left_semi").join(near(group), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        again = materialize(again.drop("bitmap"))
        drop(shared)
        # Pairs of different groups mostly link with nothing: those that fall just short of it are ruled out by wide bitmaps, before they are rows.
        apart = _between_groups(again).join(bitmaps("wide"), own)
        rest = materialize(_compared(apart, num, den, False).select("a", "b").distinct())
        rest = materialize(rest.join(small(checked, 500_000)(checked.select("a", "b")), ["a", "b"], "left_anti"))
        more = materialize(_verify(rest, contents, width, num, den).filter("linked").select("a", "b"))
        if more.limit(1).count():
            of = lambda c: group.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
            joined = more.join(near(of("a")), "a", "left").join(near(of("b")), "b", "left").select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
            wider = components(joined).select(F.col("node").alias("component"), F.col("component").alias("wider"))
            alone = wider.join(group.select("component"), "component", "left_anti")
            grown = group.join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
            ends = materialize(grown.union(alone.select("component", "wider"))).select(F.col("node").alias("end"), "component")
    ends = of_class.join(ends, F.col("node") == F.col("end"), "left").select("digest", "n", F.coalesce("component", "node").alias("component"), F.lit(True).alias("usable"))
    return known.join(ends, ["digest", "n", "usable"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, without those that a document with a smaller doc_id stands for. Of rows alike in doc_id and text one stays; a null doc_id stays."""
    found = materialize(join(docs, width, num, den).filter("doc_id is not null").select("doc_id", "component_id"))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(small(gone, 1_000_000)(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    if not repeated.limit(1).count():
        return left
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(left.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
