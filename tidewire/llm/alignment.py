"""Alignment of two tokenizers over a corpus: which ids of A and B cover the same bytes, and how often each pair does so.

Both tokenizers see space + text. Neither joins anything across a single blank or line break between two characters that
are no white space: A's words begin there, and no piece of B has a mark or a line break behind another character. So texts
are cut into units there, each distinct unit is encoded once by the libraries, and a text is the row of its units. Within
a unit the token ends of A and B cut its bytes into segments; each segment is one overlapping pair (a link), and ends that
both share close a group.

Counting: every partition counts its pairs, packed into an int64, with np.unique; the partial counts go through a
range-partitioned sort by the packed key, and one pass over each sorted range adds up the runs of a key and writes them as
a sorted shard into the shared folder. Shards are memory-mapped by the workers and read by searchsorted, so what a worker
holds does not grow with the pairs. A list of the shards, one row a partition, and the highest count of each B id go
through the driver; the latter has at most as many rows as B has ids.

A null or empty text, and one whose tokens of A or B do not spell space + text (a U+2581, say, which B takes for a blank), has
no tokens: zeros, '' as digest, no part in any count. Rows are encoded one by one: repeated rows are counted again. An
empty table gives an empty one; other columns are ignored. A very long text is held by one task with its units.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import stores, vocabulary
from tidewire.llm.common import materialize, released, text_chunks
from tidewire.llm.words import ranges

#: Default place of A's file; B's is vocabulary.MODEL.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: An id of A stands above so many bits of a packed pair, an id of B below.
BITS = 32
#: Units kept by a worker, and pairs counted by a task before they are handed on.
UNITS, PAIRS = 1_000_000, 1 << 21
_CUT = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")
_BLANKS = re.compile(r"\s\s|^\s|\s$")


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """Bytes of numbered tokens in one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.buffer[ranges(self.start[ids], self.length[ids])]

    def spells(self, ids: np.ndarray, n: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of the texts (of so many bytes each, one after the other) are spelled by their ids (n each)."""
        total = np.diff(np.concatenate([[0], np.cumsum(self.length[ids])])[np.concatenate([[0], np.cumsum(n)])])
        same = total == size
        if not same.all():
            ids, text = ids[np.repeat(same, n)], text[np.repeat(same, size)]
        wrong = np.flatnonzero(self.joined(ids) != text)
        held = np.flatnonzero(same)
        same[held[np.searchsorted(np.cumsum(size[held]), wrong, "right")]] = False
        return same


class Tokenizers:
    """Both libraries' tokenizers and the bytes of every id."""

    def __init__(self, json: str, proto: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(json), sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.a.encode_special_tokens = True
        byte = _bytes_of_chars()
        entry = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        n = self.b.get_piece_size()
        self.spelling_a = Spelling([bytes(byte[c] for c in entry[i]) if i in entry else b"" for i in range(max(entry) + 1)])
        self.spelling_b = Spelling([bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)])
        self.decimal = Spelling([str(i).encode() for i in range(max(n, max(entry) + 1))])
        if any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in map(self.b.id_to_piece, range(n))):
            raise ValueError("B joins over blanks or line breaks")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of units. A unit has a space before it, its own if it begins with one, unless it begins with a line break."""
        a = [e.ids for e in self.a.encode_batch_fast([u if u[0] in " \n" else f" {u}" for u in units], add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return a, [ids[1:] if u[0] == "\n" else ids for u, ids in zip(units, b)]

    def spelled_groups(self, ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """The text of every unit's groups, `a1,a2|b1;a3|b2,b3`. The tokens of A and of B come in the order of their groups; a unit has so many of both."""
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
        for at, own, group, last in ((at_a, ids_a, group_a, b"|"), (at_b, ids_b, group_b, b";")):
            ids[at] = own
            mark[at] = np.where(np.diff(group, append=-1) != 0, last[0], b","[0])
        size = self.decimal.length[ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(size.sum()), np.uint8)
        out[end - 1] = mark
        out[ranges(end - size, size - 1)] = self.decimal.joined(ids)
        text, cut = out.tobytes(), np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(tokens)])].tolist()
        return [text[a : b - 1] if b > a else b"" for a, b in zip(cut, cut[1:])]


@lru_cache(maxsize=1)
def units(json: str, proto: bytes) -> Units:
    return Units(Tokenizers(json, proto))


def cut(text: str) -> list[str]:
    """Units of a text that is not empty. The first one begins with the space before the text if white space follows it."""
    if not _BLANKS.search(text):
        return text.replace("\n", " \n").split(" ")
    parts = _CUT.split(text)
    if parts[0][0].isspace():
        parts[0] = f" {parts[0]}"
    return parts


class Units:
    """What a worker knows of the units met so far, by unit number; clear() forgets all."""

    def __init__(self, tokenizers: Tokenizers, limit: int = UNITS):
        self.tokenizers, self.limit, self.generation = tokenizers, limit, 0
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.good = np.empty(0, bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.empty(0, np.int64) for _ in range(4))
        self.links, self.link_at = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.groups: list[bytes] = []
        self.generation += 1

    def full(self) -> bool:
        return len(self.number) > self.limit

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit numbers of all texts, the offsets of each text's, and which texts have tokens; the others have no units."""
        parts = [cut(t) if t else [] for t in texts]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        unit = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(at[-1]))
        if new := len(self.number) - len(self.good):
            fresh = list(islice(reversed(self.number), new))[::-1]
            for i in range(0, new, 20_000):
                self._learn(fresh[i : i + 20_000])
        bad = np.concatenate([[0], np.cumsum(~self.good[unit])])
        whole = (np.diff(at) > 0) & (np.diff(bad[at]) == 0)
        size = np.where(whole, np.diff(at), 0)
        return unit[ranges(at[:-1], size)], np.concatenate([[0], np.cumsum(size)]), whole

    def _learn(self, fresh: list[str]) -> None:
        t = self.tokenizers
        raw = [(u if u[0] in " \n" else f" {u}").encode() for u in fresh]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        (ids_a, n_a), (ids_b, n_b) = (_flat(ids) for ids in t.encode(fresh))
        good = t.spelling_a.spells(ids_a, n_a, text, size) & t.spelling_b.spells(ids_b, n_b, text, size)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        end_a, end_b = np.cumsum(t.spelling_a.length[ids_a]), np.cumsum(t.spelling_b.length[ids_b])
        segment, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(end_a, segment), np.searchsorted(end_b, segment)
        # Both tokenizers end at every unit's end, so units are runs of segments and of groups.
        unit_end = np.cumsum(size * good)
        links = np.diff(np.searchsorted(segment, unit_end, "right"), prepend=0)
        groups = np.diff(np.searchsorted(both, unit_end, "right"), prepend=0)
        self.links = np.concatenate([self.links, ids_a[in_a] << BITS | ids_b[in_b]])
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.cumsum(links)])
        for name, x in (("good", good), ("n_a", n_a), ("n_b", n_b), ("n_groups", groups), ("n_links", links)):
            setattr(self, name, np.concatenate([getattr(self, name), x]))
        self.groups += t.spelled_groups(ids_a, np.searchsorted(both, end_a), ids_b, np.searchsorted(both, end_b), n_a + n_b)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, back = np.unique(keys, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, counts)
    return key, total


def _read(json_path: str, model_path: str) -> tuple[str, bytes]:
    with open(json_path, encoding="utf-8") as a, open(model_path, "rb") as b:
        return a.read(), b.read()


class Shards:
    """Counts of packed pairs in sorted shards, each mapped into memory when first asked."""

    def __init__(self, listed: list[tuple[int, str]]):
        self.first = np.array([f for f, _ in listed], np.int64)
        self.path, self.open = [p for _, p in listed], {}

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            rows = pa.ipc.open_file(stores.mapped(self.path[i])).read_all().combine_chunks()
            self.open[i] = rows.column(0).chunk(0).to_numpy(), rows.column(1).chunk(0).to_numpy()
        return self.open[i]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys; 0 of one that no shard has."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.first, keys, "right") - 1
        for i in np.unique(shard[shard >= 0]).tolist():
            own = np.flatnonzero(shard == i)
            key, n = self._shard(i)
            at = np.minimum(np.searchsorted(key, keys[own]), len(key) - 1)
            out[own] = np.where(key[at] == keys[own], n[at], 0)
        return out


def _partial(docs: DataFrame, files) -> DataFrame:
    """key, n: the pairs of each partition, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units(*files.value)
        key, n = np.empty(0, np.int64), np.empty(0, np.int64)
        times = np.zeros(0, np.int64)

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            used = np.flatnonzero(times)
            links = known.links[ranges(known.link_at[used], known.n_links[used])]
            return summed(np.concatenate([key, links]), np.concatenate([n, np.repeat(times[used], known.n_links[used])]))

        for chunk in text_chunks(batches, "text"):
            if known.full():
                key, n = gathered()
                known.clear()
                times = np.zeros(0, np.int64)
                if len(key) > PAIRS:
                    yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])
                    key, n = key[:0], n[:0]
            unit, _, _ = known(chunk.column(0).to_pylist())
            more = np.bincount(unit, minlength=len(known.good))
            more[: len(times)] += times
            times = more
        key, n = gathered()
        yield pa.record_batch([pa.array(key), pa.array(n)], ["key", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(run), "key long, n long")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys with the sum of each key's run of rows; a run that goes on in the next batch is carried over."""
    key, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        k = np.concatenate([key, batch.column(0).to_numpy()])
        if not len(k):
            continue
        v = np.concatenate([n, batch.column(1).to_numpy()])
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total = np.add.reduceat(v, start)
        yield k[start[:-1]], total[:-1]
        key, n = k[start[-1:]], total[-1:]
    if len(key):
        yield key, n


def _shards(partial: DataFrame, folder: str) -> tuple[list[tuple[int, str]], DataFrame]:
    """(first key, path) of the shards, by first key; and b, best: the highest count of each B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = stores.located(folder)
        name, writer, first = uuid.uuid4().hex, None, None
        best = np.zeros(0, np.int64)
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
        for key, n in runs(batches):
            if not len(key):
                continue
            if writer is None:
                fs.create_dir(inner, recursive=True)
                sink = fs.open_output_stream(f"{inner}/{name}.arrow")
                writer, first = pa.ipc.new_file(sink, schema), int(key[0])
            writer.write_batch(pa.record_batch([pa.array(key), pa.array(n)], schema=schema))
            b = key & ((1 << BITS) - 1)
            best = np.concatenate([best, np.zeros(max(0, int(b.max()) + 1 - len(best)), np.int64)])
            np.maximum.at(best, b, n)
        if writer is not None:
            writer.close()
            sink.close()
            some = np.flatnonzero(best)
            none = lambda k, t: pa.nulls(k, t)
            yield pa.record_batch([pa.array([first]), pa.array([f"{folder}/{name}.arrow"]), none(1, pa.int64()), none(1, pa.int64())], ["first", "path", "b", "best"])
            yield pa.record_batch([none(len(some), pa.int64()), none(len(some), pa.string()), pa.array(some), pa.array(best[some])], ["first", "path", "b", "best"])

    out = materialize(partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(released(run), "first long, path string, b long, best long"))
    listed = [(r["first"], r["path"]) for r in out.filter("path is not null").collect()]
    return sorted(listed), out.filter("b is not null").groupBy("b").agg(F.max("best").alias("best"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """The counted alignment of a corpus: align() gives the documents' rows, pairs() the table of counted pairs."""

    def __init__(self, docs: DataFrame, a: str = BYTE_BPE, b: str = vocabulary.MODEL):
        self.docs, self.spark = docs, docs.sparkSession
        self.files = self.spark.sparkContext.broadcast(_read(a, b))
        partial = materialize(_partial(docs, self.files))
        self.shards, best = _shards(partial, stores.fresh(self.spark))
        rows = best.toArrow()
        b_id = rows.column("b").to_numpy()
        self.best = np.zeros(int(b_id.max(initial=-1)) + 1, np.int64)
        self.best[b_id] = rows.column("best").to_numpy()

    def pairs(self) -> DataFrame:
        """a, b, n: every linked pair of ids and how many links hold it."""
        if not self.shards:
            return self.spark.createDataFrame([], "a long, b long, n long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    file = pa.ipc.open_file(stores.mapped(path))
                    for i in range(file.num_record_batches):
                        key = file.get_batch(i).column(0).to_numpy()
                        yield pa.record_batch([pa.array(key >> BITS), pa.array(key & ((1 << BITS) - 1)), file.get_batch(i).column(1)], ["a", "b", "n"])

        paths = self.spark.createDataFrame([(p,) for _, p in self.shards], "path string").repartition(len(self.shards))
        return paths.mapInArrow(run, "a long, b long, n long")

    def align(self, groups: bool = False) -> DataFrame:
        """One row a document; with groups also their text, `a1,a2|b1;a3|b2,b3`."""
        files, best, listed = self.files, self.spark.sparkContext.broadcast(self.best), self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, shards = units(*files.value), Shards(listed)
            generation, sums, tops = -1, np.empty(0, np.int64), np.empty(0, np.int64)
            for chunk in text_chunks(batches, "text"):
                if known.full():
                    known.clear()
                unit, at, whole = known(chunk.column(1).to_pylist())
                if generation != known.generation:
                    generation, sums, tops = known.generation, np.empty(0, np.int64), np.empty(0, np.int64)
                if len(known.good) > len(sums):
                    begin = known.link_at[len(sums) :]
                    key, back = np.unique(known.links[begin[0] :], return_inverse=True)
                    n = shards.counts(key)
                    b = key & ((1 << BITS) - 1)
                    top = n == best.value[np.minimum(b, len(best.value) - 1)] if len(best.value) else np.zeros(len(key), bool)
                    of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[back])])[begin - begin[0]])
                    sums, tops = np.concatenate([sums, of(n)]), np.concatenate([tops, of(top.astype(np.int64))])
                total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x[unit])])[at]))
                numbers, cuts, digest, spelled = unit.tolist(), at.tolist(), [], []
                for i, ok in enumerate(whole.tolist()):
                    text = b";".join(map(known.groups.__getitem__, numbers[cuts[i] : cuts[i + 1]]))
                    digest.append(hashlib.sha256(text).hexdigest() if ok else "")
                    if groups:
                        spelled.append(text.decode())
                columns = [chunk.column(0), *map(total, (known.n_a, known.n_b, known.n_groups, known.n_links, tops, sums)), pa.array(digest, pa.string())]
                yield pa.record_batch(columns + ([pa.array(spelled, pa.string())] if groups else []), [c.split()[0] for c in ALIGNED.split(", ")] + (["groups"] if groups else []))

        return self.docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(run), ALIGNED + (", groups string" if groups else ""))


def align(docs: DataFrame, a: str = BYTE_BPE, b: str = vocabulary.MODEL, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, counted over all rows."""
    return Aligner(docs, a, b).align(groups)
