"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

1. On a sample of at most SAMPLE usable vectors (those with the smallest hash of vec_id), principal axes and a rotation
   are learned so that signs of the rotated vectors lose as little as possible; each bit's threshold lies where the
   sample is sparsest between its 30th and 70th percentile, so bits are balanced and groups of copies are not cut, however
   many vectors belong to one. All vectors are then indexed by the 64 bits of their code.
2. The code's 8 bytes index tables, one for each choice of WIDTH bytes, the same for every number of vectors: a pair is
   compared if it agrees in WIDTH bytes, so what is found does not follow from how many other rows there are. It counts
   only in the first table where it meets. Of pairs at a cosine of just 0.98, at least 0.998 meet at a width of 1
   (tests/llm measures it), whose buckets hold about a 256th of a label each; the comparisons of a label grow with its
   square over 32. A caller with labels of many millions may take a larger width for all (least share found: 0.95 at 3).
3. Within a bucket, pairs are reranked by the cosine of the original vectors in double precision. A bucket of over BLOCK
   vectors is dealt out to a task for each two blocks of it. Buckets send on sums and ties, never pairs.
4. Equal vectors are one class throughout; components come from the ties.

Only vectors of the same label and length are compared. A null label, and a vector that is null, empty, zero or holds null
or non-finite components, links with nothing. Rows with one vec_id are separate vectors for n_links and one node of the
graph; a null vec_id has n_links, but a null component, and is not kept. An empty table gives an empty one; further columns
are ignored. Lengths with fewer than 2 * BITS vectors in the sample, or shorter than BITS, are indexed by a random rotation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, released, small
from tidewire.llm.components import components

BITS, SAMPLE, ROUNDS, BLOCK, BUCKET, SEED = 64, 20_000, 40, 2048, 64, 7
WIDTH = 1


def _rotation(n: int, m: int) -> np.ndarray:
    """Random n x m matrix with orthonormal columns, or rows if n < m."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((max(n, m), max(n, m))))
    return (q * np.sign(np.diag(r)))[:n, :m]


def _thresholds(z: np.ndarray) -> np.ndarray:
    """For each column, a value near the middle that few rows are close to."""
    grid = np.quantile(z, np.linspace(0.3, 0.7, 81), axis=0)
    out = np.empty(z.shape[1])
    for c in range(z.shape[1]):
        column, width = np.sort(z[:, c]), 0.15 * z[:, c].std()
        near = np.searchsorted(column, grid[:, c] + width) - np.searchsorted(column, grid[:, c] - width)
        out[c] = grid[np.lexsort((np.abs(np.arange(81) - 40), near))[0], c]
    return out


def fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(projection, thresholds) of the code of unit vectors x: bit i is whether column i of x @ projection is over its threshold."""
    dim = x.shape[1]
    if len(x) < 2 * BITS or dim < BITS:
        w = _rotation(dim, BITS)
        return w, _thresholds(x @ w) if len(x) else np.zeros(BITS)
    centre = x.mean(0)
    _, _, axes = np.linalg.svd(x - centre, full_matrices=False)
    axes = axes[:BITS].T
    v = (x - centre) @ axes
    r = _rotation(BITS, BITS)
    for _ in range(ROUNDS):
        u, _, wt = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    w = axes @ r
    return w, _thresholds(x @ w)


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """8 bytes for each vector."""
    return np.packbits(x @ model[0] > model[1], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # powers of two bring the largest part near 1, so that no square is too large or too small
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0.0))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


MOST = 3


def tables(r: int) -> list[tuple[int, ...]]:
    """Choices of r code bytes."""
    return list(combinations(range(BITS // 8), r))


def _width(vectors: Column) -> Column:
    """The number of code bytes for which a bucket holds about BUCKET of so many vectors: advice for callers that pass a width, never taken by itself."""
    return reduce(lambda x, r: x + F.when(vectors > BUCKET * 256**r, 1).otherwise(0), range(MOST), F.lit(0))


def near_duplicates(rows: DataFrame, least: float = 0.98, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label); pairs that agree in width code bytes are compared."""
    spark = rows.sparkSession
    fine = F.size("embedding") > 0
    fine &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    tagged = rows.select("vec_id", "label", "embedding", F.when(F.col("label").isNotNull(), F.coalesce(fine, F.lit(False))).otherwise(False).alias("usable"))
    usable = tagged.filter("usable")
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.xxhash64("label", "embedding").alias("hash"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()))
    sample = classes.select("dim", "embedding", "hash").orderBy("hash").limit(SAMPLE).toArrow().combine_chunks()
    models = {}
    for dim in pc.unique(sample["dim"]).to_pylist():
        own = sample.filter(pc.equal(sample["dim"], dim))["embedding"].combine_chunks()
        if dim < BITS or len(own) >= 2 * BITS:
            models[dim] = fit(_matrix(own))
    shared = spark.sparkContext.broadcast(models)
    chosen = tables(width)
    grouped = classes.select("row", F.xxhash64("label", "dim").alias("group"), "dim", "embedding")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                code = codes(_matrix(part.column(3)), models.get(dim) or (_rotation(dim, BITS), np.zeros(BITS)))
                keys = np.stack([np.pad(code[:, c], ((0, 0), (8 - len(c) - 1, 1))).copy().view(">i8")[:, 0] + t for t, c in enumerate(chosen)], 1).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(chosen), dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.record_batch([*part.columns[:2], pa.array([c.tobytes() for c in code], pa.binary()), lists], ["row", "group", "code", "keys"])

    coded = materialize(grouped.mapInArrow(released(index), "row long, group long, code binary, keys array<long>"))
    placed = coded.select("row", "code", "group", F.explode("keys").alias("key"))
    full = materialize(placed.groupBy("group", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    hint = small(full)
    dealt = placed.join(hint(full.select("group", "key", "blocks")), ["group", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("row", "code", "group", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("block").alias("block"))
    asked = dealt.join(classes.select("row", "vec_id", "copies", "embedding"), "row")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            names = np.stack([table.column(k).to_numpy() for k in range(4)], 1)
            starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(1)]))
            held = table.slice(int(starts[-1]))
            yield from _reranked(table.slice(0, int(starts[-1])), starts, least, chosen)
        if held is not None:
            yield from _reranked(held, np.zeros(1, np.int64), least, chosen)

    order = ["group", "key", "low", "high"]
    sent = asked.select(*order, "block", "row", "vec_id", "copies", "code", "embedding").repartition(*order).sortWithinPartitions(*order)
    met = materialize(sent.mapInArrow(released(rerank), "row long, links long, vec long, root long"))
    links = met.groupBy("row").agg(F.sum("links").alias("links"))
    members = usable.join(classes.select("label", "embedding", "row", F.col("vec_id").alias("first"), "copies").join(links, "row", "left"), ["label", "embedding"])
    members = materialize(members.select("vec_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ends = components(met.select(F.col("vec").alias("a"), F.col("root").alias("b")).union(members.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))))
    everything = members.select("vec_id", "n_links").union(tagged.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    done = everything.join(ends, F.col("vec_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return done.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _reranked(table: pa.Table, starts: np.ndarray, least: float, chosen: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """Links of each vector within the buckets of a sorted table, weighed by copies, and the smallest vec_id it is tied to there."""
    if not table.num_rows:
        return
    key, low, high, block, row, vec, copies = (table.column(k).to_numpy(zero_copy_only=False) for k in range(1, 8))
    code = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, BITS // 8)
    vectors = table.column(9).combine_chunks()
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
        if b - a < 2 or a >= table.num_rows:
            continue
        choice = chosen[int(key[a]) & 0xFF]
        x = _matrix(vectors.slice(a, b - a))
        near = x @ x.T >= least
        i, j = np.nonzero(np.triu(near, 1))
        if low[a] != high[a]:
            cross = block[a + i] != block[a + j]
            i, j = i[cross], j[cross]
        to = choice[-1] + 1 if choice else 0
        first = (code[a + i, :to] == code[a + j, :to]).sum(1) == len(choice)
        i, j = i[first], j[first]
        if not len(i):
            continue
        links = np.bincount(i, copies[a + j], b - a) + np.bincount(j, copies[a + i], b - a)
        root = np.arange(b - a)
        by = np.argsort(vec[a:b], kind="stable")
        rank = np.empty(b - a, np.int64)
        rank[by] = np.arange(b - a)
        u, v = np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j])
        while True:
            before = root.copy()
            np.minimum.at(root, v, root[u])
            np.minimum.at(root, u, root[v])
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links)
        out.append((row[a + some], links[some].astype(np.int64), vec[a + some], vec[a + by[root[rank[some]]]]))
    if out:
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "links", "vec", "root"])
