"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is taken r times on average, r being the source's target over its size: floor(r) whole copies
for certain, and one more with inclusion probability r - floor(r). Which documents get the extra copy is drawn by the cube
method, balanced on two totals, words and documents: the flight phase moves the probabilities at random through the null
space of the balancing constraints, so both totals keep their expected value, until no such move is left.

The flight is spread over tasks: a source's documents are dealt by hash into blocks of BLOCK; each block flies until at most
two documents and every SPAREth one are undecided; the undecided of all blocks fly again together, in blocks, until each source has one block.
The landing problem of at most two documents per source is drawn by their probabilities. What the draw has put the words
off by is then made good by at most EXCHANGES exchanges, in the last block, of a document taken for one not taken.

All random numbers derive from doc_id, source and size, so reruns agree. Documents without words are taken 0 times. Null
texts have no words; null is a source of its own, last in order; repeated rows are separate documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, materialize, small

WEIGHTS, LIMIT, BLOCK, SPARE, EXCHANGES = (5, 2, 1), 3, 256, 32, 4


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(measured: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target. Sources share the total by weight; none gets over limit times its size.

    The excess goes to the others by weight until none is above: the end of that is the level at which the sources' limits
    and weighted shares together make up the total. Sources are ordered by limit over weight; the level is where the
    limits up to there and the shares from there on add up.
    """
    total = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * float(limit))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    summed = (
        named.withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    )
    here = (F.col("all") - F.col("before")) / F.col("left")
    ratio = F.col("most") / F.col("weight")
    level = F.min_by(here, F.when(here <= ratio, F.struct(ratio, F.col("rank")))).over(everything)
    return summed.withColumn("level", level).select("source", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def fly(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Flight phase: p, inclusion probabilities; x, a row of balancing values for each unit; u, a random number for each move, of which there are no more than units.

    Always holds one unit more than there are constraints, so a move that keeps all totals exists; each move decides a unit.
    """
    p = p.copy()
    m = x.shape[1]
    eps = 1e-9
    pending = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    held, used, moves = pending[: m + 1], m + 1, 0
    while len(held) == m + 1:
        v = _null(x[held])
        up, down = np.inf, np.inf
        for i, vi in zip(held, v):
            if vi > eps:
                up, down = min(up, (1 - p[i]) / vi), min(down, p[i] / vi)
            elif vi < -eps:
                up, down = min(up, p[i] / -vi), min(down, (1 - p[i]) / -vi)
        step = up if u[moves] * (up + down) < down else -down
        moves += 1
        rest = []
        for i, vi in zip(held, v):
            p[i] += step * vi
            if p[i] <= eps:
                p[i] = 0.0
            elif p[i] >= 1 - eps:
                p[i] = 1.0
            else:
                rest.append(i)
        new = m + 1 - len(rest)
        held = rest + pending[used : used + new]
        used += new
    return p


def _null(a: np.ndarray) -> list[float]:
    """A vector with which the rows of a (three of two values) add up to zero, largest part 1."""
    (a0, b0), (a1, b1), (a2, b2) = a.tolist()
    v = [a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0]
    top = max(map(abs, v))
    if top == 0:  # equal values: two of them can trade
        return [1.0, -1.0, 0.0]
    return [c / top for c in v]


def land(p: np.ndarray, u: float) -> np.ndarray:
    """Decides what the flight has left, each unit by its probability, one after the other on one random number, so that their number is as expected."""
    p = p.copy()
    some = np.flatnonzero((p > 0) & (p < 1))
    if len(some):
        edge = u + np.concatenate([[0.0], np.cumsum(p[some])])
        p[some] = np.diff(np.floor(edge + 1e-12))
    return p


def settle(before: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Exchanges a unit taken for one not taken where that brings the words nearer to their expected total."""
    p = p.copy()
    for _ in range(EXCHANGES):
        off = float(((p - before) * size).sum())
        taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(taken) or not len(left):
            break
        after = np.abs(off + size[left][None, :] - size[taken][:, None])
        best = int(after.argmin())
        if after.flat[best] >= abs(off) - 0.5:
            break
        p[taken[best // len(left)]], p[left[best % len(left)]] = 0.0, 1.0
    return p


FLOWN = "doc_id long, source string, size long, p double, h long"


def _flight(final: bool, turn: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        u = np.random.default_rng(rows["h"].to_numpy()[:8].astype(np.uint64)).random(len(rows))
        size = rows["size"].to_numpy(np.float64)
        before = rows["p"].to_numpy()
        p, going = before.copy(), np.ones(len(rows), bool) if final else (rows["h"].to_numpy() >> 5 * turn) % SPARE != 0
        if going.any():
            p[going] = fly(before[going], np.stack([size / size.max(), np.ones(len(size))], 1)[going], u)
        rows["p"] = settle(before, land(p, float(u[-1])), size) if final else p
        return rows[["doc_id", "source", "size", "p", "h"]]

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    measured = materialize(sizes(docs))
    wanted = materialize(targets(measured, weights, limit))
    few = small(wanted)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(F.lit(0.0))
    goal = F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), rate.alias("rate")
    shares = wanted.select(*goal)
    dealt = measured.withColumns({"key": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()}).join(few(shares), ["key", "none"])
    units = dealt.filter("size > 0").select("doc_id", "source", "size", (F.col("rate") - F.floor("rate")).alias("p"), F.xxhash64(F.lit("cube"), "doc_id", "source", "size").alias("h"))
    decided, open_, turn = None, units, 0
    while True:
        most = open_.groupBy("source").agg(F.count("*").alias("n"))
        blocks = most.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        final = (blocks.agg(F.max("blocks")).first()[0] or 0) <= 1
        keyed = open_.withColumns({"key": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()}).join(few(blocks), ["key", "none"])
        flown = materialize(keyed.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "h"), F.col("blocks"))).groupBy("key", "none", "block").applyInPandas(_flight(final, turn), FLOWN))
        done = flown.filter("p = 0 or p = 1")
        decided = done if decided is None else decided.unionByName(done)
        if final:
            break
        open_, turn = flown.filter("p > 0 and p < 1"), turn + 1
    all_units = decided.select("doc_id", "source", "size", F.col("p").cast("long").alias("extra")).unionByName(measured.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("extra")))
    back = wanted.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), "source_size", "target", rate.alias("rate"))
    mixed = all_units.withColumns({"key": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()}).join(few(back), ["key", "none"])
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it. Rows that share a doc_id share their copies evenly, rounded up."""
    taken = mix(docs, weights, limit).groupBy(F.col("doc_id").alias("taken_id")).agg(F.ceil(F.sum("copies") / F.count("*")).cast("int").alias("taken_copies")).filter("taken_copies > 0")
    taken = materialize(taken)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = named.join(small(taken, 1_000_000)(taken), F.col("row.doc_id").eqNullSafe(F.col("taken_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("taken_copies")))).select("row.*")
