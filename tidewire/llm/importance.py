"""Quality selection by importance resampling: two hashed n-gram models, drawn by Gumbel top-k.

Words and word pairs are hashed into BUCKETS features. The raw model counts the features of all texts; the target model
those of documents labelled good (quality 1, toxic not 1, in all of a document's labels), of which at most TARGETS are used,
those with the smallest hash of doc_id. A text's log-weight is the sum over its features of log p_target - log p_raw, both
smoothed by one; the SHARE of all documents with the largest log-weight plus Gumbel noise are selected, which draws without
replacement in proportion to the weights. The noise derives from doc_id, so reruns agree.

Texts without words have the log-weight 0. Ties go to the larger doc_id, null last; rows alike in both are selected
together. Without good labels all log-weights are 0 and the draw is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, released, text_bytes, text_chunks
from tidewire.llm.words import U64, WordKeys, mix, split

BUCKETS, TARGETS, SHARE = 1 << 14, 20_000, 0.85
_SHIFT = U64(64 - 14)


def _features(words: WordKeys, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of words and of pairs, and the offsets of each text's words. The pair at a text's last word is marked -1."""
    flat, at = split(texts)
    ids = words.lookup(flat)
    keys = words.keys[ids]
    one = (mix(keys) >> _SHIFT).astype(np.int64)
    two = np.full(len(keys), -1, np.int64)
    two[:-1] = (mix(keys[:-1] * U64(0x9E3779B97F4A7C15) + keys[1:]) >> _SHIFT).astype(np.int64)
    ends = at[1:][np.diff(at) > 0] - 1
    two[ends] = -1
    return one, two, at


def _counts(docs: DataFrame, targets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of all texts and of the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = WordKeys(), np.zeros((2, BUCKETS), np.int64)
        for chunk in text_chunks(batches, "content"):
            one, two, at = _features(words, chunk.column(1).to_pylist())
            good = np.repeat(np.array(chunk.column(0).to_pylist(), bool), np.diff(at))
            for kind, mask in ((0, None), (1, good)):
                for f in (one, two):
                    f = f if mask is None else f[mask]
                    total[kind] += np.bincount(f[f >= 0], minlength=BUCKETS)
        yield pa.record_batch([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["feature", "raw", "target"])

    marked = docs.select("doc_id", "text").join(F.broadcast(targets.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), text_bytes().alias("content"))
    rows = marked.mapInArrow(released(run), "feature long, raw long, target long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.collect():
        raw[r["feature"]], target[r["feature"]] = r["raw"], r["target"]
    return raw, target


def smallest(df: DataFrame, k: int, columns: tuple[str, ...]) -> list[int]:
    """The k-th largest row by long columns, found digit by digit from counts; k is at least 1 and at most the number of rows."""
    found: list[int] = []
    for c in columns:
        value, at = 0, df
        for shift in (48, 32, 16, 0):
            digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND(F.lit(0xFFFF))
            for r in sorted(at.groupBy(digit.alias("digit")).count().collect(), key=lambda r: -r["digit"]):
                if k <= r["count"]:
                    break
                k -= r["count"]
            value = value << 16 | r["digit"]
            at = at.filter(digit == r["digit"])
        found.append(value - (1 << 63))
        df = at
    return found


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key and selected of every row."""
    judged = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    targets = judged.filter("low = 1 and toxic <> 1").orderBy(F.xxhash64(F.lit("target"), "doc_id"), "doc_id").limit(TARGETS)
    raw, target = _counts(docs, targets)
    weight = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)) if target.any() else np.zeros(BUCKETS)
    weight = np.append(weight, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordKeys()
        for chunk in text_chunks(batches, "content"):
            one, two, at = _features(words, chunk.column(1).to_pylist())
            n = np.diff(at)
            some = np.flatnonzero(n)
            logs = np.zeros(len(n))
            if len(some):
                logs[some] = np.add.reduceat(weight[one] + weight[two], at[:-1][some])
            seeds = np.array([(x or 0) & (2**64 - 1) for x in chunk.column(0).to_pylist()], U64)
            u = ((mix(mix(seeds + U64(0x9E3779B97F4A7C15)) + U64(1)) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            key = logs - np.log(-np.log(u))
            bits = key.view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield pa.record_batch([chunk.column(0), pa.array(n + np.maximum(n - 1, 0)), pa.array(logs), pa.array(key), pa.array(order)], ["doc_id", "n_features", "log_weight", "gumbel_key", "place"])

    scored = materialize(docs.select("doc_id", text_bytes().alias("content")).mapInArrow(released(run), "doc_id long, n_features long, log_weight double, gumbel_key double, place long"))
    scored = scored.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = scored.count()
    if not n:
        return scored.select("doc_id", "n_features", "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    place, last = smallest(scored, math.ceil(share * n), ("place", "id"))
    chosen = (F.col("place") > place) | ((F.col("place") == place) & (F.col("id") >= last))
    return scored.select("doc_id", "n_features", "log_weight", "gumbel_key", chosen.alias("selected"))
