"""Keyed state of the backoff stream, and ingestion over a bucketed index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions.rules import BACKOFF_MS
from tidewire.operators import ops
from tidewire.operators.articles import FIELDS
from tidewire.streaming import backoff, ingest

LOG = "source_id string, `at` long, fetch_id long, ok boolean"
BATCHES = [
    [("a", 1, 1, False), ("a", 2, 2, False), ("b", 1, 3, True)],
    [("a", 3, 4, False), ("b", 4, 5, False), ("b", 5, 6, None), ("c", 1, 7, False)],
    [("a", 9, 8, True), ("a", 10, 9, False), ("d", None, 10, False)],
]


def states(spark, at):
    told = spark.read.parquet(f"{at}/told").filter("told = 'state'")
    last = told.groupBy("source_id").agg(F.max_by(F.struct("failures", "last_at", "next_eligible_at"), "batch").alias("s"))
    return {r["source_id"]: tuple(r["s"]) for r in last.collect()}


def test_failures_after_fetches():
    assert backoff.after(2, np.array([False, False])) == 4 and backoff.after(2, np.array([False, True])) == 0 and backoff.after(9, np.array([True, False, False])) == 2


def test_backoff_state_equals_the_log_after_each_batch(spark, tmp_path):
    """One restart of the stream a batch: the state goes on where it was."""
    seen = []
    for rows in BATCHES:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")
        backoff.write(stream, f"{tmp_path}/told", f"{tmp_path}/checkpoint").awaitTermination()
        seen += rows
        log = spark.createDataFrame(seen, LOG).filter("`at` is not null").withColumn("ok", F.coalesce("ok", F.lit(False)))
        want = {r["source_id"]: (r["failures"], r["last_at"], r["next_eligible_at"]) for r in ops.consecutive_failures(log).collect()}
        assert states(spark, tmp_path) == want
    # The waits are long over: each timer has told so in the batch after it was set, unless a new fetch took it back.
    over = spark.read.parquet(f"{tmp_path}/told").filter("told = 'eligible'").collect()
    assert {(r["source_id"], r["next_eligible_at"]) for r in over} >= {("b", 5 + BACKOFF_MS[1]), ("c", 1 + BACKOFF_MS[0])}
    assert all(r["next_eligible_at"] in {s + b for s in range(12) for b in BACKOFF_MS} for r in over)


def test_backoff_begins_with_a_state(spark, tmp_path):
    spark.createDataFrame([("a", 10, 9, False)], LOG).coalesce(1).write.parquet(f"{tmp_path}/in")
    begin = spark.createDataFrame([("a", 4, 5, 8), ("z", 1, 5, 7)], "source_id string, failures long, last_at long, fetch_id long")
    backoff.write(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), f"{tmp_path}/told", f"{tmp_path}/checkpoint", begin).awaitTermination()
    assert states(spark, tmp_path)["a"] == (5, 10, 10 + BACKOFF_MS[4])


SCHEMA = "source_id string, source_tier string, title string, url string, published_at long, author string, summary string, content string, categories array<string>, feed_format string, external_id string, seq long, article_id string"


def article(seq, source, external, title):
    return (source, "S", title, f"https://q.example/{external}", 1, None, None, "c", ["x"], "rss", external, seq, f"a{seq}")


def test_index_by_buckets(spark, tmp_path):
    """Many batches: actions as if applied in turn, a repeated batch changes nothing, and a batch opens one folder a touched bucket."""
    index = ingest.Index(spark, str(tmp_path), buckets=4)
    known, seq, opened = {}, 0, []
    for number in range(5):
        rows = []
        for i in range(6):
            rows.append(article(seq, "s", None if i == 5 else f"e{(number + i) % 7}", f"t{(number * i) % 3}"))
            seq += 1
        df = spark.createDataFrame(rows, SCHEMA)
        want = {}
        for r in rows:
            key = r[10] or r[3]
            want[r[11]] = "created" if key not in known else "unchanged" if known[key] == r[2] else "updated"
            known[key] = r[2]
        heads = index.heads(number)
        opened.append(len(index.paths(list(range(4)), heads)))
        for _ in range(2 if number == 2 else 1):
            got = {r["seq"]: r["action"] for r in index.apply(df, number).collect()}
            assert got == want, number
    assert opened[0] == 0 and max(opened) <= 4
    assert index.current().count() == len(known) and index.current().select("source_id", "identity").distinct().count() == len(known)


def test_an_empty_batch_keeps_the_heads(spark, tmp_path):
    index = ingest.Index(spark, str(tmp_path), buckets=4)
    rows = spark.createDataFrame([article(1, "s", "e", "t")], SCHEMA)
    index.apply(rows, 0)
    assert index.apply(rows.limit(0), 1).count() == 0 and index.heads() == index.heads(1) != {}
    assert [r["action"] for r in index.apply(rows, 2).collect()] == ["unchanged"]


@pytest.mark.parametrize("missing", ["heads"])
def test_a_batch_without_heads_has_no_effect(spark, tmp_path, missing):
    """A batch that was killed before its list of heads is not seen by the next one."""
    index = ingest.Index(spark, str(tmp_path), buckets=4)
    index.apply(spark.createDataFrame([article(1, "s", "e", "t")], SCHEMA), 0)
    (tmp_path / missing / "batch=0").rename(tmp_path / "aside")
    assert [r["action"] for r in index.apply(spark.createDataFrame([article(1, "s", "e", "t")], SCHEMA), 1).collect()] == ["created"]
    assert set(FIELDS) <= set(ingest.COLUMNS)
