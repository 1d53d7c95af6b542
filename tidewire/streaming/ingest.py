"""Incremental ingestion: each micro-batch of articles is classified against the stored ones and appended once.

What is known of the stored articles is an index: source, identity and digest of the last version, dealt into BUCKETS buckets
by a hash of the identity. A batch reads the buckets that its articles fall into, one folder each, and writes those buckets
anew; which folder holds a bucket now is a row of the list of heads. So what a batch reads depends on its own articles and
on the size of the buckets, not on the number of batches before it.

    index/batch=<n>/bucket=<b>   a bucket as batch n left it
    heads/batch=<n>              bucket, batch: all buckets after batch n
    versions/batch=<n>           changed articles, kept for good
    actions/batch=<n>            created, updated or unchanged, for every article

A batch writes to folders of its own number and starts from the heads of an earlier one, so a batch that runs again replaces
what it wrote: effects are exactly once. Articles without identity and url are one identity of their source.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.articles import FIELDS, actions_of, digested
from tidewire.operators.common import latest_by
from tidewire.storage import materialize

BUCKETS = 64
INDEX = "source_id string, identity string, digest string, article_id string, seq long"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("source_id", "identity"), F.lit(buckets)).cast("int")


class Index:
    """The index under a folder of the shared store. The number of buckets is fixed when the folder is begun."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def heads(self, before: int | None = None) -> dict[int, int]:
        """Batch that wrote each bucket last, before a batch; at most one entry a bucket."""
        try:
            lists = self.spark.read.schema("bucket int, head long, at long").option("recursiveFileLookup", "true").parquet(f"{self.root}/heads")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        lists = lists if before is None else lists.filter(F.col("at") < before)
        last = lists.agg(F.max("at")).first()[0]
        return {} if last is None else {r["bucket"]: r["head"] for r in lists.filter(F.col("at") == last).collect()}

    def paths(self, buckets: list[int], heads: dict[int, int]) -> list[str]:
        return [f"{self.root}/index/batch={heads[b]}/bucket={b}" for b in sorted(buckets) if b in heads]

    def read(self, buckets: list[int], heads: dict[int, int]) -> DataFrame:
        paths = self.paths(buckets, heads)
        return self.spark.read.schema(INDEX).parquet(*paths) if paths else self.spark.createDataFrame([], INDEX)

    def current(self) -> DataFrame:
        """The whole index."""
        return self.read(list(range(self.buckets)), self.heads())

    def apply(self, rows: DataFrame, number: int) -> DataFrame:
        """Action of each row (source_id, seq, article_id and FIELDS) of batch number, whose effects on the index are written."""
        new = materialize(digested(rows).withColumn("bucket", _bucket(self.buckets)))
        heads = self.heads(number)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        old = self.read(touched, heads)
        done = materialize(actions_of(new.drop("bucket"), old.select("source_id", "identity", F.col("digest").alias("stored"))))
        last = latest_by(new.drop("bucket"), ["source_id", "identity"], "seq")
        after = old.join(last.select("source_id", "identity"), ["source_id", "identity"], "left_anti").unionByName(last.select(*old.columns))
        after.withColumn("bucket", _bucket(self.buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/index/batch={number}")
        now = [(b, number if b in set(touched) else heads[b], number) for b in sorted(set(touched) | set(heads))]
        self.spark.createDataFrame(now, "bucket int, head long, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/heads/batch={number}")
        return done


def ingest(stream: DataFrame, versions: str, actions: str, checkpoint: str, index: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Appends changed articles (source_id, seq, article_id and FIELDS) to versions and every action to actions; index is beside versions unless named."""

    def batch(rows: DataFrame, number: int) -> None:
        known = Index(rows.sparkSession, index or f"{versions}_index", buckets)
        done = known.apply(rows, number)
        done.write.mode("overwrite").parquet(f"{actions}/batch={number}")
        changed = done.filter("action <> 'unchanged'").select("source_id", "seq")
        rows.join(changed, ["source_id", "seq"], "left_semi").select(*rows.columns).write.mode("overwrite").parquet(f"{versions}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COLUMNS = ("source_id", "seq", "article_id", *FIELDS)
