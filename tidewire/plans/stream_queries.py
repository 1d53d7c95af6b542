"""Streams over the bundled tables, run to their end, and the SQL of what they leave."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.articles import FIELDS
from tidewire.operators.common import latest_by
from tidewire.plans import tables as t
from tidewire.plans.ops_queries import _ED, _FAIL, _versions
from tidewire.storage import shared_dir
from tidewire.streaming import backoff, ingest

QUERIES, ORACLES = {}, {}
#: Batches that a table is put into.
BATCHES = 3


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def streamed(rows: DataFrame, by: str, run: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """The folder of what becomes of the rows in BATCHES batches of about equal size by a column.

    run starts a query over a stream, with its output and checkpoint under a folder, that ends with its data. Each batch is put
    there once the one before is done, in as many files as its tasks make, and is taken up where that one left off.
    """
    spark, root = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/tidewire/{uuid.uuid4().hex}"
    inner = F.array(*(F.lit(i / BATCHES) for i in range(1, BATCHES)))
    cuts = [None, *(rows.agg(F.percentile_approx(by, inner, F.lit(10_000))).first()[0] or []), None]
    for low, high in zip(cuts, cuts[1:]):
        part = rows if low is None else rows.filter(F.col(by) > low)
        (part if high is None else part.filter(F.col(by) <= high)).write.mode("append").parquet(f"{root}/in")
        # a limit of files would make several batches of one
        run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2**31 - 1).parquet(f"{root}/in"), root).awaitTermination()
    return root


@query(f"WITH {_FAIL} SELECT CAST(source_id AS VARCHAR) AS source_id, failures, last_at, next_eligible_at FROM su")
def q_backoff_stream(spark, d):
    log = t.events(spark, d).select(F.col("user_id").alias("source_id"), "at", F.col("event_id").alias("fetch_id"), (F.col("event_type") != "error").alias("ok"))
    root = streamed(log, "at", lambda stream, to: backoff.write(stream, f"{to}/told", f"{to}/checkpoint"))
    told = spark.read.schema(f"{backoff.OUT}, batch long").option("basePath", f"{root}/told").parquet(f"{root}/told").filter("told = 'state'")
    return latest_by(told, ["source_id"], "batch").select("source_id", "failures", "last_at", "next_eligible_at")


@query(f"WITH {_ED}, act AS (SELECT seq, digest, lag(digest) OVER (PARTITION BY source_id, ext ORDER BY seq) AS before FROM ver) SELECT seq, CASE WHEN before IS NULL THEN 'created' WHEN before = digest THEN 'unchanged' ELSE 'updated' END AS action FROM act")
def q_ingest_stream(spark, d):
    rows = _versions(spark, d).select("source_id", "seq", "article_id", *FIELDS)
    root = streamed(rows, "seq", lambda stream, to: ingest.ingest(stream, f"{to}/versions", f"{to}/actions", f"{to}/checkpoint"))
    return spark.read.parquet(f"{root}/actions").select("seq", "action")
