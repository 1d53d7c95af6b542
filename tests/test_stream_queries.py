from pathlib import Path

from pyspark.sql import functions as F

from tidewire.plans.stream_queries import BATCHES, streamed


def test_batches_keep_the_files_of_their_tasks(spark):
    """No batch goes through one task: each of the eight parts of the table writes a file of its own, and a batch takes all of its files at once."""
    seen = []

    def run(stream, to):
        def batch(rows, number):
            seen.append((number, *rows.agg(F.count("*"), F.min("id"), F.max("id")).first()))

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()

    root = streamed(spark.range(9000, numPartitions=8).withColumn("id", F.col("id") * 7 % 9000), "id", run)
    assert [n for n, *_ in seen] == list(range(BATCHES)) and sum(n for _, n, *_ in seen) == len({i * 7 % 9000 for i in range(9000)})
    assert all(a[3] < b[2] for a, b in zip(seen, seen[1:]))
    assert len(list(Path(root.removeprefix("file:"), "in").glob("*.parquet"))) == 8 * BATCHES
