"""Operations: retention, health, backoff, interventions, catch-up, cycle summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.rules import backoff_ms


def expired_snapshots(snapshots: DataFrame, keep: int, cutoff: int | None) -> DataFrame:
    """Snapshots (snapshot_id, source_id, collected_at) beyond the newest ones of their source, or too old."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("collected_at"), F.desc("snapshot_id")))
    old = F.lit(False) if cutoff is None else F.col("collected_at") < cutoff
    return snapshots.withColumn("rank", rank.cast("long")).filter((F.col("rank") > keep) | old)


def consecutive_failures(log: DataFrame) -> DataFrame:
    """Failures of each source since its last success, its last state, and when it may be tried again. One aggregate, no sort."""
    last = log.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.struct("at", "fetch_id"))).alias("good"), F.max("at").alias("last_at"))
    after = log.filter("not ok").join(last, "source_id").filter(F.col("good").isNull() | (F.struct("at", "fetch_id") > F.col("good")))
    n = after.groupBy("source_id").agg(F.count("*").alias("failures"))
    all_ = last.join(n, "source_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    return all_.select("source_id", "failures", "last_at", (F.col("last_at") + backoff_ms(F.col("failures"))).alias("next_eligible_at"))


def source_health(sources: DataFrame, state: DataFrame, now: int) -> DataFrame:
    joined = sources.join(state, "source_id", "left")
    waits = F.coalesce(F.col("next_eligible_at") > now, F.lit(False))
    broken = F.coalesce(F.col("failures") >= 3, F.lit(False)) | F.coalesce(F.col("http_status") >= 400, F.lit(False)) | waits
    return joined.withColumns({"in_backoff": waits, "health": F.when(~F.col("enabled"), "disabled").when(broken, "broken").otherwise("live")})


def cycle_timing(runs: DataFrame, most: int = 20) -> DataFrame:
    """Over the runs that ended last: their number, the mean and the latest duration in ms (negative ones aside), and the last success. A run that is still going, or was given up, does not count."""
    ended = runs.filter("finished_at is not null").filter(F.col("status").isin("completed", "degraded", "failed"))
    top = ended.orderBy(F.desc("finished_at"), F.desc("run_id")).limit(most)
    took = F.when(F.col("finished_at") >= F.col("started_at"), F.col("finished_at") - F.col("started_at"))
    return top.agg(
        F.count("*").alias("runs"), F.round(F.avg(took)).cast("long").alias("mean_ms"), F.max_by(took, F.when(took.isNotNull(), F.struct("finished_at", "run_id"))).alias("last_ms"),
        F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("last_success_at"),
    )


def interventions(parts: list[DataFrame], most: int = 25) -> DataFrame:
    """The newest rows (kind, ref, updated_at) of several lists, each of them cut before they are put together."""
    order = [F.desc("updated_at"), F.asc("kind"), F.asc("ref")]
    out = None
    for p in parts:
        top = p.orderBy(*order).limit(most)
        out = top if out is None else out.unionByName(top)
    return out.orderBy(*order).limit(most)


def catch_up(folders: DataFrame, members: DataFrame, articles: DataFrame, published: DataFrame, sources: list[str], since: int, until: int) -> DataFrame:
    """Members of the sources in open dossiers without a main message; articles without a date pass."""
    open_ = folders.filter(F.col("status").isin("open", "idle")).join(published, "folder_id", "left_anti")
    dated = articles.filter(F.col("source_id").isin(*sources) & (F.col("published_at").isNull() | F.col("published_at").between(since, until)))
    return open_.select("folder_id").join(members, "folder_id").join(dated.select("article_id", "source_id", "published_at"), "article_id").select("folder_id", "article_id", "source_id")


def cycle_summary(events: DataFrame) -> DataFrame:
    """Counters of each cycle (cycle_id, stage, outcome), and its status by the worst outcome."""
    n = lambda stage, outcome: F.count_if((F.col("stage") == stage) & (F.col("outcome") == outcome)).alias(f"{stage}_{outcome}")
    severity = F.max(F.when(F.col("outcome") == "fatal", 2).when(F.col("outcome") == "failed", 1).otherwise(0))
    counters = [n(s, o) for s in ("collect", "match", "analyse", "publish") for o in ("ok", "failed")]
    return events.groupBy("cycle_id").agg(*counters, severity.alias("s")).withColumn("status", F.when(F.col("s") == 2, "failed").when(F.col("s") == 1, "degraded").otherwise("completed")).drop("s")


def bounded_errors(errors: DataFrame, most: int = 50) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cycle_id").orderBy("at", "error_id"))
    return errors.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)


def reduced_outcome(steps: DataFrame) -> DataFrame:
    """failed if a step failed, else succeeded if one succeeded, else skipped."""
    return steps.groupBy("batch_id").agg(F.when(F.bool_or(F.col("outcome") == "failed"), "failed").when(F.bool_or(F.col("outcome") == "succeeded"), "succeeded").otherwise("skipped").alias("outcome"))


def lease(row: DataFrame, holder: str, now: int, ttl: int) -> DataFrame:
    """The lock row after holder has tried to take it: taken if free, over or its own. One writer at a time is assumed."""
    free = F.col("holder_id").isNull() | (F.col("expires_at") <= now) | (F.col("holder_id") == holder)
    return row.select(F.when(free, holder).otherwise(F.col("holder_id")).alias("holder_id"), F.when(free, F.lit(now + ttl)).otherwise(F.col("expires_at")).alias("expires_at"), free.alias("acquired"), (free & F.col("holder_id").isNotNull() & (F.col("holder_id") != holder)).alias("stolen"))


def delete_guard(folders: DataFrame, *dependents: DataFrame) -> DataFrame:
    """Whether each folder may be deleted: nothing refers to it."""
    used = None
    for d in dependents:
        own = d.select("folder_id").distinct()
        used = own if used is None else used.union(own)
    return folders.join(used.distinct().withColumn("used", F.lit(True)), "folder_id", "left").select("folder_id", F.col("used").isNull().alias("deletable"))


def merge_state(stored: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Source states after updates that tell absent (has_<field> false: keep) from null (clear)."""
    both = stored.alias("s").join(updates.alias("u"), "source_id", "full")
    value = lambda f: F.when(F.coalesce(F.col(f"u.has_{f}"), F.lit(False)), F.col(f"u.{f}")).otherwise(F.col(f"s.{f}")).alias(f)
    return both.select("source_id", *map(value, fields))


def exhausted_folders(attempts: DataFrame, most: int = 500) -> DataFrame:
    """Number of folders with an exhausted attempt, counted up to most."""
    return attempts.filter(F.array_contains("error_codes", "analysis_exhausted")).select("folder_id").distinct().limit(most).agg(F.count("*").alias("folders"))


def listing(rows: DataFrame, order: list, most: int = 50, **equal: str) -> DataFrame:
    """The first rows by order among those equal to the filters given."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(*order).limit(most)


def run_error_codes(runs: DataFrame, most: int = 20) -> DataFrame:
    """(run_id, codes): the first error codes in a run's summary (JSON with errorCodes), texts only; a run that has none but an error message has run_error_message."""
    listed = F.element_at(F.try_parse_json("summary").try_cast("map<string, variant>"), "errorCodes").try_cast("array<variant>")
    texts = F.slice(F.filter(F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string"))), lambda x: x.isNotNull()), 1, most)
    codes = F.coalesce(texts, F.array().cast("array<string>"))
    said = F.trim(F.coalesce("error_message", F.lit(""))) != ""
    return runs.select("run_id", F.when((F.size(codes) == 0) & said, F.array(F.lit("run_error_message"))).otherwise(codes).alias("codes"))


def in_backoff(state: DataFrame, now: int) -> DataFrame:
    """Sources (source_id, next_eligible_at) that may not be fetched yet, those that wait least first."""
    return state.filter(F.col("next_eligible_at") > now).orderBy("next_eligible_at", "source_id")


def lookup(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows by key in the order of wanted (seq, key): as often as asked for, without those that are missing."""
    return wanted.join(rows, key).orderBy("seq")
