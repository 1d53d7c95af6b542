"""The bundled tables seen as articles, folders, attempts and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.golden import ARTICLES, FOLDERS

EPOCH = 1_704_067_200_000
HOUR = 3_600_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, null = read(spark, sf_dir, "documents"), F.lit(None).cast("string")
    tier = F.element_at(F.array(*(F.lit(t) for t in "SABCDE")), (F.col("doc_id") % 6 + 1).cast("int"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"), F.lit("/"))
    docs = d.select(F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("source_id"), tier.alias("source_tier"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), url.alias("url"), (F.lit(EPOCH) + F.col("doc_id") * HOUR).alias("published_at"), null.alias("summary"), F.col("text").alias("content"), F.array("lang").alias("categories"))
    return docs.unionByName(golden(spark))


def golden(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ARTICLES, "article_id string, source_id string, source_tier string, title string, url string, published_at long, summary string, category string")
    return rows.select("article_id", "source_id", "source_tier", "title", "url", "published_at", "summary", F.lit(None).cast("string").alias("content"), F.array("category").alias("categories"))


def folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(folder_id, status, last_activity) and (folder_id, article_id, attached_at): every seventh article opens a dossier, the one after it joins it."""
    d = read(spark, sf_dir, "documents").filter("doc_id % 7 in (0, 1)")
    name = F.concat(F.lit("fld_"), (F.col("doc_id") - F.col("doc_id") % 7).cast("string"))
    status = F.when(F.col("doc_id") % 21 == 0, "closed").when(F.col("doc_id") % 2 == 0, "idle").otherwise("open")
    made = d.filter("doc_id % 7 = 0").select(name.alias("folder_id"), status.alias("status"), (F.lit(EPOCH) + F.col("doc_id") * HOUR).alias("last_activity"))
    members = d.select(name.alias("folder_id"), F.col("doc_id").cast("string").alias("article_id"), (F.lit(EPOCH) + F.col("doc_id") * HOUR).alias("attached_at"))
    more = spark.createDataFrame([(f, s, EPOCH * 2) for f, s, _ in FOLDERS], "folder_id string, status string, last_activity long")
    first = spark.createDataFrame([(f, a, EPOCH * 2) for f, _, a in FOLDERS], "folder_id string, article_id string, attached_at long")
    return made.unionByName(more), members.unionByName(first)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", millis("ts").alias("at"), "user_id", "event_type", "value")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analysis attempts of the folder user_id."""
    e = events(spark, sf_dir)
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    return e.select(F.col("user_id").alias("folder_id"), F.col("event_type").alias("fingerprint"), F.col("at").alias("analyzed_at"), F.col("at").alias("created_at"), F.col("event_id").alias("attempt_id"), pick("publish", "hold", "reject_editorial", "enrich_thread_only", "hold").alias("decision"), pick("rejected", "accepted", "accepted_with_warnings").alias("validation_status"))


#: The same in DuckDB.
def _quote(x) -> str:
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


GOLDEN_SQL = ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in ARTICLES)
ARTICLES_SQL = f"""art AS (
  SELECT CAST(doc_id AS VARCHAR) AS article_id, source AS source_id, ['S','A','B','C','D','E'][1 + doc_id % 6] AS source_tier, split_part(text, chr(10), 1) AS title,
    'https://' || source || '.example.com/' || doc_id || '/' AS url, {EPOCH} + doc_id * {HOUR} AS published_at, CAST(NULL AS VARCHAR) AS summary, text AS content, [lang] AS categories FROM documents
  UNION ALL SELECT a, b, c, d, e, f, g, NULL, [h] FROM (VALUES {GOLDEN_SQL}) t(a, b, c, d, e, f, g, h))"""
FOLDERS_SQL = f"""folders AS (
  SELECT 'fld_' || doc_id AS folder_id, CASE WHEN doc_id % 21 = 0 THEN 'closed' WHEN doc_id % 2 = 0 THEN 'idle' ELSE 'open' END AS status, {EPOCH} + doc_id * {HOUR} AS last_activity FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT a, b, {EPOCH * 2} FROM (VALUES {", ".join(f"('{f}', '{s}')" for f, s, _ in FOLDERS)}) t(a, b)),
members AS (
  SELECT 'fld_' || (doc_id - doc_id % 7) AS folder_id, CAST(doc_id AS VARCHAR) AS article_id, {EPOCH} + doc_id * {HOUR} AS attached_at FROM documents WHERE doc_id % 7 IN (0, 1)
  UNION ALL SELECT a, b, {EPOCH * 2} FROM (VALUES {", ".join(f"('{f}', '{a}')" for f, _, a in FOLDERS)}) t(a, b))"""
EVENTS_SQL = "ev AS (SELECT event_id, epoch_us(ts) // 1000 AS tms, user_id, event_type, value FROM events)"
ATTEMPTS_SQL = EVENTS_SQL + """, att AS (SELECT user_id AS folder_id, event_type AS fingerprint, tms AS analyzed_at, event_id AS attempt_id,
  ['publish','hold','reject_editorial','enrich_thread_only','hold'][1 + event_id % 5] AS decision, ['rejected','accepted','accepted_with_warnings'][1 + event_id % 3] AS validation_status FROM ev)"""
