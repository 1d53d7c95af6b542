"""Further queries: proposals, enrichments, addresses, guards and listings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewire.operators import analysis, ops, publication
from tidewire.plans import tables as t
from tidewire.plans.ops_queries import NOW, _NAMES, _prepared
from tidewire.sources import registry

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def proposal(**more) -> dict:
    base = {
        "schemaVersion": "1", "summary": "A model was released to everyone, with weights and a paper.", "classification": {"primaryCategory": "model_release", "secondaryCategories": ["research"], "announcementNature": "launch"},
        "scoring": {"relevance": 80, "impact": 70, "novelty": 60, "confidence": 0.75}, "entities": ["OpenAI"], "proposedFacts": [{"key": "version", "value": "5", "support": "explicit"}],
        "editorialProposal": {"publishWorthiness": "high", "suggestedChannelRole": "none"}, "rationale": "Because.",
    }
    return base | more


_c = proposal()["classification"]
PROPOSALS = [
    ("accepted", json.dumps(proposal())), ("invalid_json", "{"), ("invalid_json", "```json\n{}\n```"), ("schema_violation", "{}"), ("schema_violation", "[]"), ("schema_violation", json.dumps(proposal(extra=1))), ("empty_summary", json.dumps(proposal(summary="  short  "))),
    ("schema_violation", json.dumps(proposal(summary="x" * 501))), ("schema_violation", json.dumps(proposal(summary="short", extra=1))), ("schema_violation", json.dumps(proposal(rationale="x" * 281))), ("schema_violation", json.dumps(proposal(scoring={"relevance": 101, "impact": 1, "novelty": 1, "confidence": 0.5}))),
    ("schema_violation", json.dumps(proposal(scoring={"relevance": 10, "impact": 1, "novelty": 1, "confidence": 0.555}))), ("schema_violation", json.dumps(proposal(classification=_c | {"secondaryCategories": ["model_release"]}))), ("schema_violation", json.dumps(proposal(classification=_c | {"secondaryCategories": ["research", "research"]}))),
    ("schema_violation", json.dumps(proposal(classification=_c | {"primaryCategory": "news"}))), ("schema_violation", json.dumps(proposal(entities=["x"] * 13))), ("schema_violation", json.dumps(proposal(proposedFacts=[{"key": "k", "value": "v", "support": "maybe"}]))), ("accepted", json.dumps(proposal(entities=[], proposedFacts=[]))),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{v}')" for i, (v, _) in enumerate(PROPOSALS)) + ") x(id, verdict)")
def q_proposal_validate(spark, d):
    rows = spark.createDataFrame([(i, raw) for i, (_, raw) in enumerate(PROPOSALS)], "id long, raw string")
    return rows.select("id", analysis.proposal_verdict(F.col("raw")).alias("verdict"))


@query(f"""WITH {_NAMES}, q AS (SELECT folder_id, string_agg(CASE WHEN url IS NULL THEN name ELSE name || ' — ' || url END, chr(10) ORDER BY place) FILTER (place <= 5) AS s FROM p GROUP BY 1),
f AS (SELECT l_orderkey AS folder_id, string_agg('• ' || l_returnflag || ': ' || l_linestatus, chr(10) ORDER BY l_returnflag, l_linestatus) AS lines FROM lineitem GROUP BY 1)
SELECT coalesce(f.folder_id, q.folder_id) AS folder_id, coalesce(lines, 'Nouvelles sources.') AS description, CASE WHEN length(s) > 1024 THEN left(s, 1023) || '…' ELSE s END AS sources FROM f FULL JOIN q ON f.folder_id = q.folder_id""")
def q_enrichment_payload(spark, d):
    facts = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("folder_id"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"))
    return publication.enrichment_message(facts, _prepared(spark, d))


#: The name under which the query was first run over the facts of every order.
QUERIES["q_enrichment_payload_all"], ORACLES["q_enrichment_payload_all"] = QUERIES["q_enrichment_payload"], ORACLES["q_enrichment_payload"]


@query("""WITH x AS (SELECT event_id, event_id % 256 AS a, (event_id * 7) % 256 AS b, (event_id * 13) % 256 AS c, event_id % 300 AS e FROM events)
SELECT event_id, e > 255 OR a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) AS blocked FROM x""")
def q_blocked_addresses(spark, d):
    part = lambda c: c.cast("string")
    e = F.col("event_id")
    ip = F.concat_ws(".", part(e % 256), part(e * 7 % 256), part(e * 13 % 256), part(e % 300))
    return t.events(spark, d).select("event_id", registry.blocked_address(ip).alias("blocked"))


@query("SELECT o_orderkey AS folder_id, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3 UNION SELECT user_id FROM events) AS deletable FROM orders")
def q_delete_guard(spark, d):
    folders = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("folder_id"))
    return ops.delete_guard(folders, t.read(spark, d, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("folder_id")), t.events(spark, d).select(F.col("user_id").alias("folder_id")))


@query("""SELECT c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'new' END ELSE c_mktsegment END AS etag FROM customer""")
def q_merge_state(spark, d):
    c = t.read(spark, d, "customer")
    updates = c.filter("c_custkey % 5 <> 0 or c_custkey % 3 = 0").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 3 == 0).alias("has_etag"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("etag"))
    return ops.merge_state(c.select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("etag")), updates, ["etag"])


@query("SELECT least(count(DISTINCT user_id), 100) AS folders FROM events WHERE event_type = 'error'")
def q_exhausted_folders(spark, d):
    e = t.events(spark, d).select(F.col("user_id").alias("folder_id"), F.when(F.col("event_type") == "error", F.array(F.lit("timeout"), F.lit("analysis_exhausted"))).otherwise(F.array(F.lit("timeout"))).alias("error_codes"))
    return ops.exhausted_folders(e, 100)


@query(f"SELECT event_type AS decision, count(*) AS decisions, count(*) FILTER (epoch_us(ts) // 1000 >= {NOW} - 7 * 86400000 AND epoch_us(ts) // 1000 <= {NOW}) AS last_week FROM events GROUP BY 1")
def q_decision_counts(spark, d):
    recent = F.col("at").between(NOW - 7 * 86_400_000, NOW)
    return t.events(spark, d).groupBy(F.col("event_type").alias("decision")).agg(F.count("*").alias("decisions"), F.count_if(recent).alias("last_week"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def q_audit_list(spark, d):
    return ops.listing(t.events(spark, d), [F.desc("at"), F.desc("event_id")], event_type="purchase").select("event_id", "user_id")
