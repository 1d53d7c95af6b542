"""Queries over feeds, the registry and calls of operators, on inline rows where the tables have no counterpart."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewire.plans import tables as t
from tidewire.sources import feeds, registry
from tidewire.streaming import rate_limit

QUERIES, ORACLES = {}, {}

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Example</title>
<item><title> First </title><link>https://example.com/1</link><guid>g1</guid><description>One</description><content:encoded>Body</content:encoded><dc:creator>Ann</dc:creator><pubDate>Wed, 01 Jul 2026 12:00:00 GMT</pubDate><category>a</category><category>b</category></item>
<item><title>Second</title><guid>https://example.com/2</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title><entry><title>Entry</title><link rel="self" href="https://example.com/self"/><link rel="alternate" href="https://example.com/3"/><id>e1</id><updated>2026-07-02T00:00:00Z</updated><author><name>Bob</name></author><category term="c"/></entry></feed>"""
BODIES = [("rss", RSS), ("atom", ATOM), ("broken", "<rss><channel>"), ("html", "<html></html>")]
SOURCES = [
    {"id": "openai-news", "name": " OpenAI ", "url": "https://OpenAI.com/news/rss.xml/", "tier": "S", "enabled": True, "provider": "rss"},
    {"id": "openai-news", "name": "Again", "url": "https://other.example/rss", "tier": "A", "enabled": True, "provider": "rss"},
    {"id": "mirror", "name": "Mirror", "url": "https://openai.com:443/news/rss.xml", "tier": "A", "enabled": True, "provider": "atom"},
    {"id": "site", "name": "Site", "url": "https://site.example/", "tier": "B", "enabled": True, "provider": "html"},
    {"id": "quiet", "name": "Quiet", "url": "https://quiet.example/a", "tier": "C", "enabled": False, "provider": "api"},
    {"id": "Bad Id", "name": "x", "url": "https://x.example/", "tier": "C", "enabled": True, "provider": "rss"},
    {"id": "user", "name": "x", "url": "https://u:p@x.example/", "tier": "C", "enabled": True, "provider": "rss"},
]


def q_parse_feed(spark, d):
    items = feeds.parse(spark.createDataFrame(BODIES, "source_id string, body string"))
    return items.select("source_id", "format", "error", "item_index", "title", "link", "external_id", "author", feeds.feed_date(F.col("published")).alias("published_at"), F.array_join("categories", "|").alias("categories"))


def q_registry(spark, d):
    return registry.parse(spark.createDataFrame([(json.dumps({"sources": SOURCES}),)], "value string")).select("pos", "id", "name", "canonical", "reject")


def q_rate_limit(spark, d):
    e = t.events(spark, d)
    return rate_limit.limited(e.select((F.col("user_id") % 5).cast("string").alias("actor"), F.col("event_type").alias("operation"), "at", F.col("event_id").alias("call_id")))


QUERIES = {"q_parse_feed": q_parse_feed, "q_registry": q_registry, "q_rate_limit": q_rate_limit}
ORACLES = {
    "q_parse_feed": """SELECT * FROM (VALUES ('rss', 'rss', NULL, 0::BIGINT, 'First', 'https://example.com/1', 'g1', 'Ann', 1782907200000::BIGINT, 'a|b'), ('rss', 'rss', NULL, 1, 'Second', 'https://example.com/2', 'https://example.com/2', NULL, NULL, ''),
  ('atom', 'atom', NULL, 0, 'Entry', 'https://example.com/3', 'e1', 'Bob', 1782950400000, 'c'), ('broken', NULL, 'InvalidXml', NULL, NULL, NULL, NULL, NULL, NULL, NULL), ('html', NULL, 'UnknownFormat', NULL, NULL, NULL, NULL, NULL, NULL, NULL))
  x(source_id, format, error, item_index, title, link, external_id, author, published_at, categories)""",
    "q_registry": """SELECT * FROM (VALUES (0::BIGINT, 'openai-news', 'OpenAI', 'https://openai.com/news/rss.xml', NULL), (1, 'openai-news', 'Again', 'https://other.example/rss', 'duplicate_id'), (2, 'mirror', 'Mirror', 'https://openai.com/news/rss.xml', 'duplicate_url'),
  (3, 'site', 'Site', 'https://site.example/', 'provider_disabled'), (4, 'quiet', 'Quiet', 'https://quiet.example/a', NULL), (5, 'Bad Id', 'x', 'https://x.example/', 'invalid_id'), (6, 'user', 'x', NULL, 'invalid_url')) x(pos, id, name, canonical, reject)""",
    # An accepted call depends on the one accepted before: a walk from accepted call to accepted call.
    "q_rate_limit": """WITH RECURSIVE c AS (SELECT CAST(user_id % 5 AS VARCHAR) AS actor, event_type AS operation, epoch_us(ts) // 1000 AS t, event_id AS call_id FROM events),
k AS (SELECT actor, operation, min(t) AS t FROM c GROUP BY ALL),
w AS (SELECT actor, operation, t FROM k UNION ALL SELECT w.actor, w.operation, (SELECT min(c.t) FROM c WHERE c.actor = w.actor AND c.operation = w.operation AND c.t >= w.t + 5000) AS t FROM w WHERE w.t IS NOT NULL)
SELECT c.actor, c.operation, c.t AS "at", c.call_id, w.t IS NOT NULL AND row_number() OVER (PARTITION BY c.actor, c.operation, c.t ORDER BY c.call_id) = 1 AS accepted FROM c LEFT JOIN (SELECT DISTINCT actor, operation, t FROM w WHERE t IS NOT NULL) w ON c.actor = w.actor AND c.operation = w.operation AND c.t = w.t""",
}
