"""Cycles as one job: what two of them make of a few articles, and that a killed or repeated one has no second effect."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.streaming import cycle

SCHEMA = "article_id string, source_id string, source_tier string, title string, url string, published_at long, summary string, content string, categories array<string>"
HOUR = 3_600_000


def article(i, title, source="press", tier="E", at=0, content=None):
    return (i, source, tier, title, f"https://{source}.example/{i}", at * HOUR, None, content, [])


FIRST = [
    article("a1", "Cohere buys Databricks 2.5", content="Cohere buys Databricks in a merger."),
    article("a2", "Introducing Claude Opus 5", "anthropic-news", "S", content="Announcing Claude Opus 5, generally available."),
    article("a3", "why"),
    article("a4", "Mistral launches Mixtral 8.1", content="Mistral launches Mixtral 8.1 today."),
    article("a5", "Perplexity launches Comet 3.3", content="Perplexity launches Comet 3.3 today."),
]
SECOND = [
    *FIRST,
    article("b1", "Mistral launches Mixtral 8.1", at=1, content="Mistral launches Mixtral 8.1 today. It is priced at $15."),
    article("b2", "Mistral launches Mixtral 8.1", at=2, content="Mistral launches Mixtral 8.1 today."),
    article("b3", "Cohere buys Databricks 2.5", at=2, content="Cohere buys Databricks, confirmed for customers."),
]


def answer(relevance=90, impact=90, worth="high", **more):
    whole = {"schemaVersion": "1", "summary": "A summary that is long enough to be accepted as one.", "classification": {"primaryCategory": "model_release", "secondaryCategories": [], "announcementNature": "launch"}, "scoring": {"relevance": relevance, "impact": impact, "novelty": 80, "confidence": 0.9}, "entities": [], "proposedFacts": [{"key": "product", "value": "Mixtral", "support": "explicit"}, {"key": "x", "value": "not in there", "support": "explicit"}], "editorialProposal": {"publishWorthiness": worth, "suggestedChannelRole": "veille_pertinente"}, "rationale": "because"}
    return json.dumps(whole | more)


def infer(requests):
    raw = F.when(F.col("title").contains("Mixtral"), F.lit(answer())).when(F.col("title").contains("Cohere"), F.lit(answer(10, 10, "none"))).when(F.col("title").contains("Comet"), F.lit("{"))
    return requests.select("folder_id", raw.alias("raw"), F.lit(None).cast("string").alias("error"))


def tables(state):
    return {name: sorted(map(str, state.read(name).collect())) for name in cycle.TABLES}


@pytest.fixture(scope="module")
def after(spark, tmp_path_factory):
    """The state after each of two cycles, the second killed in the middle once, then run, then run again."""
    state = cycle.State(spark, str(tmp_path_factory.mktemp("state")))
    assert cycle.run(state, spark.createDataFrame(FIRST, SCHEMA), 1, 100, infer)
    one = tables(state)
    sent = state.read("outbox").select("key", "attempt_number", F.concat(F.lit("m"), F.substring("folder_id", 1, 6)).alias("message_id"), F.lit("t").alias("thread_id"))
    articles = spark.createDataFrame(SECOND, SCHEMA)
    calls = []

    def dies(requests):
        calls.append(1)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        cycle.run(state, articles, 2, 200, dies, sent)
    assert calls and tables(state) == one
    assert cycle.run(state, articles, 2, 200, infer, sent)
    two = tables(state)
    assert not cycle.run(state, articles, 2, 200, dies, sent) and tables(state) == two
    return state


def by(state, name, *columns):
    return {tuple(r[c] for c in columns) for r in state.read(name).collect()}


def test_decisions_and_members(after):
    assert by(after, "decisions", "article_id", "issue") == {("a1", "create_dossier"), ("a2", "create_dossier"), ("a3", "ambiguous_no_action"), ("a4", "create_dossier"), ("a5", "create_dossier"), ("b1", "attach_enrich"), ("b2", "duplicate_editorial"), ("b3", "attach_enrich")}
    facts = {r["article_id"]: sorted(f["key"] for f in r["facts"] or []) for r in after.read("members").collect()}
    assert facts == {"a1": [], "a2": [], "a4": [], "a5": [], "b1": ["price:15"], "b3": ["status:confirmed"]}
    assert {r["title"]: r["last_activity"] for r in after.read("folders").collect()} == {"Cohere buys Databricks 2.5": 200, "Introducing Claude Opus 5": 100, "Mistral launches Mixtral 8.1": 200, "Perplexity launches Comet 3.3": 100}


def test_attempts(after):
    title = {r["folder_id"]: r["title"].split()[0] for r in after.read("folders").collect()}
    got = sorted((title[r["folder_id"]], r["analyzed_at"], r["attempt_number"], r["origin"], r["validation_status"], r["decision"], tuple(r["error_codes"])) for r in after.read("attempts").collect())
    assert got == [
        ("Cohere", 100, 1, "llm_analysis", "accepted_with_warnings", "reject_editorial", ()),
        ("Cohere", 200, 1, "llm_analysis", "accepted_with_warnings", "reject_editorial", ()),
        ("Introducing", 100, 1, "deterministic_fallback", "accepted", "publish", ()),
        ("Mistral", 100, 1, "llm_analysis", "accepted_with_warnings", "publish", ()),
        ("Mistral", 200, 1, "llm_analysis", "accepted_with_warnings", "enrich_thread_only", ()),
        ("Perplexity", 100, 1, None, "rejected", "hold", ("invalid_json",)),
    ]


def test_outbox_and_publications(after):
    title = {r["folder_id"]: r["title"].split()[0] for r in after.read("folders").collect()}
    got = sorted((title[r["folder_id"]], r["kind"], r["attempt_number"], r["status"], r["channel"]) for r in after.read("outbox").collect())
    assert got == [("Introducing", "publish", 1, "succeeded", "annonces_majeures"), ("Mistral", "enrich", 1, "reserved", "veille_pertinente"), ("Mistral", "publish", 1, "succeeded", "veille_pertinente")]
    assert all(json.loads(r["payload"])["content"] for r in after.read("outbox").collect())
    assert {title[f]: s for f, s in by(after, "publications", "folder_id", "status")} == {"Introducing": "main_published", "Mistral": "main_published"}


def test_counters(after):
    marks = {r["cycle"]: r for r in after.marks().collect()}
    assert marks[1]["counters"] == {"matching_create_dossier": 4, "matching_ambiguous_no_action": 1, "analysis_analyzed": 3, "analysis_failed": 1, "publication_reserved": 2, "publication_skipped": 2} and marks[1]["status"] == "degraded"
    assert marks[2]["counters"] == {"matching_skipped": 5, "matching_attach_enrich": 2, "matching_duplicate_editorial": 1, "analysis_analyzed": 2, "publication_reserved": 1, "publication_skipped": 1} and marks[2]["status"] == "completed"


def test_compaction_changes_nothing_but_what_is_read(spark, after):
    before = tables(after)
    assert after.parts() == ["cycle=1", "cycle=2"]
    after.compact()
    assert after.parts() == ["base=2"] and tables(after) == before
    assert not cycle.run(after, spark.createDataFrame(FIRST, SCHEMA), 2, 200, infer)
    assert cycle.run(after, spark.createDataFrame(FIRST, SCHEMA), 3, 300, infer) and tables(after) == before and after.parts() == ["base=2", "cycle=3"]
    assert {r["cycle"]: r["counters"] for r in after.marks().filter("not base").collect()}[3] == {"matching_skipped": 5}
