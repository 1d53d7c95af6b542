"""Analysis of dossiers: fingerprints, facts, budgets, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.rules import best_tier, scoring
from tidewire.functions.signals import tier_rank
from tidewire.operators.common import latest_by

# Characters of an article, of the facts and of a whole context.
ARTICLE_CHARS, FACT_CHARS, CONTEXT_CHARS = 3000, 2000, 12000
# Characters of a token that anchors a fact; validation states that count as accepted; origins of a proposal.
TOKEN = "a-z0-9àâäéèêëïîôùûüçœæ"
ACCEPTED = ("accepted", "accepted_with_warnings")
ORIGINS = ("llm", "llm_analysis", "deterministic_fallback")


def aggregate_fingerprint(folders: DataFrame, articles: DataFrame, facts: DataFrame) -> DataFrame:
    """(folder_id, fingerprint): SHA-256 over a folder's articles, facts and status, whatever order they come in. What is repeated counts each time; blank ids and pairs with two empty sides count not at all."""
    sorted_ = lambda c, by: F.array_join(F.array_sort(F.collect_list(c)), by)
    ids = articles.select("folder_id", F.trim("article_id").alias("id")).filter("id <> ''").groupBy("folder_id").agg(sorted_("id", ",").alias("ids"))
    side = lambda c: F.coalesce(F.trim(c), F.lit(""))
    known = facts.select("folder_id", F.concat(side("key"), F.lit("="), side("value")).alias("pair")).filter("pair <> '='").groupBy("folder_id").agg(sorted_("pair", "\n").alias("known"))
    all_ = folders.join(ids, "folder_id", "left").join(known, "folder_id", "left")
    line = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("")))
    return all_.select("folder_id", F.sha2(F.concat_ws("\n", line("folderId", F.trim("folder_id")), line("articles", F.col("ids")), line("facts", F.col("known")), line("status", F.col("status"))), 256).alias("fingerprint"))


def folder_tier(articles: DataFrame) -> DataFrame:
    return articles.groupBy("folder_id").agg(best_tier(F.max(tier_rank(F.col("source_tier")))).alias("tier"))


def anchored_facts(rows: DataFrame) -> DataFrame:
    """Facts (folder_id, seq, key, value, support) found in the folder's text: kept, or why dropped. Each key counts once, the first one."""
    plain = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "), F.lit(" "))
    hay, value = plain(F.col("text")), plain(F.col("value"))
    tokens = F.filter(F.split(F.regexp_replace(value, f"[^{TOKEN}]+", " "), " "), lambda t: F.length(t) >= 3)
    spoken = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(hay, t))
    found = (F.trim("key") != "") & ((F.contains(hay, value) & (value != "")) | spoken)
    verdict = F.when(F.col("support") == "inferred", "inferred").when(~found, "not_anchored")
    first = F.row_number().over(Window.partitionBy("folder_id", F.lower(F.trim("key"))).orderBy(F.col("dropped").isNotNull(), "seq"))
    return rows.withColumn("dropped", verdict).withColumn("dropped", F.when(F.col("dropped").isNull() & (first > 1), "duplicate").otherwise(F.col("dropped"))).drop("text")


def context_budget(articles: DataFrame, most: int = CONTEXT_CHARS, own: int = ARTICLE_CHARS) -> DataFrame:
    """(folder_id, article_id, chars, kept): bodies are cut to their own limit; the oldest enrichments go first until the rest fits or none is left. What other bodies exceed stays.

    Removing one after the other until it fits is the same as removing those before which the characters removed are less than the excess: a running sum.
    """
    cut = articles.withColumn("chars", F.least(F.length(F.coalesce("content", F.lit(""))), F.lit(own)).cast("long")).drop("content")
    total = F.sum("chars").over(Window.partitionBy("folder_id"))
    before = F.coalesce(F.sum(F.when(F.col("role") == "enrichment", F.col("chars")).otherwise(0)).over(Window.partitionBy("folder_id").orderBy("attached_at", "article_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = cut.withColumns({"excess": total - most, "before": before})
    gone = (F.col("role") == "enrichment") & (F.col("before") < F.col("excess"))
    return summed.select("folder_id", "article_id", "role", "chars", (~gone).alias("kept"))


def attempt_numbers(attempts: DataFrame, stored: DataFrame) -> DataFrame:
    """Number of each new attempt (folder_id, fingerprint, analyzed_at, attempt_id) after those stored for the same fingerprint."""
    before = stored.groupBy("folder_id", "fingerprint").agg(F.count("*").alias("before"))
    order = Window.partitionBy("folder_id", "fingerprint").orderBy("analyzed_at", "attempt_id")
    return attempts.withColumn("rn", F.row_number().over(order)).join(before, ["folder_id", "fingerprint"], "left").select("attempt_id", "folder_id", "fingerprint", (F.col("rn") + F.coalesce("before", F.lit(0))).cast("long").alias("attempt_number"))


def latest_attempt(attempts: DataFrame) -> DataFrame:
    return latest_by(attempts, ["folder_id"], "analyzed_at", "created_at", "attempt_id")


def prior_holds(attempts: DataFrame) -> DataFrame:
    """Attempts and holds of each fingerprint: what was held before a dossier changed does not count."""
    return attempts.groupBy("folder_id", "fingerprint").agg(F.count("*").alias("attempts"), F.count_if(F.col("decision") == "hold").alias("holds"))


def reuse(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Which requests (folder_id, fingerprint) are answered by their latest accepted attempt with a final decision."""
    final = latest_by(attempts.filter(F.col("validation_status").isin(*ACCEPTED)), ["folder_id", "fingerprint"], "analyzed_at", "created_at", "attempt_id").filter(F.col("decision").isin("publish", "enrich_thread_only", "reject_editorial"))
    return requests.join(final.select("folder_id", "fingerprint", "attempt_id", "decision"), ["folder_id", "fingerprint"], "left").withColumn("outcome", F.when(F.col("attempt_id").isNotNull(), "reused").otherwise("analyse"))


def violations(attempts: DataFrame) -> DataFrame:
    """Attempts (folder_id, fingerprint, attempt_number, origin, validation_status, has_proposal, has_scoring, n_errors, decision) that break a constraint, with the first one broken. An origin may be absent."""
    accepted, rejected = F.col("validation_status").isin(*ACCEPTED), F.col("validation_status") == "rejected"
    broken = (
        F.when(F.coalesce(F.trim(F.col("folder_id").cast("string")), F.lit("")) == "", "folder_missing")
        .when(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)), "fingerprint_format")
        .when(~F.coalesce(F.col("attempt_number") > 0, F.lit(False)), "attempt_number")
        .when(~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(True)), "origin")
        .when(accepted & ~F.col("has_proposal"), "accepted_without_proposal").when(accepted & ~F.col("has_scoring"), "accepted_without_scoring")
        .when(rejected & F.col("has_scoring"), "rejected_with_scoring").when(rejected & ~F.col("has_proposal") & (F.col("n_errors") == 0), "rejected_without_error")
        .when(F.col("decision").isin("publish", "enrich_thread_only") & ~accepted, "published_without_acceptance")
    )
    return attempts.withColumn("broken", broken).filter("broken is not null")


def fact_priority(key: Column) -> Column:
    """Rank in which facts are kept when there is no room for all: dates, versions, availability, others."""
    k = F.lower(key)
    return F.when(k.rlike("date|when|released|published|avail"), 0).when(k.rlike("version|ver|v[0-9]"), 1).when(k.rlike("disponib|availability|ga|preview"), 2).otherwise(3)


# Headings of a context.
ARTICLES_HEADING, FACTS_HEADING = "## Articles", "## Faits d'enrichissement retenus"


def context(folders: DataFrame, articles: DataFrame, facts: DataFrame, most: int = CONTEXT_CHARS, own: int = ARTICLE_CHARS, fact_chars: int = FACT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(contexts, bodies): what of each folder (folder_id, title) goes into a bounded context, all lengths being those of the rendered text.

    articles: folder_id, article_id, role, source_tier, title, url, content, attached_at; facts: folder_id, seq, key, value.
    Bodies are cut to their own limit and facts, by priority, to theirs. While it is too long, the bodies of the oldest
    enrichments go, one by one; then the body of the first primary article; then the room for facts is halved until it
    fits or nothing is left. contexts: folder_id, chars, fact_chars (the room that facts had in the end), verdict (ok or
    context_too_large). bodies: folder_id, article_id, chars, kept. Each step is a running sum; nothing is rendered.
    """
    line = F.length(F.concat(F.trim("key"), F.lit("="), F.trim("value")))
    place = Window.partitionBy("folder_id").orderBy("priority", F.lower("key"), "key", "seq")
    lines = facts.filter((F.trim("key") != "") | (F.trim("value") != "")).withColumns({"priority": fact_priority(F.col("key")), "line": line})
    ends = lines.withColumn("end", F.sum(F.col("line") + 1).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    rooms = [fact_chars >> i for i in range(fact_chars.bit_length())]
    held = ends.groupBy("folder_id").agg(*(F.coalesce(F.max(F.when(F.col("end") <= r, F.col("end"))), F.lit(0)).alias(f"room_{r}") for r in rooms))
    head = F.length(F.concat_ws("\n", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for n, c in (("articleId", "article_id"), ("role", "role"), ("tier", "source_tier"), ("title", "title"), ("url", "url")))))
    body = F.least(F.length(F.trim(F.coalesce("content", F.lit("")))), F.lit(own))
    cut = articles.withColumns({"head": head, "chars": body.cast("long")}).drop("content")
    cut = cut.withColumn("extra", F.when(F.col("chars") > 0, F.col("chars") + len("\nbody:\n")).otherwise(F.lit(0)).cast("long"))
    by_age = Window.partitionBy("folder_id").orderBy("attached_at", "article_id")
    older = by_age.rowsBetween(Window.unboundedPreceding, -1)
    enrichment, primary = F.col("role") == "enrichment", F.col("role") == "primary"
    spread = cut.withColumns({"before": F.coalesce(F.sum(F.when(enrichment, F.col("extra")).otherwise(0)).over(older), F.lit(0)), "first": primary & (F.coalesce(F.sum(F.when(primary, 1).otherwise(0)).over(older), F.lit(0)) == 0)})
    text = spread.groupBy("folder_id").agg(F.sum(F.col("head") + F.col("extra")).alias("blocks"), F.count("*").alias("n"), F.sum(F.when(enrichment, F.col("extra")).otherwise(0)).alias("enrichments"), F.coalesce(F.sum(F.when(F.col("first"), F.col("extra"))), F.lit(0)).alias("main"))
    zero = F.lit(0).cast("long")
    e = folders.join(text, "folder_id", "left").join(held, "folder_id", "left").na.fill(0, ["blocks", "n", "enrichments", "main", *(f"room_{r}" for r in rooms)])
    title = F.length(F.concat(F.lit("folderId="), F.col("folder_id").cast("string"))) + F.length(F.concat(F.lit("folderTitle="), F.coalesce("title", F.lit("")))) + len(ARTICLES_HEADING) + 4
    with_facts = lambda r: F.when(F.col(f"room_{r}") > 0, F.col(f"room_{r}") + len(FACTS_HEADING) + 3).otherwise(zero)
    e = e.withColumn("bare", title + F.col("blocks") + 2 * F.greatest(F.col("n") - 1, zero))
    e = e.withColumn("excess", F.col("bare") + with_facts(rooms[0]) - most)
    # the enrichments that go are those before which less than the excess has gone
    gone = spread.join(e.select("folder_id", "excess"), "folder_id").withColumn("gone", enrichment & (F.col("before") < F.col("excess")))
    saved = gone.groupBy("folder_id").agg(F.sum(F.when(F.col("gone"), F.col("extra")).otherwise(0)).alias("saved"))
    e = e.join(saved, "folder_id", "left").withColumn("left", F.col("bare") - F.coalesce("saved", zero))
    e = e.withColumn("no_main", F.col("left") + with_facts(rooms[0]) > most).withColumn("left", F.when(F.col("no_main"), F.col("left") - F.col("main")).otherwise(F.col("left")))
    room = F.coalesce(*(F.when(F.col("left") + with_facts(r) <= most, F.lit(r)) for r in rooms), zero)
    chars = F.col("left") + F.coalesce(*(F.when(F.col("left") + with_facts(r) <= most, with_facts(r)) for r in rooms), zero)
    contexts = e.select("folder_id", chars.alias("chars"), room.cast("long").alias("fact_chars"), F.when(chars <= most, "ok").otherwise("context_too_large").alias("verdict"))
    bodies = gone.join(e.select("folder_id", "no_main"), "folder_id").select("folder_id", "article_id", "chars", (~(F.col("gone") | (F.col("first") & F.col("no_main")))).alias("kept"))
    return contexts, bodies


def distinct_names(names: Column) -> tuple[Column, Column]:
    """(names without blanks at the ends, empty and repeated ones, case aside; whether one was repeated)."""
    plain = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    low = F.transform(plain, F.lower)
    return F.filter(plain, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), F.size(F.array_distinct(low)) < F.size(low)


def parsed_facts(raw: Column) -> Column:
    """Array of (key, value) from JSON text {"facts": [...]}, whose entries are objects or texts "key: value"; all others are passed over."""
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string"))
    listed = F.element_at(F.try_parse_json(raw).try_cast("map<string, variant>"), "facts").try_cast("array<variant>")
    fact = lambda k, v: F.struct(k.alias("key"), v.alias("value"))

    def one(v: Column) -> Column:
        own = v.try_cast("map<string, variant>")
        key, value = text(F.element_at(own, "key")), text(F.element_at(own, "value"))
        said = text(v)
        at = F.instr(said, ":")
        return F.when(own.isNotNull(), F.when((F.trim(key) != "") & (F.trim(value) != ""), fact(key, value))).when(at > 1, fact(F.trim(F.substring(said, F.lit(1), at - 1)), F.trim(F.substring(said, at + 1, F.length(said)))))

    return F.filter(F.transform(listed, one), lambda f: f.isNotNull() & (f["key"] != "") & (f["value"] != ""))


def folder_facts(members: DataFrame) -> DataFrame:
    """Facts (folder_id, seq, key, value) of the enrichments among members (folder_id, article_id, role, attached_at, facts as JSON), in order, each pair of key and value once, case aside."""
    found = members.filter("role = 'enrichment'").select("folder_id", "article_id", "attached_at", F.posexplode(parsed_facts(F.col("facts"))).alias("pos", "f"))
    same = Window.partitionBy("folder_id", F.lower(F.trim("f.key")), F.lower(F.trim("f.value"))).orderBy("attached_at", "article_id", "pos")
    first = found.withColumn("rn", F.row_number().over(same)).filter("rn = 1")
    seq = F.row_number().over(Window.partitionBy("folder_id").orderBy("attached_at", "article_id", "pos"))
    return first.select("folder_id", seq.cast("long").alias("seq"), "article_id", F.col("f.key").alias("key"), F.col("f.value").alias("value"))


def previous_keys(members: DataFrame, triggers: DataFrame) -> DataFrame:
    """(folder_id, key): lower-case fact keys that a folder's enrichments had before the article (folder_id, article_id) that triggers an analysis."""
    others = members.filter("role = 'enrichment'").join(triggers.select("folder_id", "article_id"), ["folder_id", "article_id"], "left_anti")
    return others.select("folder_id", F.explode(parsed_facts(F.col("facts"))).alias("f")).select("folder_id", F.lower(F.trim("f.key")).alias("key")).distinct()


# What each rule of an announcement makes of it; scores given without a model's opinion; channels.
RULE_KINDS = {"major_model_announcement": ("model_release", "launch"), "major_tool_release": ("product_update", "launch"), "open_weight_release": ("open_source", "availability"), "official_introducing_phrase": ("product_update", "launch")}
RULE_SCORES = {"relevance": 90, "impact": 88, "novelty": 85}


def fallback_proposal(rule: Column, title: Column, tier: Column) -> Column:
    """summary, category, nature, composite, channel and rationale of an announcement that a rule publishes; null if none does."""
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in RULE_KINDS.items() for x in (k, v[i]))), rule)
    base = F.trim(F.concat(F.lit("Annonce officielle majeure détectée (mode dégradé, règle "), rule, F.lit(") : "), F.coalesce(title, F.lit(""))))
    composite = scoring(*(F.lit(v) for v in RULE_SCORES.values()), tier)["composite"]
    channel = F.when(composite >= 85, "annonces_majeures").otherwise("veille_pertinente")
    rationale = F.concat(F.lit("Deterministic fallback matched rule "), rule, F.lit(" on official source (tier "), tier, F.lit(")."))
    return F.when(rule.isin(*RULE_KINDS), F.struct(F.substring(base, 1, 500).alias("summary"), pick(0).alias("category"), pick(1).alias("nature"), composite.alias("composite"), channel.alias("channel"), rationale.alias("rationale")))


# Codes of an analysis as a cycle tells them.
CYCLE_ERRORS = {
    "ollama_unavailable": "ollama_unavailable", "server_unreachable": "ollama_unavailable", "http_error": "ollama_unavailable", "model_absent": "ollama_unavailable", "inference_timeout": "inference_timeout", "timeout": "inference_timeout",
    "invalid_json": "invalid_json", "empty_response": "invalid_json", "schema_violation": "schema_violation", "schema_validation": "schema_violation", "empty_summary": "empty_summary", "queue_timeout": "queue_timeout",
    "lease_or_queue_timeout": "queue_timeout", "model_mismatch": "model_mismatch", "analysis_exhausted": "analysis_exhausted", "context_too_large": "context_too_large",
}


def cycle_error(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CYCLE_ERRORS.items() for x in kv)), code), F.lit("analysis_failed"))


def logged_error(code: Column, message: Column, status: Column, stage: Column) -> Column:
    """The code under which an error of the model's server is logged."""
    low = F.lower(F.coalesce(message, F.lit("")))
    absent = F.contains(low, F.lit("model")) & (F.contains(low, F.lit("not found")) | F.contains(low, F.lit("does not exist")) | F.contains(low, F.lit("pull")))
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    return (
        F.when(absent, "model_absent").when(is_(stage, "timeout") | is_(code, "inference_timeout"), "timeout")
        .when(is_(stage, "transport") | is_(code, "ollama_unavailable"), F.when(status >= 400, "http_error").otherwise("server_unreachable"))
        .when(code == "queue_timeout", "lease_or_queue_timeout").when(code == "invalid_json", F.when(F.contains(low, F.lit("empty")), "empty_response").otherwise("invalid_json"))
        .when(code.isin("schema_violation", "empty_summary"), "schema_validation").otherwise(code)
    )


# The closed sets and budgets of a proposal.
CATEGORIES = ("model_release", "product_update", "research", "benchmark", "funding_or_corp", "policy_or_safety", "open_source", "other")
KINDS = ("launch", "update", "acquisition", "paper", "denial", "availability", "correction", "other")
CHANNELS = ("annonces_majeures", "veille_pertinente", "flux_ia", "none")
WORTHINESS = ("high", "medium", "low", "none")
SUPPORT = ("explicit", "inferred")
BUDGETS = {"summary": (40, 500), "rationale": 280, "entities": 12, "entity": 80, "facts": 8, "fact_key": 64, "fact_value": 200, "secondary": 3}


def proposal_verdict(raw: Column) -> Column:
    """accepted, invalid_json, schema_violation or empty_summary for a proposal as JSON text. Unknown and missing fields are violations; the summary's length is looked at only if the shape is right."""
    root = F.try_parse_json(raw)
    true = lambda c: F.coalesce(c, F.lit(False))
    members = lambda v: v.try_cast("map<string, variant>")
    at = lambda v, k: F.element_at(members(v), k)
    shape = lambda v, *keys: true(F.schema_of_variant(v).startswith("OBJECT") & (F.array_sort(F.map_keys(members(v))) == F.array(*(F.lit(k) for k in sorted(keys)))))
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string"))
    listed = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), v.try_cast("array<variant>"))
    among = lambda v, values: true(text(v).isin(*values))
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), v.try_cast("double"))
    whole = lambda v: true(number(v).between(0, 100) & (number(v) == F.floor(number(v))))
    grid = lambda v: true(number(v).between(0, 1) & (F.abs(number(v) * 100 - F.round(number(v) * 100)) < 1e-9))
    every = lambda v, most, rule: true((F.size(listed(v)) <= most) & F.forall(listed(v), rule))
    c, s, e = at(root, "classification"), at(root, "scoring"), at(root, "editorialProposal")
    fact = lambda v: shape(v, "key", "value", "support") & true(F.length(F.trim(text(at(v, "key")))).between(1, BUDGETS["fact_key"])) & true(F.length(F.trim(text(at(v, "value")))).between(1, BUDGETS["fact_value"])) & among(at(v, "support"), SUPPORT)
    ok = shape(root, "schemaVersion", "summary", "classification", "scoring", "entities", "proposedFacts", "editorialProposal", "rationale")
    for rule in (
        among(at(root, "schemaVersion"), ("1",)), text(at(root, "summary")).isNotNull(), text(at(root, "rationale")).isNotNull(),
        shape(c, "primaryCategory", "secondaryCategories", "announcementNature"), among(at(c, "primaryCategory"), CATEGORIES), every(at(c, "secondaryCategories"), BUDGETS["secondary"], lambda v: among(v, CATEGORIES)), among(at(c, "announcementNature"), KINDS),
        shape(s, "relevance", "impact", "novelty", "confidence"), whole(at(s, "relevance")), whole(at(s, "impact")), whole(at(s, "novelty")), grid(at(s, "confidence")),
        every(at(root, "entities"), BUDGETS["entities"], lambda v: true(F.length(text(v)) <= BUDGETS["entity"])), every(at(root, "proposedFacts"), BUDGETS["facts"], fact),
        shape(e, "publishWorthiness", "suggestedChannelRole"), among(at(e, "publishWorthiness"), WORTHINESS), among(at(e, "suggestedChannelRole"), CHANNELS),
    ):
        ok &= rule
    length = F.length(F.trim(text(at(root, "summary"))))
    second = F.transform(listed(at(c, "secondaryCategories")), text)
    fine = (length <= BUDGETS["summary"][1]) & (F.length(F.trim(text(at(root, "rationale")))) <= BUDGETS["rationale"]) & ~F.array_contains(second, text(at(c, "primaryCategory"))) & (F.size(F.array_distinct(second)) == F.size(second))
    return F.when(root.isNull(), "invalid_json").when(~ok, "schema_violation").when(length < BUDGETS["summary"][0], "empty_summary").when(~true(fine), "schema_violation").otherwise("accepted")
