"""One cycle as one job: matching, dossiers, analysis, decisions and the outbox, over state tables that readers see cycle by cycle.

Every table of the state is a folder of partitions, `table/cycle=<number>`. A cycle writes its rows there and last of all its
marker, `cycles/cycle=<number>`. Readers take the partitions of marked cycles alone, so a cycle that is killed leaves no
effect; run again, it overwrites what it left; run after its marker, it does nothing. Numbers of attempts, ids of dossiers and
idempotency keys derive from the state before the cycle and the cycle's time, so a repeated cycle makes the same ones.
One writer at a time is assumed, see ops.lease. compact() writes the current rows of all tables into one partition and
marks it as the new base, so what is read does not grow with the number of cycles.

Articles of a cycle do not see each other's dossiers. A dossier is analysed once a cycle, with all that the cycle attached to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import rules as R
from tidewire.functions.signals import with_signals
from tidewire.functions.text import fold_case
from tidewire.operators import analysis, matching, publication
from tidewire.operators.common import latest_by
from tidewire.storage import materialize

FACTS = "array<struct<key:string,value:string>>"
SIGNALS = f"article_id string, source_id string, source_tier string, title string, url string, published_at long, summary string, content string, categories array<string>, version string, nature string, product string, entities array<string>, facts {FACTS}, labels array<string>, canonical string, `primary` boolean"
#: Columns of each table, and the key whose newest row counts; a table without one is only added to.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "signals": (SIGNALS, ()),
    "folders": ("folder_id string, status string, title string, last_activity long", ("folder_id",)),
    "members": (f"folder_id string, article_id string, role string, attached_at long, enrichment string, facts {FACTS}", ()),
    "decisions": (f"article_id string, issue string, folder_id string, confidence string, motives array<string>, favorable array<string>, unfavorable array<string>, facts {FACTS}, enrichment string, title string, decided_at long, broken string", ()),
    "attempts": ("attempt_id string, folder_id string, fingerprint string, attempt_number long, analyzed_at long, created_at long, outcome string, origin string, validation_status string, decision string, composite long, impact long, tier string, category string, worthiness string, channel string, summary string, error_codes array<string>", ()),
    "publications": ("folder_id string, status string, main_message_id string, thread_id string, channel string", ("folder_id",)),
    "outbox": ("key string, attempt_number long, kind string, folder_id string, attempt_id string, fingerprint string, channel string, status string, payload string", ("key", "attempt_number")),
}
MARK = "cycle long, base boolean, counters map<string,long>, status string"
#: What a model answers, as JSON text.
ANSWER = "summary string, classification struct<primaryCategory:string>, scoring struct<relevance:long,impact:long,novelty:long>, proposedFacts array<struct<key:string,value:string,support:string>>, editorialProposal struct<publishWorthiness:string,suggestedChannelRole:string>"


class State:
    """The state tables under a folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def marks(self) -> DataFrame:
        """The markers of all cycles; one small row each."""
        try:
            return self.spark.read.schema(MARK).option("recursiveFileLookup", "true").parquet(f"{self.root}/cycles")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MARK)

    def parts(self) -> list[str]:
        """Partitions that count: the newest base and the marked cycles after it."""
        marked = [(r["cycle"], r["base"]) for r in self.marks().select("cycle", "base").collect()]
        base = max((c for c, b in marked if b), default=None)
        return ([f"base={base}"] if base is not None else []) + [f"cycle={c}" for c, b in sorted(marked) if not b and (base is None or c > base)]

    def read(self, table: str) -> DataFrame:
        """The current rows of a table."""
        schema, key = TABLES[table]
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, seq long").parquet(*(f"{self.root}/{table}/{p}" for p in parts))
        return (latest_by(rows, list(key), "seq") if key else rows).drop("seq")

    def write(self, table: str, cycle: int, rows: DataFrame) -> DataFrame:
        """Puts a cycle's rows into its partition, in place of what it may have left there; the rows as written."""
        schema, _ = TABLES[table]
        path = f"{self.root}/{table}/cycle={cycle}"
        fields = self.spark.createDataFrame([], schema).schema
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields), F.lit(cycle).cast("long").alias("seq")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def mark(self, cycle: int, counters: DataFrame) -> None:
        counters.select(F.lit(cycle).cast("long").alias("cycle"), F.lit(False).alias("base"), "counters", "status").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cycles/at={cycle}")

    def marked(self, cycle: int) -> bool:
        return self.marks().filter((F.col("cycle") >= cycle) & ((F.col("cycle") == cycle) | F.col("base"))).limit(1).count() > 0

    def compact(self) -> None:
        """Writes the current rows of every table into one partition, named after the last cycle, then marks it as base. Readers use either the old partitions or the new one."""
        last = self.marks().agg(F.max("cycle")).first()[0]
        if last is None:
            return
        for table in TABLES:
            self.read(table).withColumn("seq", F.lit(last)).write.mode("overwrite").parquet(f"{self.root}/{table}/base={last}")
        row = self.spark.range(1).select(F.lit(last).alias("cycle"), F.lit(True).alias("base"), F.lit(None).cast("map<string,long>").alias("counters"), F.lit(None).cast("string").alias("status"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cycles/base={last}")


def delivered(state: State, cycle: int, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publications and outbox rows after the sink's results (key, attempt_number, message_id, thread_id; a null message is a failure) for reserved rows."""
    told = results.select("key", "attempt_number", "message_id", "thread_id", F.lit(True).alias("told"))
    done = state.read("outbox").filter("status = 'reserved'").join(told, ["key", "attempt_number"])
    sent = done.filter("kind = 'publish' and message_id is not null").select("folder_id", "message_id", "thread_id", "channel")
    publications = state.read("publications")
    recorded = publication.record_main(sent.drop("channel"), publications).filter("error is null").join(sent.select("folder_id", "channel"), "folder_id")
    after = recorded.select("folder_id", "status", F.col("message_id").alias("main_message_id"), "thread_id", "channel")
    failed = done.filter("kind = 'publish' and message_id is null").select("folder_id").distinct().join(publications.filter("status = 'pending'"), "folder_id").withColumn("status", F.lit("failed"))
    return after.unionByName(failed.select(*after.columns)), done.withColumn("status", F.when(F.col("message_id").isNotNull(), "succeeded").otherwise("failed"))


def matched(state: State, eligible: DataFrame, cycle: int, now: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, skipped) of the eligible articles (article_id, source_id, source_tier, title, url, published_at, summary, content, categories): each that has no membership and no decision is compared with all live dossiers before the cycle, or only the so many most recently active; dossiers, members and decisions are written."""
    folders, members = state.read("folders"), state.read("members")
    one = eligible.dropDuplicates(["article_id"])
    skipped = materialize(matching.skipped(one, members, state.read("decisions")).select("article_id", "reason"))
    own = state.write("signals", cycle, with_signals(one.join(skipped, "article_id", "left_anti")))
    prints = matching.folder_fingerprints(matching.candidate_folders(folders, most), members.select("folder_id", "article_id", "attached_at"), state.read("signals"))
    found = matching.resolve(own, materialize(prints))
    pairs = own.select("article_id", F.col("facts").alias("own_facts"))
    kept = F.filter("own_facts", lambda f: F.array_contains(F.col("facts"), f["key"]))
    found = materialize(found.join(pairs, "article_id").withColumn("facts", kept).drop("own_facts"))
    broken = matching.violations(found.select("article_id", "issue", "folder_id", "title"), folders).select("article_id", "broken")
    decided = state.write("decisions", cycle, found.join(broken, "article_id", "left").withColumn("decided_at", F.lit(now)))
    good = decided.filter("broken is null")
    made, joined = matching.persist(good, now)
    state.write("members", cycle, joined)
    touched = matching.attach_effects(good, folders.select("folder_id", "status", "last_activity"), now).filter(F.col("last_activity") == now)
    state.write("folders", cycle, touched.join(folders.select("folder_id", "title"), "folder_id").select("folder_id", "status", "title", "last_activity").unionByName(made))
    return decided, skipped


def _dossiers(state: State, cycle: int, publications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dossiers, articles): what the cycle created or added to, with all that an analysis asks about it, and all its articles."""
    here = state.spark.read.schema(TABLES["members"][0]).parquet(f"{state.root}/members/cycle={cycle}")
    changed = here.groupBy("folder_id").agg(F.bool_or(F.col("role") == "primary").alias("created"), F.collect_set("enrichment").alias("kinds"), F.flatten(F.collect_list("facts")).alias("new_facts"))
    changed = materialize(changed)
    before = state.read("members").join(changed.select("folder_id"), "folder_id", "left_semi")
    known = before.select("folder_id", F.explode("facts").alias("f")).groupBy("folder_id").agg(F.collect_set("f.key").alias("known_keys"))
    both = state.read("signals").unionByName(state.spark.read.schema(SIGNALS).parquet(f"{state.root}/signals/cycle={cycle}"))
    articles = materialize(before.unionByName(here).join(both.select("article_id", "source_id", "source_tier", "title", "url", "summary", "content"), "article_id"))
    accepted = state.read("attempts").filter(F.col("validation_status").isin(*analysis.ACCEPTED))
    last = latest_by(accepted, ["folder_id"], "analyzed_at", "created_at", "attempt_id").select("folder_id", F.col("tier").alias("accepted_tier"))
    now_ = state.spark.read.schema(TABLES["folders"][0]).parquet(f"{state.root}/folders/cycle={cycle}")
    facts = articles.select("folder_id", F.explode("facts").alias("f")).select("folder_id", "f.key", "f.value")
    prints = analysis.aggregate_fingerprint(now_.select("folder_id", "status"), articles.select("folder_id", "article_id"), facts)
    main = publications.select("folder_id", R.has_main(F.col("main_message_id"), F.col("status")).alias("has_main"))
    e = changed.join(now_.select("folder_id", "status", "title"), "folder_id").join(prints, "folder_id").join(analysis.folder_tier(articles), "folder_id").join(known, "folder_id", "left").join(last, "folder_id", "left").join(main, "folder_id", "left")
    none = F.array().cast("array<string>")
    material = R.material(F.lit(None).cast("string"), F.col("new_facts.key"), F.coalesce("known_keys", none), F.col("tier"), F.col("accepted_tier")) | F.exists("kinds", lambda k: k.isin(*R.MATERIAL_TYPES))
    e = e.withColumns({"has_main": F.coalesce("has_main", F.lit(False)), "material": material, "issue": F.when(F.col("created"), "create_dossier").otherwise("attach_enrich")})
    return materialize(e.withColumn("eligible", R.eligibility(F.col("status"), F.col("issue"), F.col("material")))), articles


def _announced(dossiers: DataFrame, articles: DataFrame) -> DataFrame:
    """folder_id, level (importance of the first primary article), rule, rule_title, rule_tier of the first article that a rule publishes."""
    spelt = lambda: F.concat_ws("\n", F.coalesce("folder_title", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("content", F.lit("")))
    rows = articles.join(dossiers.select("folder_id", F.col("title").alias("folder_title"), "has_main"), "folder_id")
    rows = rows.withColumn("spelt", spelt()).withColumn("low", fold_case(F.col("spelt")))
    rows = R.with_importance(rows, F.col("spelt"), "source_id", "source_tier").withColumn("rule", R.announcement_rule(F.col("spelt"), F.col("source_id"), F.col("source_tier"), F.col("has_main"), F.col("low")))
    place = F.struct(F.when(F.col("role") == "primary", 0).otherwise(1), "attached_at", "article_id")
    hit = F.when(F.col("rule").isin(*analysis.RULE_KINDS), place)
    return rows.groupBy("folder_id").agg(F.min_by("importance.level", place).alias("level"), F.min_by(F.when(hit.isNotNull(), F.struct("rule", "title", "source_tier")), hit).alias("by_rule"))


def analysed(state: State, cycle: int, now: int, publications: DataFrame, infer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(attempts, dossiers) of the dossiers that the cycle touched. infer gets folder_id, fingerprint, title and trigger of those that need an answer, and returns folder_id, raw (JSON) and error of those it can tell something about.

    A final decision for the same fingerprint is reused; what is not eligible, or does not matter, is rejected without an
    answer, as is a context that is too large. Critical announcements are published by rule before anyone is asked, others
    if there is no usable answer. Accepted answers have their facts anchored, are scored and decided.
    """
    dossiers, articles = _dossiers(state, cycle, publications)
    tried = state.read("attempts")
    again = analysis.reuse(dossiers.select("folder_id", "fingerprint"), tried).select("folder_id", F.col("attempt_id").alias("reused_id"), F.col("decision").alias("reused_decision"))
    facts = articles.select("folder_id", F.posexplode("facts").alias("seq", "f")).select("folder_id", "seq", "f.key", "f.value")
    verdicts, _ = analysis.context(dossiers.select("folder_id", "title"), articles.select("folder_id", "article_id", "role", "source_tier", "title", "url", "content", "attached_at"), facts)
    holds = analysis.prior_holds(tried).select("folder_id", "fingerprint", "holds")
    e = dossiers.join(again, "folder_id", "left").join(verdicts.select("folder_id", "verdict"), "folder_id", "left").join(_announced(dossiers, articles), "folder_id", "left").join(holds, ["folder_id", "fingerprint"], "left")
    way = (
        F.when(F.col("reused_id").isNotNull(), "reused").when(F.col("eligible") == "skip_not_material", "enrichment_immaterial").when(F.col("eligible") != "analyse", "not_eligible")
        .when(F.col("verdict") == "context_too_large", "context_too_large").when((F.col("level") == "critical") & F.col("by_rule").isNotNull(), "rule").otherwise("ask")
    )
    e = materialize(e.withColumn("way", way))
    answers = materialize(infer(e.filter("way = 'ask'").select("folder_id", "fingerprint", "title")).select("folder_id", "raw", "error", analysis.proposal_verdict(F.col("raw")).alias("answer"), F.from_json("raw", ANSWER).alias("p")))
    text = articles.groupBy("folder_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attached_at", "article_id", "title", "content"))), lambda a: F.concat_ws("\n", a["title"], a["content"])), "\n").alias("text"))
    proposed = answers.filter("answer = 'accepted'").select("folder_id", F.posexplode("p.proposedFacts").alias("seq", "f")).select("folder_id", "seq", "f.*").join(text, "folder_id")
    anchored = analysis.anchored_facts(proposed).groupBy("folder_id").agg(F.count_if(F.col("dropped").isNull()).alias("anchored"), F.count_if(F.col("dropped").isNotNull()).alias("dropped"))
    e = e.join(answers, "folder_id", "left").join(anchored, "folder_id", "left")
    return _concluded(state, cycle, now, e, tried), dossiers


def _concluded(state: State, cycle: int, now: int, e: DataFrame, tried: DataFrame) -> DataFrame:
    """The rows of the attempts, numbered after those stored; a reused one has no row of its own but its outcome."""
    zero = F.lit(0).cast("long")
    usable = F.col("answer") == "accepted"
    way = F.when(F.col("way") != "ask", F.col("way")).when(F.coalesce(usable, F.lit(False)) & F.col("error").isNull(), "model").when(F.col("by_rule").isNotNull(), "rule").otherwise("failed")
    code = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("answer").isNotNull(), F.col("answer")).otherwise("ollama_unavailable")
    e = e.withColumns({"code": F.when(F.col("way") == "ask", code).otherwise(F.col("way")), "way": way})
    rule = analysis.fallback_proposal(F.col("by_rule.rule"), F.col("by_rule.title"), F.col("by_rule.source_tier"))
    ruled = R.scoring(*(F.lit(v) for v in analysis.RULE_SCORES.values()), F.col("by_rule.source_tier"))
    scored = R.scoring(F.col("p.scoring.relevance"), F.col("p.scoring.impact"), F.col("p.scoring.novelty"), F.col("tier"))
    by = lambda model, by_rule: F.when(F.col("way") == "model", model).when(F.col("way") == "rule", by_rule)
    e = e.withColumns({"r": rule, "s": by(scored, ruled)})
    n = F.coalesce("anchored", zero)
    worth, category = by(F.col("p.editorialProposal.publishWorthiness"), F.lit("high")), by(F.col("p.classification.primaryCategory"), F.col("r.category"))
    decided = R.decision(F.col("s.composite"), F.col("p.editorialProposal.publishWorthiness"), F.col("has_main"), F.col("material"), n, F.coalesce("holds", zero))
    hint = R.channel(F.col("s.composite"), F.col("s.impact"), category, F.col("p.editorialProposal.suggestedChannelRole"))
    status = by(F.when(F.coalesce("dropped", zero) > 0, "accepted_with_warnings").otherwise("accepted"), F.lit("accepted"))
    rows = e.select(
        "folder_id", "fingerprint", "way", "reused_id", "reused_decision", "tier", F.lit(now).alias("analyzed_at"), F.lit(now).alias("created_at"), F.lit("").alias("attempt_id"),
        F.when(F.col("way").isin("model", "rule"), "analyzed").when(F.col("way").isin("not_eligible", "enrichment_immaterial"), "skipped").when(F.col("way") == "reused", "reused").otherwise("failed").alias("outcome"),
        by(F.lit("llm_analysis"), F.lit("deterministic_fallback")).alias("origin"), F.coalesce(status, F.lit("rejected")).alias("validation_status"),
        by(decided, F.lit("publish")).alias("decision"), F.col("s.composite").alias("composite"), F.col("s.impact").alias("impact"), category.alias("category"), worth.alias("worthiness"), by(hint, F.col("r.channel")).alias("channel"),
        by(F.col("p.summary"), F.col("r.summary")).alias("summary"), F.when(~F.col("way").isin("model", "rule", "reused"), F.array("code")).otherwise(F.array().cast("array<string>")).alias("error_codes"),
    )
    rows = rows.withColumn("decision", F.when(F.col("outcome") == "failed", "hold").otherwise(F.col("decision")))
    fresh = rows.filter("outcome <> 'reused'")
    numbers = analysis.attempt_numbers(fresh.select("attempt_id", "folder_id", "fingerprint", "analyzed_at"), tried).select("folder_id", "attempt_number")
    name = F.sha2(F.concat_ws(":", "folder_id", "fingerprint", F.col("attempt_number").cast("string")), 256)
    written = state.write("attempts", cycle, fresh.join(numbers, "folder_id").withColumn("attempt_id", name))
    reused = rows.filter("outcome = 'reused'").select("folder_id", "fingerprint", F.col("reused_id").alias("attempt_id"), F.col("reused_decision").alias("decision"), "outcome")
    old = tried.select("attempt_id", "composite", "category", "worthiness", "channel", "summary")
    return written.unionByName(reused.join(old, "attempt_id", "left"), allowMissingColumns=True)


def published(state: State, cycle: int, now: int, attempts: DataFrame, dossiers: DataFrame, articles: DataFrame, publications: DataFrame, told: tuple[DataFrame, DataFrame]) -> DataFrame:
    """folder_id, step of every decision, after the outbox rows and publications of the cycle are written. told: what delivered() found, written along."""
    decided = attempts.filter("decision is not null and outcome in ('analyzed', 'reused', 'failed')")
    folders = dossiers.select("folder_id", "status", "title")
    routed = materialize(publication.route(decided.select("folder_id", "decision"), folders, publications))
    sent = state.read("outbox").join(told[1].select("key", "attempt_number"), ["key", "attempt_number"], "left_anti").unionByName(told[1].select(*state.read("outbox").columns))
    asked = routed.filter("step in ('publish', 'enrich', 'complete_thread')").join(decided.select("folder_id", "fingerprint", "attempt_id", "channel", "summary", "category", "worthiness", "composite"), "folder_id")
    keys = publication.keys_of(F.col("folder_id"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("fingerprint"), F.col("attempt_id"))
    publishes = materialize(asked.filter("step = 'publish' and channel <> 'none'").withColumn("key", keys["publish"]))
    enriches = materialize(asked.filter("step = 'enrich'").withColumns({"key": keys["enrich"], "kind": F.lit("enrich")}))
    main = publication.reserve(publishes.select("folder_id", "key"), folders, publications, sent).withColumn("kind", F.lit("publish"))
    thread = publication.reserve_operation(enriches.select("folder_id", "kind", "key", "fingerprint"), folders, publications, sent)
    sources = articles.select("folder_id", F.lit(0).alias("seq"), F.col("source_id").alias("name"), "url")
    opened = publication.main_payload(publishes.join(folders.select("folder_id", "title"), "folder_id").select("folder_id", "title", "summary", "category", "worthiness", "composite", F.lit(now).alias("useful_date")), sources)
    facts = dossiers.select("folder_id", F.explode("new_facts").alias("f")).select("folder_id", "f.key", "f.value")
    added = publication.enrichment_payload(enriches.select("folder_id", "fingerprint"), facts, sources)
    as_json = lambda rows: rows.select("folder_id", F.to_json(F.struct(*(c for c in rows.columns if c != "folder_id"))).alias("payload"))
    of = lambda reserved, rows, payload: reserved.join(rows.select("folder_id", "attempt_id", "fingerprint", "channel"), "folder_id").join(as_json(payload), "folder_id", "left")
    every = materialize(of(main, publishes, opened).select("folder_id", "key", "kind", "outcome", "attempt_number", "attempt_id", "fingerprint", "channel", "payload").unionByName(of(thread, enriches, added).select("folder_id", "key", "kind", "outcome", "attempt_number", "attempt_id", "fingerprint", "channel", "payload")))
    new = every.filter("outcome = 'reserved'").withColumn("status", F.lit("reserved"))
    columns = state.read("outbox").columns
    state.write("outbox", cycle, new.select(*columns).unionByName(told[1].select(*columns)))
    waiting = new.filter("kind = 'publish'").select("folder_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("main_message_id"), F.lit(None).cast("string").alias("thread_id"), "channel")
    state.write("publications", cycle, waiting.unionByName(told[0].join(waiting.select("folder_id"), "folder_id", "left_anti")))
    silent = asked.filter("step = 'publish' and coalesce(channel, 'none') = 'none'").select("folder_id", F.lit("skipped:no_channel").alias("step"))
    rest = routed.filter("step not in ('publish', 'enrich')").select("folder_id", "step")
    return every.select("folder_id", F.concat("kind", F.lit(":"), "outcome").alias("step")).unionByName(silent).unionByName(rest)


def _counted(decided: DataFrame, skipped: DataFrame, attempts: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: the counters of a cycle by what they count, and its status."""
    part = lambda rows, name, c: rows.select(F.concat(F.lit(f"{name}_"), c).alias("counter"))
    kind = F.when(F.col("step").startswith("skipped"), "skipped").when(F.col("step").startswith("failed"), "failed").when(F.col("step").endswith(":reserved"), "reserved").when(F.col("step") == "complete_thread", "complete_thread").otherwise("hit")
    every = part(decided, "matching", F.when(F.col("broken").isNull(), F.col("issue")).otherwise("failed")).unionByName(part(skipped, "matching", F.lit("skipped"))).unionByName(part(attempts, "analysis", F.col("outcome"))).unionByName(part(steps, "publication", kind))
    counts = every.groupBy("counter").agg(F.count("*").alias("n"))
    failed = F.bool_or(F.col("counter").endswith("_failed"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "n"))))
    return counts.agg(pairs.alias("counters"), F.when(F.coalesce(failed, F.lit(False)), "degraded").otherwise("completed").alias("status"))


def run(state: State, eligible: DataFrame, cycle: int, now: int, infer: Callable[[DataFrame], DataFrame], results: DataFrame | None = None, most: int | None = None) -> bool:
    """Runs a cycle over the eligible articles; false if it has been run. results: what the sink told about outbox rows since the last cycle. most: a bound on the dossiers that articles are compared with, see matched()."""
    if state.marked(cycle):
        return False
    spark = state.spark
    results = spark.createDataFrame([], "key string, attempt_number long, message_id string, thread_id string") if results is None else results
    told = tuple(materialize(x) for x in delivered(state, cycle, results))
    publications = state.read("publications")
    publications = materialize(publications.join(told[0], "folder_id", "left_anti").unionByName(told[0].select(*publications.columns)))
    decided, skipped = matched(state, eligible, cycle, now, most)
    attempts, dossiers = analysed(state, cycle, now, publications, infer)
    attempts = materialize(attempts)
    articles = state.spark.read.schema(TABLES["members"][0]).parquet(f"{state.root}/members/cycle={cycle}").select("folder_id", "article_id").join(state.spark.read.schema(SIGNALS).parquet(f"{state.root}/signals/cycle={cycle}").select("article_id", "source_id", "url"), "article_id")
    steps = materialize(published(state, cycle, now, attempts, dossiers, articles, publications, told))
    state.mark(cycle, _counted(decided, skipped, attempts, steps))
    return True
