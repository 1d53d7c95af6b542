import hashlib

from pyspark.sql import functions as F

from tidewire.functions.signals import with_signals
from tidewire.operators import analysis, articles, matching, ops, publication
from tidewire.plans import tables as t
from tidewire.streaming import ingest, rate_limit


def test_known_matches(spark):
    """Each article against the folders of the first column only."""
    cases = {
        "MG01": (["MG03"], "attach_enrich", "high"), "MG02": (["MG03"], "create_dossier", "none"), "MG04": (["MG03"], "create_dossier", "none"), "MG05": (["MG03"], "ambiguous_no_action", "low"),
        "MG08": ([], "create_dossier", "none"), "MG03": (["MG01", "MG03"], "ambiguous_no_action", None),
    }
    signals = with_signals(t.golden(spark)).cache()
    for article, (members, issue, confidence) in cases.items():
        folders = spark.createDataFrame([(f"f{i}", "open", 1) for i, _ in enumerate(members)], "folder_id string, status string, last_activity long")
        first = spark.createDataFrame([(f"f{i}", m, 1) for i, m in enumerate(members)], "folder_id string, article_id string, attached_at long")
        prints = matching.folder_fingerprints(folders, first, signals)
        own = signals.filter(F.col("article_id") == article)
        row = matching.decide(own, matching.pairs(own, prints)).first()
        assert row["issue"] == issue, (article, row)
        assert confidence in (None, row["confidence"]), (article, row)


def test_motives_and_signals_of_decisions(spark):
    """All outcomes: thin content, a tie, new facts, no new facts, a weak match, a distinct event, no candidate; by both ways of comparing."""
    rows = [
        ("seed", "OpenAI launches GPT-4o", "OpenAI launches GPT-4o.", "https://openai.com/blog/gpt-4o", "S", 10),
        ("reprint", "OpenAI launches GPT-4o", "OpenAI launches GPT-4o.", "https://press.example/gpt-4o", "E", 15),
        ("waitlist", "OpenAI launches GPT-4o and opens waitlist", "OpenAI launches GPT-4o and opens a waitlist for access.", "https://news.example/w", "E", 12),
        ("other", "Anthropic launches Claude 4", "Anthropic launches Claude 4.", "https://anthropic.com/c", "S", 11),
        ("thin", "why", None, "https://press.example/why", "E", 11),
        ("theme", "Benchmarks debate around generative AI continues", "Commentators revisit generative AI benchmarks.", "https://press.example/debate", "E", 20),
    ]
    frame_ = spark.createDataFrame([(i, "s", tier, t, u, hour * 3_600_000, s, None, ["generative-ai"]) for i, t, s, u, tier, hour in rows], "article_id string, source_id string, source_tier string, title string, url string, published_at long, summary string, content string, categories array<string>")
    signals = with_signals(frame_).cache()
    theme = spark.createDataFrame([("fld_theme", "open", 1, ["nobody"], ["generative ai"], ["https://example.com/t"], [], None, None, "other", None, 0)], "folder_id string, status string, last_activity long, entities array<string>, labels array<string>, urls array<string>, keys array<string>, product string, version string, nature string, tier string, date long")
    signals = signals.withColumn("labels", F.when(F.col("article_id") == "theme", F.array(F.lit("generative ai"))).otherwise(F.col("labels")))

    def prints(*folders):
        made = spark.createDataFrame([(f, "open", 1) for f in folders], "folder_id string, status string, last_activity long")
        first = spark.createDataFrame([(f, "seed", 1) for f in folders], "folder_id string, article_id string, attached_at long")
        return matching.folder_fingerprints(made, first, signals)

    cases = [
        ("thin", prints("a"), ("ambiguous_no_action", None, "low", ["insufficient_primary_information"], [], ["content_too_thin"])),
        ("reprint", prints("fld_a", "fld_b"), ("ambiguous_no_action", None, "low", ["multiple_plausible_folders"], None, ["conflicting_candidate_folders"])),
        ("waitlist", prints("a"), ("attach_enrich", "a", "high", ["same_event", "novel_information"], None, [])),
        ("reprint", prints("a"), ("duplicate_editorial", "a", "high", ["same_event", "no_novel_information"], None, ["absence_of_new_value"])),
        ("other", prints("a"), ("create_dossier", None, "none", ["distinct_event", "primary_information"], [], None)),
        ("seed", prints(), ("create_dossier", None, "none", ["no_credible_candidate", "primary_information"], [], [])),
        ("theme", theme, ("ambiguous_no_action", "fld_theme", "low", ["low_confidence_match"], ["category_overlap", "temporal_proximity"], ["insufficient_event_identity", "theme_or_category_only"])),
    ]
    for article, folders, want in cases:
        own = signals.filter(F.col("article_id") == article)
        for row in (matching.decide(own, matching.pairs(own, folders)).first(), matching.resolve(own, folders).first()):
            got = tuple(row[c] for c in ("issue", "folder_id", "confidence", "motives", "favorable", "unfavorable"))
            assert all(w is None or g == w for g, w in zip(got[2:], want[2:])) and got[:2] == want[:2], (article, row)
            assert (row["title"] is not None) == (row["issue"] == "create_dossier") and (row["enrichment"] is not None) == (row["issue"] == "attach_enrich")
    line = matching.justification(matching.resolve(signals.filter("article_id = 'thin'"), prints("a"))).first()["justification"]
    assert line == "issue=ambiguous_no_action; confidence=low; folder=none; motives=insufficient_primary_information; favorable=none; unfavorable=content_too_thin"


def test_reserving_a_main_message(spark):
    requests = spark.createDataFrame([(f, f"publish:{f}") for f in "abcdefgh"], "folder_id string, key string")
    folders = spark.createDataFrame([(f, "closed" if f == "g" else "open") for f in "abcdefg"], "folder_id string, status string")
    publications = spark.createDataFrame([("a", "pending", None), ("b", "main_published", "m"), ("c", "main_published", "m"), ("d", "partial", None), ("e", "failed", None)], "folder_id string, status string, main_message_id string")
    attempts = [("a", 1, "succeeded"), ("a", 2, "failed"), ("b", 1, "succeeded"), ("e", 1, "failed"), ("e", 2, "failed"), ("c", 1, "failed")]
    tried = spark.createDataFrame([(f, "publish", f"publish:{f}", n, s) for f, n, s in attempts], "folder_id string, kind string, key string, attempt_number int, status string")
    got = {r["folder_id"]: (r["outcome"], r["attempt_number"]) for r in publication.reserve(requests, folders, publications, tried).collect()}
    assert got == {"a": ("already_succeeded", None), "b": ("already_published", None), "c": ("main_already_reserved_or_exists", None), "d": ("forbidden_status_transition", None), "e": ("reserved", 3), "f": ("reserved", 1), "g": ("folder_closed", None), "h": ("folder_absent", None)}


def test_catch_up_takes_members_of_the_sources_alone(spark):
    folders = spark.createDataFrame([("f", "open"), ("g", "idle"), ("h", "closed"), ("i", "open")], "folder_id string, status string")
    members = spark.createDataFrame([("f", "a1"), ("f", "a2"), ("f", "a3"), ("g", "a4"), ("h", "a5"), ("i", "a6")], "folder_id string, article_id string")
    arts = spark.createDataFrame([("a1", "own", 5), ("a2", "other", 5), ("a3", "own", None), ("a4", "own", 99), ("a5", "own", 5), ("a6", "own", 5)], "article_id string, source_id string, published_at long")
    got = ops.catch_up(folders, members, arts, folders.filter("folder_id = 'i'").select("folder_id"), ["own"], 0, 10)
    assert sorted(r["article_id"] for r in got.collect()) == ["a1", "a3"]


def test_fingerprint_text(spark):
    """The text that is hashed, spelled out: repeated ids and pairs stay, a pair with one empty side stays, only '=' goes."""
    folders = spark.createDataFrame([(" f ", "open")], "folder_id string, status string")
    arts = spark.createDataFrame([(" f ", a) for a in ("b", " a ", "b", " ")], "folder_id string, article_id string")
    facts = spark.createDataFrame([(" f ", k, v) for k, v in (("v", "2"), ("v", "2"), (" ", " "), ("k", ""), (None, None))], "folder_id string, key string, value string")
    want = hashlib.sha256(b"folderId=f\narticles=a,b,b\nfacts=k=\nv=2\nv=2\nstatus=open").hexdigest()
    assert analysis.aggregate_fingerprint(folders, arts, facts).first()["fingerprint"] == want


def test_anchoring_of_facts(spark):
    rows = [(1, "k", "modèle étendu", "explicit", None), (2, "k2", "étendu modèle", "explicit", None), (3, " ", "modèle", "explicit", "not_anchored"), (4, "k4", "modele", "explicit", "not_anchored"), (5, "k5", "modèle", "inferred", "inferred"), (6, "K2 ", "modèle", "explicit", "duplicate"), (7, "k7", " ", "explicit", "not_anchored")]
    df = spark.createDataFrame([("f", i, k, v, s, "Le Modèle   étendu arrive") for i, k, v, s, _ in rows], "folder_id string, seq int, key string, value string, support string, text string")
    assert {r["seq"]: r["dropped"] for r in analysis.anchored_facts(df).collect()} == {i: d for i, *_, d in rows}


def test_attempts_by_fingerprint(spark):
    columns = "folder_id string, fingerprint string, attempt_id int, decision string, validation_status string, analyzed_at long, created_at long"
    rows = [("f", "x", 1, "hold", "accepted", 1, 1), ("f", "x", 2, "hold", "accepted", 2, 2), ("f", "y", 3, "publish", "accepted_with_warnings", 3, 3), ("f", "x", 4, "publish", "rejected", 4, 4)]
    tried = spark.createDataFrame(rows, columns)
    assert {(r["fingerprint"], r["attempts"], r["holds"]) for r in analysis.prior_holds(tried).collect()} == {("x", 3, 2), ("y", 1, 0)}
    asked = spark.createDataFrame([("f", "x"), ("f", "y"), ("g", "y")], "folder_id string, fingerprint string")
    assert {(r["folder_id"], r["fingerprint"], r["outcome"], r["attempt_id"]) for r in analysis.reuse(asked, tried).collect()} == {("f", "x", "analyse", None), ("f", "y", "reused", 3), ("g", "y", "analyse", None)}


def test_attempts_that_break_a_constraint(spark):
    good = dict(folder_id="f", fingerprint="a" * 64, attempt_number=1, origin="llm", validation_status="accepted_with_warnings", has_proposal=True, has_scoring=True, n_errors=0, decision="publish")
    cases = [({}, None), ({"origin": None}, None), ({"folder_id": " "}, "folder_missing"), ({"fingerprint": "A"}, "fingerprint_format"), ({"attempt_number": 0}, "attempt_number"), ({"origin": "x"}, "origin"), ({"has_proposal": False}, "accepted_without_proposal"), ({"has_scoring": False}, "accepted_without_scoring"), ({"validation_status": "rejected"}, "rejected_with_scoring"), ({"validation_status": "rejected", "has_scoring": False}, "published_without_acceptance"), ({"validation_status": "rejected", "has_scoring": False, "has_proposal": False}, "rejected_without_error"), ({"validation_status": "rejected", "has_scoring": False, "has_proposal": False, "n_errors": 1, "decision": "hold"}, None)]
    df = spark.createDataFrame([(*(good | c).values(), i) for i, (c, _) in enumerate(cases)], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in good.items()) + ", i int")
    assert {r["i"]: r["broken"] for r in analysis.violations(df).collect()} == {i: b for i, (_, b) in enumerate(cases) if b}


def test_closed_folders_do_not_match(spark):
    signals = with_signals(t.golden(spark))
    folders = spark.createDataFrame([("f", "closed", 1)], "folder_id string, status string, last_activity long")
    members = spark.createDataFrame([("f", "MG03", 1)], "folder_id string, article_id string, attached_at long")
    own = signals.filter("article_id = 'MG01'")
    assert matching.decide(own, matching.pairs(own, matching.folder_fingerprints(folders, members, signals))).first()["issue"] == "create_dossier"


def test_persisting_a_cycle(spark):
    d = spark.createDataFrame([("a", "create_dossier", None, "T", None, None), ("b", "attach_enrich", "f", None, "version", ["version:2"]), ("c", "duplicate_editorial", "f", None, None, None)], "article_id string, issue string, folder_id string, title string, enrichment string, facts array<string>")
    folders, members = matching.persist(d, 7)
    assert [(r["title"], r["status"], r["last_activity"]) for r in folders.collect()] == [("T", "open", 7)]
    assert {(r["article_id"], r["role"], r["enrichment"], tuple(r["facts"] or ())) for r in members.collect()} == {("a", "primary", None, ()), ("b", "enrichment", "version", ("version:2",))}


def version(**more):
    base = dict.fromkeys(articles.FIELDS) | {"source_tier": "S", "title": "Introducing  Qwen 3", "url": "https://q.example/a?utm_source=rss", "published_at": 1, "content": "x\n y", "categories": ["Models", "Research"], "feed_format": "rss", "external_id": "e"}
    return base | more


SCHEMA = "source_tier string, title string, url string, published_at long, author string, summary string, content string, categories array<string>, feed_format string, external_id string"


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[f] for f in articles.FIELDS) for r in rows], SCHEMA)


def test_editorial_comparison(spark):
    same = version(title="Introducing Qwen 3 ", url="https://Q.example/a?utm_campaign=z#top", categories=["research", "models"])
    edited = version(title="Introducing Qwen 4", content="x y z")
    c = {f: F.col(f) for f in articles.FIELDS}
    hashes = [r[0] for r in frame(spark, version(), same, edited).select(articles.editorial_hash(c)).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    both = frame(spark, version()).select(F.struct("*").alias("a")).join(frame(spark, edited).select(F.struct("*").alias("b")))
    changed = both.select(articles.changed_fields({f: F.col(f"a.{f}") for f in c}, {f: F.col(f"b.{f}") for f in c})).first()[0]
    assert changed == ["title", "content"]


def test_upsert_in_order(spark):
    rows = [version(), version(), version(title="New"), version(external_id=None)]
    seq = frame(spark, *rows).withColumn("seq", F.monotonically_increasing_id()).withColumns({"source_id": F.lit("s"), "article_id": F.lit("a")})
    listed = seq.collect()
    ordered = spark.createDataFrame([(*r[:10], i, "s", "a") for i, r in enumerate(listed)], SCHEMA + ", seq long, source_id string, article_id string")
    done = articles.upsert(ordered, ordered.limit(0)).orderBy("seq").collect()
    assert [r["action"] for r in done] == ["created", "unchanged", "updated", "created"]


def test_streamed_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(*(version(external_id=f"e{i % 2}", title=f"t{i}")[f] for f in articles.FIELDS), i, "s", f"a{i}") for i in range(4)], SCHEMA + ", seq long, source_id string, article_id string")
    at = str(tmp_path)
    for i in range(2):
        rows.filter(F.col("seq").between(2 * i, 2 * i + 1)).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        ingest.ingest(stream, f"{at}/versions", f"{at}/actions", f"{at}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{at}/actions/batch=*").orderBy("seq").collect()
    assert [r["action"] for r in done] == ["created", "created", "updated", "updated"]


def test_rate_limit_as_table_and_stream(spark, tmp_path):
    rows = [("a", "status", x, i) for i, x in enumerate([0, 1000, 2999, 3000, 5000, 6000])]
    calls = spark.createDataFrame(rows, "actor string, operation string, `at` long, call_id long")
    wanted = [True, False, False, True, False, True]
    assert [r["accepted"] for r in rate_limit.limited(calls).orderBy("call_id").collect()] == wanted
    calls.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rate_limit.limited_stream(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [r["accepted"] for r in spark.table("limited").orderBy("call_id").collect()] == wanted


def test_aggregate_fingerprint_ignores_order(spark):
    folders = spark.createDataFrame([("f", "open")], "folder_id string, status string")
    arts = spark.createDataFrame([("f", "a2"), ("f", "a1")], "folder_id string, article_id string")
    facts = spark.createDataFrame([("f", "version", "2.0"), ("f", "date", "2026-07-01"), ("f", " ", "x")], "folder_id string, key string, value string")
    one = analysis.aggregate_fingerprint(folders, arts, facts).first()["fingerprint"]
    two = analysis.aggregate_fingerprint(folders, arts.orderBy("article_id"), facts.orderBy("key")).first()["fingerprint"]
    other = analysis.aggregate_fingerprint(folders.withColumn("status", F.lit("closed")), arts, facts).first()["fingerprint"]
    assert one == two != other and len(one) == 64


def test_context_budget_drops_the_oldest_enrichments(spark):
    rows = [("f", "p", 0, "primary", "x" * 50), ("f", "a", 1, "enrichment", "x" * 40), ("f", "b", 2, "enrichment", "x" * 40), ("f", "c", 3, "enrichment", "x" * 40)]
    done = analysis.context_budget(spark.createDataFrame(rows, "folder_id string, article_id string, attached_at int, role string, content string"), most=100).orderBy("article_id").collect()
    assert {r["article_id"]: r["kept"] for r in done} == {"a": False, "b": False, "c": True, "p": True}


def test_lease(spark):
    row = spark.createDataFrame([("other", 100)], "holder_id string, expires_at long")
    assert not ops.lease(row, "me", 50, 10).first()["acquired"]
    taken = ops.lease(row, "me", 100, 10).first()
    assert taken["acquired"] and taken["stolen"] and taken["holder_id"] == "me" and taken["expires_at"] == 110


def test_message_stays_within_limits(spark):
    rows = spark.createDataFrame([("fld_abcdefghijklmnop", "", "word " * 3000), ("fld_2", "<b>Title</b> @everyone", "x")], "folder_id string, title string, summary string")
    for r in publication.main_message(rows).collect():
        assert r["chars"] <= publication.LIMITS["total"] and len(r["title"]) <= 256 and len(r["description"]) <= 4096 and "@everyone" not in r["title"] and r["title"]


def test_total_shrinks_part_by_part(spark):
    parts = "array<struct<name:string,value:string,inline:boolean>>"
    rows = [(1, "t" * 200, "d" * 4000, [("f", "v" * 1000, True)] * 2, "foot"), (2, "t" * 200, "d" * 4000, [("f", "v" * 1000, True)] * 7, "foot"), (3, "t", "d", [], "foot")]
    done = {r["id"]: r for r in publication.within_total(spark.createDataFrame([(*r, []) for r in rows], f"id int, title string, description string, fields {parts}, footer string, warnings array<string>")).collect()}
    assert len(done[1]["description"]) == 6000 - 200 - 2002 - 4 and done[1]["warnings"] == ["embed_total_truncated:description"]
    assert done[2]["description"] is None and len(done[2]["fields"]) == 5 and done[2]["warnings"] == ["embed_total_truncated:description_removed"] + ["field_omitted:f", "embed_total_truncated:field_dropped"] * 2
    assert done[3]["description"] == "d" and done[3]["warnings"] == []


def test_facts_are_sanitized_once(spark):
    """No filter below the aggregation repeats the sanitizing; facts without a key or a value count as none."""
    rows = [(1, "b", "2"), (1, "a", "1"), (1, "", "x"), (1, None, "x"), (2, "k", " "), (3, "k", None), (4, "<b>k</b>", "&amp;")]
    facts = spark.createDataFrame(rows, "folder_id int, key string, value string")
    lines = publication._lines_of(facts)
    assert {r["folder_id"]: r["lines"] for r in lines.collect()} == {1: "• a: 1\n• b: 2", 4: "• k: &"}
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "@everyone" in x]


def test_candidates_are_compared_as_bits(spark):
    """resolve() says what decide() says of all pairs, for more candidates than a word has bits, and takes a row for each word, not for each pair."""
    ids, names = [f"f{i:03d}" for i in range(130)], ["openai", "mistral", "cohere", None]
    kinds, tiers, day = ["launch", "update", "other", "paper", "acquisition"], "SABCDE", 86_400_000
    fact = lambda k: {"key": k, "value": "x"}
    prints = [(f, "closed" if i == 7 else "open", [f"e{i % 70}"] if i % 3 else [], [f"c{i % 9}"] if i % 2 else [], [f"u{i}"] if i in (63, 127) else [], ["price:1"] if i % 2 else [], names[i % 4], f"{i % 5}.0" if i % 6 else None, kinds[i % 5], tiers[i % 6], i * day if i % 11 else None) for i, f in enumerate(ids)]
    folders = spark.createDataFrame(prints, "folder_id string, status string, entities array<string>, labels array<string>, urls array<string>, `keys` array<string>, product string, version string, nature string, tier string, date long")
    rows = [(f"a{i}", f"t  {i}", [f"e{i % 90}"] if i % 4 else [], [f"c{i % 12}"] if i % 3 else [], "u63" if i == 5 else "u127" if i == 6 else "u64", [fact("price:1"), fact("version:2")][: i % 3], names[(i // 2) % 4], f"{i % 7}.0" if i % 5 else None, kinds[(i // 3) % 5], tiers[(i // 5) % 6] if i % 13 else None, (i - 20) * day + i % 3 - 1 if i % 17 else None, i % 19 != 0) for i in range(200)]
    articles = spark.createDataFrame(rows, "article_id string, title string, entities array<string>, labels array<string>, canonical string, facts array<struct<key:string,value:string>>, product string, version string, nature string, source_tier string, published_at long, `primary` boolean")
    got = sorted(map(str, matching.resolve(articles, folders).collect()))
    assert got == sorted(map(str, matching.decide(articles, matching.pairs(articles, folders)).collect()))
    assert sum("attach_enrich" in r for r in got) and sum("duplicate_editorial" in r for r in got) and sum("multiple_plausible" in r for r in got)
    held, _ = matching._levels(articles, folders)
    assert held.count() == 3 * sum(r[-1] for r in rows)
    assert {r["issue"] for r in matching.resolve(articles, folders.limit(0)).collect()} == {"create_dossier", "ambiguous_no_action"}
