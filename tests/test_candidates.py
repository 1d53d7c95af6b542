"""Articles against more candidates than one block, one word or the reference's bound has."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import matching
from tidewire.plans import record_queries, signal_queries
from tidewire.streaming import cycle

PRINTS = "folder_id string, status string, entities array<string>, labels array<string>, urls array<string>, `keys` array<string>, product string, version string, nature string, tier string, date long"
ARTICLES = "article_id string, title string, entities array<string>, labels array<string>, canonical string, facts array<struct<key:string,value:string>>, product string, version string, nature string, source_tier string, published_at long, `primary` boolean"
DAY = 86_400_000


def made(spark, articles, folders, seed=1):
    rnd = random.Random(seed)
    some = lambda kind, n, of, most: [f"{kind}{i}" for i in sorted(rnd.sample(range(of), rnd.randint(0, most)))][:n]
    scalars = lambda i: (rnd.choice(["openai", "mistral", None, None]), rnd.choice(["1.0", "2.0", None, None, None]), rnd.choice(["launch", "update", "other", "other", "paper", "acquisition", "availability"]), rnd.choice([*"SABCDE", None]), rnd.choice([None, *(rnd.randrange(90 * DAY) for _ in range(9))]))
    of = lambda: [*some("common", 3, 4, 2), *some("e", 3, 200, 3)]
    prints = [(f"f{i:04d}", rnd.choice(["open", "open", "idle", "closed"]), of(), some("c", 2, 9, 2), some("u", 2, 400, 1), some("price:", 3, 5, 3), *scalars(i)) for i in rnd.sample(range(folders), folders)]
    rows = []
    for i in range(articles):
        product, version, nature, tier, date = scalars(i)
        facts = [{"key": k, "value": "x"} for k in some("price:", 3, 9, 3)]
        names, labels = of(), some("c", 2, 12, 2)
        if i % 9 == 0:  # shares nothing
            names, labels, date, product = ["other"][: i % 2], [], None, None
        rows.append((f"a{i}", f"t  {i}", names, labels, rnd.choice([None, f"u{rnd.randrange(400)}"]), facts, product, version, nature, tier, date, rnd.random() < 0.95))
    return spark.createDataFrame(rows, ARTICLES), spark.createDataFrame(prints, PRINTS)


@pytest.mark.parametrize("size", [64, 100, 1 << 17])
def test_blocks_of_candidates_say_what_all_pairs_say(spark, size):
    articles, folders = made(spark, 300, 400)
    every = matching.pairs(articles, folders).cache()
    got = matching.resolve(articles, folders, 0, size)
    assert sorted(map(str, got.collect())) == sorted(map(str, matching.decide(articles, every).collect()))
    assert {r["issue"] for r in got.collect()} == {"create_dossier", "ambiguous_no_action", "attach_enrich", "duplicate_editorial"}
    want = every.groupBy("level", "favorable", "unfavorable").agg(F.count("*").alias("pairs"), F.sum(F.size("novel")).alias("novel"))
    assert sorted(map(str, matching.counted(articles, folders, size).collect())) == sorted(map(str, want.collect()))


def test_no_candidates(spark):
    articles, folders = made(spark, 20, 20)
    closed = folders.withColumn("status", F.lit("closed"))
    assert {r["issue"] for r in matching.resolve(articles, closed, -1).collect()} == {"create_dossier", "ambiguous_no_action"}
    assert matching.counted(articles, closed).count() == 0 == matching.counted(articles.limit(0), folders).count()


def test_the_least_active_dossier_is_a_candidate(spark):
    folders = spark.range(1200).select(F.format_string("f%04d", "id").alias("folder_id"), F.when(F.col("id") % 3 == 0, "closed").when(F.col("id") % 3 == 1, "idle").otherwise("open").alias("status"), F.col("id").alias("last_activity"))
    found = {r["folder_id"] for r in matching.candidate_folders(folders).collect()}
    assert found == {f"f{i:04d}" for i in range(1200) if i % 3}


@pytest.mark.parametrize("name", ["q_match_decisions", "q_match_issue_counts", "q_match_justification", "q_pair_compare"])
def test_queries_over_more_dossiers_than_the_bound(spark, many_documents, name):
    """The queries and their SQL take all of some 700 dossiers."""
    mine, con = many_documents
    queries, oracles = signal_queries.QUERIES | record_queries.QUERIES, signal_queries.ORACLES | record_queries.ORACLES
    theirs = con.execute(oracles[name]).fetchall()
    assert "LIMIT" not in oracles[name] and con.execute(f"WITH {signal_queries.MATCH_SQL} SELECT count(*) FROM fp").fetchone()[0] > matching.CANDIDATES
    names = [c[0] for c in con.execute(f"DESCRIBE {oracles[name]}").fetchall()]
    got = queries[name](spark, mine).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, theirs))


@pytest.fixture(scope="module")
def many_documents(spark, tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    rnd, at = random.Random(7), str(tmp_path_factory.mktemp("many"))
    words = ["of", "and", "the", "Mistral", "OpenAI", "Comet Orbit", "launches", "update", "Paris", "was", "version 2.1", "v3.0", "priced at $9", "waitlist", "research paper", *(f"Name{i}" for i in range(300))]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12))), rnd.choice(["en", "fr", "de"]), "s", 0) for i in range(7500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet/*.parquet'")
    return at, con


def test_a_cycle_compares_with_every_dossier(spark, tmp_path):
    """Each of 520 articles finds the one dossier of its version; bounded to the most recent ones, the rest open new dossiers."""
    rows = [(f"a{i:03d}", "press", "E", f"Mistral launches Mixtral 8.{i}", f"https://press.example/{i}", i, None, f"Mistral launches Mixtral 8.{i} today.", []) for i in range(520)]
    first = spark.createDataFrame(rows, "article_id string, source_id string, source_tier string, title string, url string, published_at long, summary string, content string, categories array<string>")
    again = first.withColumn("article_id", F.concat(F.lit("b"), "article_id")).withColumn("url", F.concat("url", F.lit("/again")))
    state = cycle.State(spark, f"file://{tmp_path}")
    cycle.matched(state, first, 1, 1_000)
    state.mark(1, spark.createDataFrame([({}, "completed")], "counters map<string,long>, status string"))
    count = lambda most: {r["issue"]: r["count"] for r in cycle.matched(state, again, 2, 2_000, most)[0].groupBy("issue").count().collect()}
    assert count(None) == {"duplicate_editorial": 520}
    assert count(500) == {"duplicate_editorial": 500, "create_dossier": 20}
