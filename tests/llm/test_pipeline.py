from pyspark.sql import functions as F

from tidewire.llm import langid, pii, queries


def test_stages_on_edge_rows(spark, edge, none, tmp_path):
    import corpus_pipeline

    for name, docs in (("edge", edge), ("none", none)):
        at, columns = docs, docs.columns
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            before = at
            out = f(spark, at, "")
            out.write.parquet(f"{tmp_path}/{name}{i}")
            at = spark.read.parquet(f"{tmp_path}/{name}{i}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == columns, stage
            if stage == "personal_data":
                assert sorted(str(r["text"]) for r in at.collect()) == sorted(str(pii.redact(r["text"])) for r in before.collect())
            if stage == "mixing" and name == "edge":
                copies = {r["doc_id"]: r["count"] for r in at.groupBy("doc_id").count().collect()}
                assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in before.collect()}
        assert (at.count() > 0) == (name == "edge")
        assert at.filter(~F.col("exact")).count() == 0


def test_stages_equal_brute_force(spark, edge):
    """Language by summing all segmentations in plain Python, near copies by all pairs, the mix by plain targets, tokens by the library."""
    import math

    import corpus_pipeline
    from test_text_operators import plain_components, plain_targets, words

    stages = dict(corpus_pipeline.STAGES)
    langs, p = langid.train(edge.select("doc_id", "text", "lang"))
    number = {w: i + 1 for i, w in enumerate(langid.piece_list(langid.vocabulary.MODEL))}
    widest, sums = max(map(len, number)), {}

    def logs(word):
        if word not in sums:
            t = "▁" + word
            ways = [[1.0] * len(langs)] + [[0.0] * len(langs) for _ in t]
            for b in range(1, len(t) + 1):
                for a in range(max(0, b - widest), b):
                    k = number.get(t[a:b], 0 if b - a == 1 else None)
                    if k is not None:
                        ways[b] = [x + y * q for x, y, q in zip(ways[b], ways[a], p[k])]
            sums[word] = [math.log(x) for x in ways[-1]]
        return sums[word]

    def kept(text):
        found = langid._WORDS.findall((text or "").lower())
        total = [sum(x) for x in zip(*map(logs, found))]
        return bool(found) and 1 / sum(math.exp(x - max(total)) for x in total) >= 0.5

    rows = edge.collect()
    got = stages["language"](spark, edge, "").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in rows if kept(r["text"]))

    root = plain_components([(r["doc_id"], r["text"]) for r in rows], 5, 4, 5)
    got = stages["near_duplicates"](spark, edge, "").collect()
    wanted = {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]}
    assert {(r["doc_id"], r["text"]) for r in got} == wanted and sum(r["doc_id"] is not None for r in got) == sum(i is not None for i, _ in wanted)

    got = stages["mixing"](spark, edge.filter("doc_id is not null and doc_id not in (9, 12)"), "")
    left = {r["doc_id"]: len(words(r["text"])) for r in rows if r["doc_id"] not in (None, 9, 12)}
    size = {}
    for r in rows:
        if r["doc_id"] in left:
            size[r["source"]] = size.get(r["source"], 0) + left[r["doc_id"]]
    taken = {}
    for r in got.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + left[r["doc_id"]]
    largest = {s: max(left[r["doc_id"]] for r in rows if r["doc_id"] in left and r["source"] == s) for s in size}
    for s, t in plain_targets(size).items():
        assert abs(taken.get(s, 0) - t) <= 0.02 * t + largest[s], (s, t, taken.get(s))


def test_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert langid.piece_list
