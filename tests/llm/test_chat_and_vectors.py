import json
import random

import numpy as np
import pytest

from tidewire.llm import chat, itq
from tidewire.llm.components import components

TOOLS = {"find": {"query": ("string", True), "limit": ("integer", False)}, "rate": {"value": ("number", True), "tags": ("array", False), "on": ("boolean", False)}}
CALL = "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>, status string"
RESULT = "conv_id long, call_id string, turn long, content string, level long"


def linked(spark, calls, results):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALL)
    r = spark.createDataFrame([(*x, 9) for x in results], RESULT)
    return {(x["conv_id"], x["call_id"]): x for x in chat.link(c, r, TOOLS).collect()}


def test_links_errors_and_canonical_json(spark):
    got = linked(
        spark,
        [
            (1, "a", 0, "find", '{"query": "x\\n\\u00e9", "limit": 3}', []), (1, "b", 2, "find", '{"limit": "3", "more": 1}', ["a", "zz"]), (1, "c", 4, "none", "{}", None), (1, "d", 5, "rate", "not json", []),
            (1, "e", 6, "rate", "[1]", []), (1, "f", 7, "rate", '{"value": 1.5, "tags": [1], "on": true}', []), (1, "f", 8, "rate", '{"value": 2}', []), (None, "g", 1, "find", "{}", []), (2, None, 1, "find", "{}", []), (3, "h", None, None, None, None),
        ],
        [(1, "a", 1, "fine"), (1, "a", 3, "again"), (1, "x", 9, "lost"), (1, "f", 9, None), (None, None, None, None)],
    )
    assert set(got) == {(1, k) for k in "abcdefx"} | {(3, "h")}
    assert got[1, "a"]["message"] == '{"arguments":{"limit":3,"query":"x\\né"},"call_id":"a","result":"fine","tool":"find"}'
    assert (got[1, "a"]["n_results"], got[1, "a"]["status"], got[1, "f"]["n_calls"]) == (2, "linked", 2)
    assert got[1, "b"]["errors"] == "limit: not integer; query: missing; more: unknown; depends_on: no zz"
    assert [got[1, k]["errors"] for k in "cdef"] == ["tool: unknown", "arguments: no JSON", "arguments: no object", ""]
    assert got[1, "x"]["status"] == "orphan" and got[1, "c"]["status"] == "unanswered"
    for x in got.values():
        assert json.loads(x["message"])["call_id"] == x["call_id"]


@pytest.mark.parametrize("seed", range(3))
def test_order_is_topological(spark, seed):
    r = random.Random(seed)
    calls = [(1, f"c{i}", r.randrange(12), "find", '{"query": "x"}', []) for i in range(25)]
    edges = [(a, b) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.08]
    calls = [(*c[:5], [f"c{a}" for a, b in edges if b == i]) for i, c in enumerate(calls)] + [(2, "p", 0, "find", "{}", ["q"]), (2, "q", 1, "find", "{}", ["p"]), (2, "s", 2, "find", "{}", ["s"])]
    got = linked(spark, calls, [])
    place = {k: (x["place"], x["level"], x["turn"], x["call_id"]) for k, x in got.items()}
    for a, b in edges:
        assert place[1, f"c{a}"][:2] < place[1, f"c{b}"][:2] or place[1, f"c{a}"] < place[1, f"c{b}"], (a, b)
        assert place[1, f"c{a}"][:2] <= place[1, f"c{b}"][:2]
    assert {got[2, k]["level"] for k in "pqs"} == {-1}


def test_long_runs_take_few_rounds(spark, monkeypatch):
    """A chain of 300 calls, each waiting for the next; one that leads into a cycle; and calls with two dependencies on top."""
    wrote = []
    real = chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda df: (wrote.append(1), real(df))[1])
    calls = [(1, f"c{i}", i, "find", '{"query": "x"}', [f"c{i + 1}"] if i < 299 else []) for i in range(300)]
    calls += [(2, "a", 0, "find", "{}", ["b"]), (2, "b", 1, "find", "{}", ["c"]), (2, "c", 2, "find", "{}", ["b"]), (2, "d", 3, "find", "{}", ["a", "e"]), (2, "e", 4, "find", "{}", []), (2, "f", 5, "find", "{}", ["e"]), (2, "g", 1, "find", "{}", ["e", "f"]), (2, "h", 0, "find", "{}", ["g"])]
    got = linked(spark, calls, [])
    assert all((got[1, f"c{i}"]["place"], got[1, f"c{i}"]["level"]) == (299, 299 - i) for i in range(300))
    assert {k: (got[2, k]["place"], got[2, k]["level"]) for k in "abcdefgh"} == {"a": (0, -1), "b": (1, -1), "c": (2, -1), "d": (3, -1), "e": (4, 0), "f": (5, 1), "g": (5, 2), "h": (5, 3)}
    assert len(wrote) < 40


@pytest.mark.parametrize("seed", range(2))
def test_levels_equal_longest_chains(spark, seed):
    """Random dependencies, some in cycles, and a run in which every third call has two; against a plain walk."""
    r = random.Random(40 + seed)
    on = {i: sorted({r.randrange(30) if r.random() < 0.04 else r.randrange(i) for _ in range(r.choice([0, 1, 1, 2, 3]))}) if i else [] for i in range(30)}
    on |= {i: [i - 1, i - 2] if i % 3 == 2 else [i - 1] for i in range(102, 160)} | {100: [], 101: [100]}
    turn = {i: r.randrange(50) for i in on}

    def walk(i, above=()):
        if i in above:
            return None
        under = [walk(j, (*above, i)) for j in on[i]] if i < 100 else [plain[j] for j in on[i]]
        return None if None in under else (1 + max((u[0] for u in under), default=-1), max([turn[i], *(u[1] for u in under)]))

    plain = {}
    for i in sorted(on):
        plain[i] = walk(i)
    got = linked(spark, [(1 if i < 100 else 2, f"c{i}", turn[i], "find", "{}", [f"c{j}" for j in on[i]]) for i in on], [])
    assert {k[1]: (x["level"], x["place"]) for k, x in got.items()} == {f"c{i}": (p or (-1, turn[i])) for i, p in plain.items()}


def test_conversations_as_tool_calls(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], None if (c, t) == (4, 0) else f"t{c}") for c in range(12) for t in range(9)] + [(None, 0, "user", "x"), (1, None, "user", "x")]
    got = {(x["conv_id"], x["turn"]): x for x in chat.link(*chat.tool_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.TOOLS).collect()}
    assert [got[3, t]["level"] for t in (0, 2, 4, 6, 8)] == [4, 3, 2, 1, 0] and got[3, 0]["place"] == 8 and got[3, 8]["errors"].endswith("depends_on: no 3:10")
    assert {got[5, t]["level"] for t in (0, 2, 4, 6, 8)} == {-1} and [got[4, t]["level"] for t in (0, 2, 4, 6)] == [0, 1, 2, 3]
    assert got[4, 0]["errors"] == "prompt: missing" and "limit: not integer" in got[5, 0]["errors"] and {x["tool"] if "tool" in x else json.loads(x["message"])["tool"] for x in got.values() if x["status"] != "orphan"} == {"reply", "search", "rate", "translate"}


def test_plain_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hello \"x\""), (1, 2, "assistant", "hi"), (1, 3, "user", None), (None, 1, "user", "x"), (2, None, "user", "x"), (2, 5, "assistant", "late")], "conv_id long, turn long, role string, text string")
    got = {(x["conv_id"], x["call_id"]): x for x in chat.link(*chat.turns(rows), chat.REPLY).collect()}
    assert got[1, "1:1"]["message"] == '{"arguments":{"prompt":"hello \\"x\\"","turn":1},"call_id":"1:1","result":"hi","tool":"reply"}'
    assert got[1, "1:3"]["errors"] == "prompt: missing" and got[2, "2:4"]["status"] == "orphan"
    assert chat.link(*chat.turns(rows.limit(0)), chat.REPLY).count() == 0


def brute(rows, least):
    usable = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = [0] * len(rows), {i: i for i, _, _ in rows if i is not None}
    place = [k for k, (i, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(usable)):
        for b in range(a + 1, len(usable)):
            (i, l, x), (j, m, y) = usable[a], usable[b]
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[place[a]] += 1
                links[place[b]] += 1
                if i is not None and j is not None:
                    p, q = root(i), root(j)
                    up[max(p, q)] = min(p, q)
    return sorted((str(i), n, str(None if i is None else root(i))) for (i, _, _), n in zip(rows, links))


@pytest.mark.parametrize("block, bucket", [(itq.BLOCK, 64), (16, 1000)])
def test_vectors_equal_all_pairs(spark, monkeypatch, block, bucket):
    """With one bucket for all, in blocks, every link is found; with tables, nearly all, also of a group with a third of the rows."""
    monkeypatch.setattr(itq, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        centre = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 12)) if g else 90):
            noise = rng.standard_normal(64)
            rows.append((len(rows), (centre + noise * 0.1 * np.linalg.norm(centre) / np.linalg.norm(noise)).astype(np.float32).tolist(), int(g % 3)))
    rows += [(len(rows) + k, list(rows[3][1]), rows[3][2]) for k in range(4)] + [(3, list(rows[3][1]), rows[3][2])]
    n = len(rows)
    rows += [(n + 1, None, 0), (n + 2, [], 0), (n + 3, [0.0] * 64, 0), (n + 4, [1.0, None] * 32, 0), (n + 5, [float("nan")] * 64, 0), (n + 6, [float("inf")] * 64, 0), (n + 7, rows[0][1], None), (n + 8, [1.0, 2.0], 1), (n + 9, [2.0, 4.1], 1), (n + 10, [1.0, -2.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies int, hash string").repartition(3)
    got = itq.near_duplicates(df, 0.98, block).collect()
    own, wanted = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got), brute(rows, 0.98)
    if bucket == 1000:
        assert own == wanted
    links, all_links = sum(x[1] for x in own), sum(x[1] for x in wanted)
    assert 0.97 * all_links <= links <= all_links
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert itq.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [64, 128, 384])
def test_recall_at_each_width(dim):
    """Pairs at a cosine of 0.98, the least that links: the share that agrees in enough code bytes."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((20_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    model = itq.fit(x[:5000])
    same = (itq.codes(x, model) == itq.codes(y, model)).sum(1)
    assert all((same >= r).mean() >= 0.95 for r in range(itq.MOST + 1)), [(same >= r).mean() for r in range(itq.MOST + 1)]


@pytest.mark.parametrize("bucket", [8, 0.1, 0.0005])
def test_width_follows_the_label(spark, monkeypatch, bucket):
    """One label with most vectors, and many small ones, at each width; huge and tiny vectors keep their links."""
    monkeypatch.setattr(itq, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    rows = [(2 * i + k, (v * s + k * 1e-3 * s * rng.standard_normal(96)).tolist(), 0 if i < 60 else i) for i in range(90) for v in [rng.standard_normal(96)] for s in [(1.0, 1e200, 1e-200)[i % 3]] for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_duplicates(df).collect()}
    assert got == {i: (1, i - i % 2) for i in range(180)}
    widths = {r["r"] for r in df.groupBy("label").count().select(itq._width(itq.F.col("count")).alias("r")).collect()}
    assert max(widths) == {8: 1, 0.1: 2, 0.0005: 3}[bucket]


def test_bits_are_balanced():
    x = np.random.default_rng(1).standard_normal((500, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share = np.unpackbits(itq.codes(x, itq.fit(x)), axis=1).mean(0)
    assert np.abs(share - 0.5).max() <= 0.21


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(5, 5), (None, 3)] + [(500, 500 + i) for i in range(40)]
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def test_links_do_not_follow_the_number_of_vectors(spark, monkeypatch):
    """Pairs near the least cosine that links, among few vectors of their label and among many: the same ones are found, and no more than a few are lost."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = [(2 * i + k, v.tolist(), 0) for i in range(len(x)) for k, v in enumerate((x[i], y[i]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = []
    for bucket in (1000, 8, 0.0005):
        monkeypatch.setattr(itq, "BUCKET", bucket)
        found.append({r["vec_id"] for r in itq.near_duplicates(df).collect() if r["n_links"]})
    assert found[0] == found[1] == found[2] and len(found[0]) >= 0.995 * len(rows)


@pytest.mark.parametrize("dim", [64, 128, 384])
def test_recall_of_the_width(dim):
    """Pairs at a cosine of 0.98: the share that is compared."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((20_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    model = itq.fit(x[:5000])
    same = (itq.codes(x, model) == itq.codes(y, model)).sum(1)
    assert (same >= itq.WIDTH).mean() >= 0.998
