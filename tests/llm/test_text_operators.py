import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidewire.llm import bloom_lm, cube, importance, jaccard, langid, media, pii, spm, vocabulary
from tidewire.llm.words import WordKeys, shingles, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- PII -----------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m)]


def test_base_spans_equal_plain_matching():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("a.@+-1 0(2)5é9") for _ in range(r.randrange(60)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == plain_pii(text)


def test_added_spans_need_confirmation():
    assert [s[0] for s in pii.find("iban DE89 3704 0044 0532 0130 00.")] == ["iban"]
    assert not pii.find("DE88 3704 0044 0532 0130 00")
    assert [s[0] for s in pii.find("account 123456789 of mine")] == ["account"]
    assert not pii.find("the year 123456789 of mine")


def plain_added(text):
    """Account codes by trying every start and the country's length; then account numbers, as the docstring tells."""
    base, found = [(a, b) for _, a, b in plain_pii(text)], []
    for i in range(len(text)):
        if (i and text[i - 1].isascii() and text[i - 1].isalnum()) or not re.match("[A-Z]{2}[0-9]{2}", text[i : i + 4]) or any(a <= i < b for _, a, b in found):
            continue
        n, j, code = pii.IBAN_LENGTHS[text[i : i + 2]] if text[i : i + 2] in pii.IBAN_LENGTHS else None, i + 4, text[i : i + 4]
        while n and len(code) < n and (m := re.match(" ?([A-Z0-9])", text[j:])):
            code, j = code + m[1], j + m.end()
        if n and len(code) == n and not re.match("[A-Za-z0-9]", text[j:]) and pii.mod97(code):
            found.append(("iban", i, j))
    held = base + [(a, b) for _, a, b in found]
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])*", text):
        near = text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40]
        beside = re.search("[A-Za-z.+-]", text[max(0, m.start() - 1) : m.start()]) or text[m.end() : m.end() + 1].isalpha()
        free = all(b <= m.start() or m.end() <= a for a, b in held)
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and free and not beside and re.search(r"\b(?:card|account)\b", near):
            found.append(("account", m.start(), m.end()))
    return found


def test_added_spans_equal_plain_search():
    r = random.Random(9)
    parts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "DE88 3704 0044 0532 0130 00", "EUR 50", "account", "card", "123456789", "1234 5678 9012", "A1", "x", ",", "a@b.co", "10.0.0.1", "+1 222 333 4444", "4111 1111 1111 1111", "ref-77"]
    for _ in range(4000):
        text = r.choice(["", " "]).join(r.choice(parts) + r.choice([" ", " ", ", ", ""]) for _ in range(r.randrange(1, 9)))
        assert [s[:3] for s in pii.find(text) if s[0] not in pii.BASE] == plain_added(text), text


def test_context_moves_every_score():
    for kind, alone, said in (("email", "x a@b.co", "mail a@b.co"), ("ip", "x 10.0.0.1", "host 10.0.0.1"), ("card", "x 4111 1111 1111 1111", "visa 4111 1111 1111 1111"), ("phone", "x +1 222 333 4444", "call +1 222 333 4444"), ("iban", "x DE89370400440532013000", "iban DE89370400440532013000")):
        low, high = ([s[3] for s in pii.find(t) if s[0] == kind] for t in (alone, said))
        assert len(low) == len(high) == 1 and low[0] < high[0] == 1.0, kind


def test_overlapping_spans_are_redacted_together():
    assert pii.redact("at 10.0.0.0 4111 1111 1111 1111 now") == "at <ip><card> now"
    assert pii.redact("IBAN DE89 3704 0044 0532 0130 00 EUR 50") == "IBAN <iban> EUR 50"


def test_long_runs_stay_linear():
    for piece in ("1 ", "a@", "+1", "1.", "A1"):
        pii.find(piece * 100_000)


def test_pii_of_edge_rows(edge, none):
    got = pii.find_pii(edge).collect()
    assert len(got) == edge.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty for r in got if r["doc_id"] in (1, 2, 3))
    assert pii.find_pii(none).count() == 0
    assert pii.redact("x a@b.co +1 (222) 333-4444 y") == "x <email> <phone> y" and pii.redact(None) is None


# --- shingles and the Jaccard join ---------------------------------------------------------------------------------


def plain_components(docs, width, num, den):
    sets = {}
    for i, t in docs:
        if i is not None and (w := words(t)):
            sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]))
    up = {i: i for i, _ in docs if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("width, num, den", [(3, 9, 10), (5, 4, 5)])
def test_join_equals_all_pairs(spark, edge, width, num, den):
    r = random.Random(width)
    docs = [(x["doc_id"], x["text"]) for x in edge.select("doc_id", "text").collect()]
    common = [f"c{i}" for i in range(60)]
    for g in range(25):
        base = [r.choice(common) if r.random() < 0.8 else f"r{r.randrange(9999)}" for _ in range(r.randrange(3, 160))]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(common)
            docs.append((1000 + len(docs), " ".join(copy)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = jaccard.join(frame, width, num, den).collect()
    assert len(got) == len(docs)
    wanted = plain_components(docs, width, num, den)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == wanted
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_join_of_nothing(none):
    assert jaccard.join(none).count() == 0


def test_ties_that_fail_lead_to_other_pairs(spark, monkeypatch):
    """A chain in which the group's first set is not linked with all of its ties."""
    docs = [(i, " ".join(f"t{j}" for j in range(i, i + 60))) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == plain_components(docs, 3, 9, 10)


def test_long_lists_in_parts(spark, monkeypatch):
    """Lists dealt out in parts: near copies of one text, a chain through the list, and sets that fail their ties."""
    monkeypatch.setattr(jaccard, "SPLIT", 5)
    monkeypatch.setattr(jaccard, "STEP", 2)
    r = random.Random(11)
    base = [f"b{j}" for j in range(80)]
    docs = [" ".join(base[:k] + [f"x{i}"] + base[k + 1 :]) for i in range(60) for k in [r.randrange(80)]]
    docs += [" ".join(f"t{j}" for j in range(i, i + 60)) for i in range(30)]
    docs += [" ".join(base[: 60 + i % 20] + [f"y{i}z{j}" for j in range(i % 9)]) for i in range(40)]
    r.shuffle(docs)
    numbered = list(enumerate(docs))
    got = {x["doc_id"]: x["component_id"] for x in jaccard.join(spark.createDataFrame(numbered, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == plain_components(numbered, 3, 9, 10)


def test_blocks_ruled_out_hold_no_pair():
    rng = np.random.default_rng(8)
    count = rng.integers(1, 90, 30)
    at = np.cumsum(count) - count
    n, pos = rng.integers(1, 400, int(count.sum())), rng.integers(0, 60, int(count.sum()))
    order = np.lexsort((pos, n, np.repeat(np.arange(30), count)))
    n, pos = n[order], np.minimum(pos[order], n[order] - 1)
    for num, den in ((9, 10), (4, 5)):
        got = {(int(a), int(b)) for x, y in jaccard._pairs(at, count, n, pos, num, den) for a, b in zip(x, y)}
        fine = lambda a, b: n[a] * den >= n[b] * num and min(n[a] - pos[a], n[b] - pos[b]) * (num + den) >= (n[a] + n[b]) * num
        every = {(a, b) for s, c in zip(at.tolist(), count.tolist()) for a in range(s, s + c) for b in range(a + 1, s + c)}
        assert {p for p in every if fine(*p)} <= got <= every and len(got) < 0.7 * len(every)


def test_one_of_each_keeps_columns(spark, edge):
    kept = jaccard.one_of_each(edge, 3, 9, 10)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and 6 not in ids and ids.count(9) == 1 and ids.count(None) == 2 and ids.count(12) in (0, 1, 2)


def test_shingle_keys_do_not_depend_on_the_batch():
    texts = [b"a b c d", b"", b"a b", b"A B", b"x a b c d y"]
    flat, at = split(texts)
    k = WordKeys()
    ids = k.lookup(flat)
    keys, to = shingles(k.keys[ids], at, 3)
    assert np.diff(to).tolist() == [2, 0, 1, 1, 4]
    assert keys[to[2]] == keys[to[3]] and set(keys[to[0] : to[1]]) <= set(keys[to[4] :])


@pytest.mark.parametrize("seed", range(6))
def test_keys_of_a_text_do_not_depend_on_what_was_read_before(seed):
    r = random.Random(seed)
    texts = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 50))).encode() for _ in range(12)]
    counts = Counter(w for t in texts for w in t.split())
    common = np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in counts], np.uint64))
    of = {xxhash.xxh3_64_intdigest(w): n for w, n in counts.items()}
    counted = np.empty(0, np.uint64), common, np.array([16 * of[int(k)] for k in common], np.int64)
    fresh = [jaccard.Order(counted, 3)([t])[0].tolist() for t in texts]
    for limit in (1, 5, 20, 1000):
        order = jaccard.Order(counted, 3, WordKeys(limit))
        for i in [r.randrange(len(texts)) for _ in range(60)]:
            assert order([texts[i]])[0].tolist() == fresh[i]


def test_equal_texts_link_after_a_worker_forgot_its_words(spark):
    second = " the ".join(f"b{i}" for i in range(160_000))
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(150_500))), (2, second), (3, "short text here"), (4, second)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, 3, 9, 10).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


def test_importance_ignores_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, f"text of {i}", True, False, 1) for i in range(20)], "doc_id long, text string, good boolean, quality boolean, toxic int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert importance.resample(docs, labels).count() == 20


# --- mixing --------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, total = {}, sum(sizes.values())
    while True:
        left = [s for s in order if s not in done]
        share = total - sum(done.values())
        t = {s: share * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if t[s] > limit * sizes[s] + 1e-9]
        if not over:
            return done | t
        done |= {s: limit * sizes[s] for s in over}


def test_mix_meets_targets(spark, edge, none):
    r = random.Random(5)
    rows = [(i, "w " * int(r.lognormvariate(4, 1)), r.choice(["a"] * 9 + ["b", "c", "d", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = cube.mix(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    wanted = plain_targets(size)
    by = {i: s for i, _, s in rows}
    taken, count, n = Counter(), Counter(), Counter()
    for x in got:
        s = by[x["doc_id"]]
        assert math.isclose(x["target"], wanted[s], rel_tol=1e-9) and x["source_size"] == size[s] and 0 <= x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
        count[s] += x["copies"]
        n[s] += x["size"] > 0
    for s in size:
        assert abs(taken[s] - wanted[s]) <= 0.02 * wanted[s] + 5
        assert abs(count[s] - n[s] * wanted[s] / size[s]) <= 3
    again = cube.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert cube.mix(edge).count() == edge.count() and cube.mix(none).count() == 0
    assert cube.mixed(edge).columns == edge.columns


def test_many_rounds_of_flights_end(spark, monkeypatch):
    monkeypatch.setattr(cube, "BLOCK", 8)
    rows = [(i, "w " * (1 + i % 97), "ab"[i % 10 == 0]) for i in range(2500)]
    got = cube.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("target").sum("taken").collect()
    assert len(got) == 2 and all(abs(t - n) <= 0.01 * t for t, n in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 400).astype(float)
    p0 = np.full(400, 0.37)
    p = cube.fly(p0, np.stack([size, np.ones(400)], 1), rng.random(400))
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs((p - p0) @ size) < 1e-6 * size.sum() and abs((p - p0).sum()) < 1e-6


# --- language ------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    lattice = langid.Lattice(pieces)
    p = np.concatenate([[1e-7], np.random.default_rng(1).random(len(pieces))])

    def total(text):
        out = 1.0 if not text else 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in pieces:
                out += p[1 + pieces.index(text[:n])] * total(text[n:])
        if text and text[0] not in pieces:
            out += p[0] * total(text[1:])
        return out

    todo = ["abab", "ba", "abc", "cab", "a"]
    parts, first, last, nodes = lattice.edges(todo)
    got = langid.forward(parts, first, nodes, p[:, None])[last, 0]
    assert np.allclose(got, [total("▁" + w) for w in todo], rtol=1e-12)


def test_languages(edge, none):
    got = langid.identify(edge).collect()
    assert len(got) == edge.count()
    truth = {r["doc_id"]: r["lang"] for r in edge.collect() if (r["doc_id"] or 0) >= 100}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert held and all(truth[r["doc_id"]] == r["lang_pred"] for r in held)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)
        if r["doc_id"] in (1, 2, 3, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(none).count() == 0
    kept = langid.recognised(edge)
    assert kept.columns == edge.columns and not {1, 2, 3, 9} & {r["doc_id"] for r in kept.collect()}


# --- language model ------------------------------------------------------------------------------------------------


def test_base_score_is_exact(spark, edge, none, monkeypatch):
    monkeypatch.setattr(bloom_lm, "KNOWN", 50)  # so that most words take the way of the join
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    wanted = sorted((str(i), held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in docs)
    got = bloom_lm.score_documents(edge).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == wanted
    assert all(r["score"] < 0 for r in got)
    assert bloom_lm.score_documents(none).count() == 0


def test_filter_reads_counts_back():
    model = bloom_lm.Filter(64, 64 * 400, {1: 0, 2: 0})
    bits = np.zeros(64 * 64 * 400, bool)
    rng = np.random.default_rng(3)
    keys, counts = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2), rng.integers(1, 300, 3000)
    levels = bloom_lm._levels(counts, 1)
    for j in range(1, levels.max() + 1):
        base, h = model.hashes(1, keys[levels >= j], j)
        for i in range(bloom_lm.HASHES):
            bits[model.place(base, h, i).astype(np.int64)] = True
    model.bits = np.packbits(bits, bitorder="little")
    back = model.probe(1, keys)
    assert (back >= counts / bloom_lm.BASE - 1).all() and np.mean(back <= counts * bloom_lm.BASE + 1) > 0.97
    assert np.mean(model.probe(1, keys + np.uint64(1)) > 0) < 0.1


def test_no_count_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "MOST_BYTES", 2048, raising=False)  # a bound of the whole filter would be met
    r = random.Random(5)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 900}" for _ in range(40))) for i in range(300)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c, pairs = Counter(), Counter()
    for i, t in docs:
        if not held(i):
            c.update([*t.split(), None])
            pairs.update(zip(["", *t.split()], [*t.split(), None]))
    total, n_docs = sum(c.values()) + len(c) + 1, sum(not held(i) for i, _ in docs)
    values = [0.0] + [(lambda own: sum(own) / len(own) if own else 1.0)([k for k in range(1, 9000) if int(math.log(k, 1.5) + 1e-9) == j]) for j in range(22)]
    near = lambda k: values[1 + int(math.log(k, 1.5) + 1e-9)] if k else 0.0

    def wanted(text):
        tokens = [*text.split(), None]
        p = 0.0
        for h, w in zip(["", *tokens], tokens):
            before, both = near(c[h]) if h else n_docs, near(pairs[h, w])
            p += math.log10(0.65 * (near(c[w]) + 1) / total + 0.35 * min(1.0, both / max(before, both, 1)))
        return p

    got = {x["doc_id"]: x["score"] for x in bloom_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(n == 1 for n in pairs.values()) > 500
    # false positives alone, about one in a hundred probes, part the two
    apart = sorted(abs(got[i] - wanted(t)) / 41 for i, t in docs if not held(i))
    assert apart[n_docs // 2] < 0.01, apart[n_docs // 2]


# --- importance ----------------------------------------------------------------------------------------------------


def test_resampling(spark, edge, none):
    rows = [(i, "good words here " * 5 if i % 2 else "bad junk there " * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs, labels, share=0.5).collect()
    chosen = [r["doc_id"] for r in got if r["selected"]]
    assert len(chosen) == 200 and sum(i % 2 for i in chosen) == 200
    assert len(importance.resample(edge, labels).collect()) == edge.count()
    assert importance.resample(none, labels.limit(0)).count() == 0


def test_weights_and_draw_equal_plain_ones(spark):
    """Log-weights, noise and selection against whole numbers of Python; rows that share an id and a text tie."""
    import xxhash

    full = 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    r = random.Random(3)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.8)) % 60}" for _ in range(r.randrange(0, 40)))) for i in range(120)] + [(7, "twice the same"), (7, "twice the same"), (None, "no id"), (500, None)]
    labels = [(i, int(i % 3 == 0), int(i % 15 == 0)) for i in range(100)]
    good = {i for i, q, t in labels if q == 1 and t != 1}
    features = {}
    for _, t in docs:
        k = [xxhash.xxh3_64_intdigest(w.encode()) for w in words(t)]
        features[t] = [mixed(x) >> 50 for x in k] + [mixed((a * 0x9E3779B97F4A7C15 + b) & full) >> 50 for a, b in zip(k, k[1:])]
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(features[t])
        if i in good:
            target.update(features[t])
    n = 1 << 14
    weigh = lambda t: sum(math.log((target[f] + 1) / (target.total() + n)) - math.log((raw[f] + 1) / (raw.total() + n)) for f in features[t])
    noise = lambda i: -math.log(-math.log(((mixed((mixed(((i or 0) + 0x9E3779B97F4A7C15) & full) + 1) & full) >> 11) + 0.5) / 2**53))
    wanted = sorted(((weigh(t) + noise(i), -(2**63) if i is None else i) for i, t in docs), reverse=True)
    last = wanted[math.ceil(0.5 * len(docs)) - 1]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), share=0.5).collect()
    assert len(got) == len(docs)
    keys = sorted((x["gumbel_key"], -(2**63) if x["doc_id"] is None else x["doc_id"]) for x in got)
    assert all(math.isclose(a[0], b[0], rel_tol=1e-9, abs_tol=1e-9) and a[1] == b[1] for a, b in zip(keys, sorted(wanted)))
    assert sum(x["selected"] for x in got) >= math.ceil(0.5 * len(docs)) and all(x["selected"] == (x["gumbel_key"] >= last[0] - 1e-9) for x in got)


def test_kth_largest(spark):
    r = random.Random(2)
    x = [(r.choice([-(2**62), -5, -1, 0, 3, 2**62]) + r.randrange(3), r.randrange(-4, 4)) for _ in range(500)]
    df = spark.createDataFrame(x, "a long, b long")
    for k in (1, 250, 500):
        assert tuple(importance.smallest(df, k, ("a", "b"))) == sorted(x, reverse=True)[k - 1]


# --- SentencePiece -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return spm.Pieces()


def test_ids_equal_the_library(pieces):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary.MODEL)
    r = random.Random(3)
    texts = ["", " ", "\n", "  two  spaces ", "a\nb", " ▁x▁▁y", "😀x", "x \n y", " \n", *(" " * k for k in range(1, 70)), *("a" + " " * k + "日" for k in range(40))]
    texts += ["".join(r.choice("ab  \n_-=é日😀the inon1.,") for _ in range(r.randrange(80))) for _ in range(1500)]
    ids, at = spm.Encoder(pieces)(texts)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert "▁" in t or own == library.encode(t), t
        assert spm.decode(pieces, own) == t


def test_the_mark_as_a_character_comes_back(pieces):
    r = random.Random(4)
    texts = ["▁", "▁▁", " ▁ ", "a▁b", "▁a", "a ▁b", "\n▁", "▁ ", *("".join(r.choice("▁▁ a\né") for _ in range(r.randrange(30))) for _ in range(2000))]
    ids, at = spm.Encoder(pieces)(texts)
    mark = pieces.bytes[list("▁".encode())].tolist()
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert spm.decode(pieces, own) == t
        assert sum(own[k : k + 3] == mark for k in range(len(own))) == t.count("▁")


def test_suffix_array_finds_every_occurrence(pieces):
    text = np.array([2, 1, 2, 1, 3, 0, 1, 2, 0])
    order = spm.suffix_array(text, 4, 3)
    spelling, length = np.array([[1, -1], [1, 2], [2, 1], [3, 3]]), np.array([1, 2, 2, 2])
    low, high = spm.occurrences(text, order, spelling, length)
    assert [sorted(order[a:b].tolist()) for a, b in zip(low, high)] == [[1, 3, 6], [1, 6], [0, 2], []]


def test_encoding_of_edge_rows(edge, none):
    got = spm.encode_documents(edge).collect()
    assert len(got) == edge.count()
    for r in got:
        if r["doc_id"] == 1:
            assert r["ids"] is None and r["exact"] is None
        elif r["doc_id"] is not None:
            assert r["exact"] and r["n_pieces"] == len(r["ids"])
    assert spm.encode_documents(none).count() == 0


# --- media ---------------------------------------------------------------------------------------------------------


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def done(self):
        raw = np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)).tobytes()
        return raw.replace(b"\xff", b"\xff\x00")


def plain_progressive(coef, bands):
    """One component, 8 pixels wide: first scans at bit 1 and refinements, symbol by symbol, with zero runs and end-of-band runs."""
    out, codes, lengths = [], media.AC_CODES, media.AC_LENGTHS
    n = len(coef)

    def scan(first, last, high, low, body):
        out.append(media._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])) + body)

    b, last = Bits(), 0
    for c in coef[:, 0]:
        d = (int(c) >> 1) - last
        last = int(c) >> 1
        s = abs(d).bit_length()
        b.put(media.DC_CODES[s], 4)
        b.put(d if d >= 0 else d + (1 << s) - 1, s) if s else None
    scan(0, 0, 0, 1, b.done())
    for first, end in bands:
        b, run = Bits(), 0

        def flush():
            nonlocal run
            if run:
                r = run.bit_length() - 1
                b.put(codes[r << 4], lengths[r << 4])
                b.put(run - (1 << r), r) if r else None
                run = 0

        for block in coef:
            zeros = 0
            for k in range(first, end + 1):
                v = abs(int(block[k])) >> 1
                if not v:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    b.put(codes[0xF0], lengths[0xF0])
                    zeros -= 16
                s = v.bit_length()
                b.put(codes[zeros << 4 | s], lengths[zeros << 4 | s])
                b.put(v if block[k] > 0 else (1 << s) - 1 - v, s)
                zeros = 0
            run += zeros > 0
        flush()
        scan(first, end, 0, 1, b.done())
    b = Bits()
    for c in coef[:, 0]:
        b.put(int(c) & 1, 1)
    scan(0, 0, 1, 0, b.done())
    for first, end in bands:
        b, run, waiting = Bits(), 0, []

        def flush():
            nonlocal run, waiting
            if run:
                r = run.bit_length() - 1
                b.put(codes[r << 4], lengths[r << 4])
                b.put(run - (1 << r), r) if r else None
                for x in waiting:
                    b.put(x, 1)
            run, waiting = 0, []

        for block in coef:
            new = [k for k in range(first, end + 1) if abs(int(block[k])) == 1]
            stop = new[-1] if new else first - 1
            zeros, mine = 0, []
            for k in range(first, end + 1):
                v = abs(int(block[k]))
                if v >= 2:
                    mine.append(v & 1)
                elif v == 0:
                    if zeros == 15 and k < stop:
                        flush()
                        b.put(codes[0xF0], lengths[0xF0])
                        for x in mine:
                            b.put(x, 1)
                        zeros, mine = 0, []
                    else:
                        zeros += 1
                else:
                    flush()
                    b.put(codes[zeros << 4 | 1], lengths[zeros << 4 | 1])
                    b.put(1 if block[k] > 0 else 0, 1)
                    for x in mine:
                        b.put(x, 1)
                    zeros, mine = 0, []
            if stop < end:
                run += 1
                waiting += mine
        flush()
        scan(first, end, 1, 0, b.done())
    frame = media._segment(0xC2, bytes([8, 8 * n >> 8, 8 * n & 255, 0, 8, 1, 1, 0x11, 0]))
    tables = media._segment(0xDB, b"\0" + b"\1" * 64) + media._segment(0xC4, b"\0" + media.DC_TABLE + b"\x10" + media.AC_TABLE)
    return b"\xff\xd8" + tables + frame + b"".join(out) + b"\xff\xd9"


def test_decoder_on_sparse_progressive_files():
    rng = np.random.default_rng(5)
    made = []
    for n, density in ((1, 0.1), (3, 0.02), (9, 0.3), (20, 0.005), (5, 0.9), (2, 0.0)):
        coef = np.where(rng.random((n, 64)) < density, rng.integers(-40, 41, (n, 64)), 0)
        coef[rng.random((n, 64)) < density / 3] = 1
        coef[:, 0] = rng.integers(-200, 200, n)
        made.append(coef)
    images, got = media.decode_many([plain_progressive(c, [(1, 5), (6, 63)]) for c in made])
    for image, wanted in zip(images, made):
        assert (got[image.first[0] : image.first[0] + len(wanted)] == wanted).all()


def test_payloads_come_back():
    rng = np.random.default_rng(6)
    texts = [b"", b"a", b"x" * 192, b"y" * 193, bytes(range(256)) * 9, rng.bytes(40_001), "é日😀\n".encode() * 300]
    files = media.encode_many([media.pad(t) for t in texts], [len(t) for t in texts])
    images, coef = media.decode_many(files)
    blocks = media.samples(images, coef)
    for t, image in zip(texts, images):
        assert media.payload(image, coef) == media.pad(t)
        tensor = media.rgb(image, blocks)
        assert tensor.shape == (image.height, image.width, 3)


def test_rgb_equals_plain_conversion():
    """Chroma samples repeated over two by two pixels, then the usual formula pixel by pixel."""
    rng = np.random.default_rng(12)
    files = media.encode_many([media.pad(rng.bytes(n)) for n in (5, 700, 3000)], [5, 700, 3000])
    images, coef = media.decode_many(files)
    blocks = media.samples(images, coef).reshape(-1, 8, 8)
    for image in images:
        plane = []
        for first, (w, h) in zip(image.first, image.padded):
            plane.append([[int(blocks[first + (y // 8) * w + x // 8][y % 8][x % 8]) for x in range(8 * w)] for y in range(8 * h)])
        got = media.rgb(image, media.samples(images, coef))
        across, down = (image.sampling[0][i] // image.sampling[1][i] for i in (0, 1))
        for y in range(image.height):
            for x in range(image.width):
                l, b, r = plane[0][y][x], plane[1][y // down][x // across] - 128, plane[2][y // down][x // across] - 128
                plain = (l + 1.402 * r, l - 0.344136286 * b - 0.714136286 * r, l + 1.772 * b)
                assert all(abs(min(255, max(0, p)) - int(g)) <= 1 for p, g in zip(plain, got[y, x]))


def test_inverse_transform():
    rng = np.random.default_rng(7)
    coef = rng.integers(-129, 130, (20, 64)).astype(np.int16)
    image = media.Image(8, 160, first=[0], padded=[(1, 20)], alone=[(1, 20)], quant=[np.ones(64)], sampling=[(1, 1)])
    natural = np.zeros((20, 64))
    natural[:, media.ZIGZAG] = coef
    c = np.array([np.sqrt(0.125)] + [0.5] * 7)
    one = c[:, None] * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16)
    wanted = np.clip(np.einsum("nuv,uy,vx->nyx", natural.reshape(20, 8, 8), one, one) + 128, 0, 255)
    assert np.abs(media.samples([image], coef).reshape(20, 8, 8) - wanted).max() <= 1.5


def test_media_of_edge_rows(edge, none):
    got = media.features(media.store(edge)).collect()
    assert len(got) == edge.count()
    by_text = {}
    texts = {r["doc_id"]: r["text"] for r in edge.collect() if r["doc_id"] not in (None, 12)}
    for r in got:
        if r["doc_id"] in texts:
            raw = media.pad((texts[r["doc_id"]] or "").encode())
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
            assert by_text.setdefault(raw, tuple(r)[1:])[1:] == tuple(r)[2:]
    assert media.features(media.store(none)).count() == 0


def test_tensors_are_rows_of_the_output(edge, none, monkeypatch):
    monkeypatch.setattr(media, "HELD", 1000, raising=False)  # so that a chunk is handed on in parts
    got = media.tensors(media.store(edge)).collect()
    assert len(got) == edge.count()
    for r in got:
        assert len(r["tensor"]) == r["height"] * r["width"] * 3
        means = np.frombuffer(bytes(r["tensor"]), np.uint8).reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (r["height"] * r["width"])
        assert r["feature"] == f"{r['width']}x{r['height']}:{zlib.crc32(r['tensor']):08x}:{'/'.join(map(str, means.tolist()))}"
    assert media.tensors(media.store(none)).count() == 0
    missing = media.tensors(media.store(edge).limit(1).selectExpr("doc_id", "cast(null as binary) as media")).first()
    assert missing["tensor"] is None and missing["feature"] is None


def test_wide_bitmaps_leave_fewer_pairs_to_verify():
    """Of pairs that fall just short of linking, wide bitmaps rule out most that narrow ones leave over; a pair that links is never ruled out."""
    rng = np.random.default_rng(3)
    base, left = rng.integers(0, 1 << 62, 60, np.uint64), {}
    sets = [np.concatenate([np.delete(base, rng.choice(60, k, replace=False)), rng.integers(0, 1 << 62, k, np.uint64)]) for k in rng.integers(1, 5, 200)]
    n = np.full(len(sets), 60)
    a, b = np.triu_indices(len(sets), 1)
    linked = np.array([jaccard._linked(np.sort(sets[i]), np.sort(sets[j]), 4, 5) for i, j in zip(a, b)])
    for times in (1, jaccard.WIDER):
        bitmaps = jaccard._Bitmaps(jaccard._parity(np.concatenate(sets), n, times * jaccard._bits(n)))
        likely = jaccard._likely(a, b, n, np.zeros_like(n), bitmaps, 4, 5)
        assert likely[linked].all()
        left[times] = int((likely & ~linked).sum())
    assert left[1] > 100 and left[jaccard.WIDER] < 0.5 * left[1], left


def test_lists_with_the_same_sets_are_read_once(spark):
    """Only the one whose shingle comes first in the global order, which is that of numbers without a sign, stays; others of the same size do not count as the same."""
    lists = {7: [(1, 5), (2, 5)], 5: [(1, 5), (2, 5)], -3: [(2, 5), (1, 5)], 9: [(1, 5), (2, 5), (3, 5)], 11: [(1, 4), (1, 5)], -8: [(1, 4), (2, 5)]}
    entries = [(t, node, n, 0, len(own)) for t, own in lists.items() for node, n in own]
    kept = jaccard._first_lists(spark.createDataFrame(entries, "token long, node long, n long, pos long, size long")).collect()
    assert {r["token"]: r["size"] for r in kept} == {5: 2, 9: 3, 11: 2, -8: 2}


def test_similarity_join_keeps_little_on_disk(spark, monkeypatch):
    """Sets, lists and entries go as soon as nothing reads them; shuffle files of its queries go with them, and the session is as it was."""
    name, made, put = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], jaccard.materialize
    before, seen = spark.conf.get(name, "false"), set()

    def noted(rows):
        seen.add(spark.conf.get(name))
        made.append(put(rows))
        return made[-1]

    monkeypatch.setattr(jaccard, "materialize", noted)
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijklmnop") + r.choice("qrstuv") for _ in range(60)) for _ in range(5)]
    docs = [(i, base[i % 5] + f" x{i % 7}") for i in range(35)]
    jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()

    def left(rows):
        path = spark._jvm.org.apache.hadoop.fs.Path(rows.inputFiles()[0])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    tables = {tuple(t.columns): left(t) for t in made}
    assert not tables["doc_id", "n", "digest", "prefix", "bitmap", "wide"] and not tables["token", "node", "n", "pos", "size"] and tables["doc_id", "n", "digest", "usable"]
    assert seen == {"true"} and spark.conf.get(name, "false") == before
