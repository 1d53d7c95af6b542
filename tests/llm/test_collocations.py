import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewire.llm import collocations

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, least, top):
    """Brute force by the definition: every phrase, every cut, every longer candidate."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "The", "a", "b", "c-d", "é", "É", "new", "york", "city", "x'y", "\x01", "x y"]
    line = lambda: "".join(r.choice([r.choice(words), "new york city", "of the a b c"]) + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(r.randrange(30)))
    return [(r.choice(["en", "en", "fr", None]), r.choice([line(), line(), "the the the the the the the", None, "", "  ", "new york city"])) for _ in range(n)]


@pytest.mark.parametrize("least,bits", [(2, 1 << 20), (3, 64), (10, 1 << 27)])
def test_equals_brute_force(spark, least, bits):
    rows = texts(least, 300)
    docs = spark.createDataFrame([(l, t, 1, "x", 2, True, "w") for l, t in rows], "lang string, text string, n long, phrase string, words int, before boolean, content string").repartition(6)
    got = collocations.mine(docs, least, 25, bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == plain(rows, least, 25)


def test_edges(spark, edge, none):
    rows = [(x["lang"], x["text"]) for x in edge.collect()]
    assert sorted(tuple(x) for x in collocations.mine(edge, 5).collect()) == plain(rows, 5, 2000)
    assert collocations.mine(none).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_automaton_has_the_classes_of_end_positions(seed):
    r = random.Random(seed)
    ids, run = [0], [0]
    for _ in range(12):
        n = r.randrange(2, 12)
        ids += [0, *(r.randrange(1, 4) for _ in range(n))]
        run += [0, *range(1, n + 1)]
    ids, run = np.array(ids), np.array(run)
    ends = defaultdict(set)
    for i in range(len(ids)):
        for k in range(1, min(5, run[i]) + 1):
            ends[tuple(ids[i - k + 1 : i + 1])].add(i)
    a = collocations.Automaton(ids, run)
    classes = defaultdict(list)
    for k in range(1, 6):
        for j, (e, n, before, after) in enumerate(zip(*a.substrings(k))):
            s = tuple(ids[e - k + 1 : e + 1])
            classes[int(a.state[k - 1][j])].append(s)
            assert n == len(ends[s]) == a.ends[a.state[k - 1][j]]
            assert before == any(len(t) == k + 1 and t[1:] == s and len(ends[t]) == n for t in ends)
            assert after == any(len(t) == k + 1 and t[:-1] == s and len(ends[t]) == n for t in ends)
    assert sum(map(len, classes.values())) == len(ends)
    state_of = {s: c for c, members in classes.items() for s in members}
    by_ends = defaultdict(set)
    for s, e in ends.items():
        by_ends[frozenset(e)].add(s)
    assert {frozenset(m) for m in classes.values()} == {frozenset(m) for m in by_ends.values()}
    for c, members in classes.items():
        longest, shortest = max(members, key=len), min(members, key=len)
        assert len(longest) == a.longest[c]
        assert a.link[c] == (state_of[shortest[1:]] if len(shortest) > 1 else -1)


def test_shards_of_any_size_hold_every_text_once():
    import pyarrow as pa

    rows = texts(1, 80)
    batch = pa.record_batch([pa.array([l or "und" for l, _ in rows]), pa.array([(t or "").encode() for _, t in rows])], ["lang", "content"])
    want = Counter((l or "und", w) for l, t in rows for p in pieces(t) for w in p)
    for size in (1, 100, 1 << 20):
        got = Counter()
        for shard in collocations.shards(iter([batch]), size):
            got.update((shard.lang, shard.words[i].decode()) for i in shard.ids.tolist() if i)
        assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_what_is_left_over_holds_every_frequent_phrase(seed):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdef") for _ in range(r.randrange(9))) for _ in range(60)]
    shard = collocations.Words("en", [t.encode() for t in lines])
    counts = Counter(tuple(w[i : i + k]) for t in lines for w in [t.split()] for k in range(1, 6) for i in range(len(w) - k + 1))
    keys = Counter(shard.pairs()[1].tolist())
    for least in (1, 3, 6):
        filter_ = np.zeros(1 << 10, np.uint64)
        for k, n in keys.items():
            if n >= least:
                bit = k & ((1 << 16) - 1)
                filter_[bit >> 6] |= np.uint64(1 << (bit & 63))
        most = collocations.left_over(shard, filter_)
        names = [w.decode("utf-8", "replace") for w in shard.words]
        left = {tuple(names[i] for i in shard.ids[e - k + 1 : e + 1]) for e in range(len(most)) for k in range(2, min(5, most[e]) + 1)}
        assert {p for p, n in counts.items() if len(p) > 1 and n >= least} <= left
        assert all(most[1:][most[1:] > 2] <= most[:-1][most[1:] > 2] + 1)
        if least == 6:
            assert len(left) < sum(len(p) > 1 for p in counts)
