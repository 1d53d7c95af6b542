import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewire.llm import alignment, vocabulary

A = Tokenizer.from_file(alignment.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=vocabulary.MODEL)
TOOLS = alignment.Tokenizers(*alignment._read(alignment.BYTE_BPE, vocabulary.MODEL))
BYTES_A, BYTES_B = ([bytes(x.buffer[a : a + n]) for a, n in zip(x.start.tolist(), x.length.tolist())] for x in (TOOLS.spelling_a, TOOLS.spelling_b))
NONE = (0, 0, 0, 0, 0, 0, "")


def plain_ids(text):
    """Whole texts through the libraries; None without tokens."""
    if not text:
        return None
    a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    raw = f" {text}".encode()
    return (a, b) if b"".join(BYTES_A[i] for i in a) == raw == b"".join(BYTES_B[i] for i in b) else None


def plain(texts):
    """Brute force: every A token against every B token of a text."""
    def spans(ids, raw):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(raw[i]), i))
            at += len(raw[i])
        return out

    links, groups, total = [], [], Counter()
    for text in texts:
        ids = plain_ids(text)
        if ids is None:
            links.append(None)
            groups.append(None)
            continue
        x, y = spans(ids[0], BYTES_A), spans(ids[1], BYTES_B)
        links.append([(p, q) for s, e, p in x for u, v, q in y if s < v and u < e])
        total.update(links[-1])
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups.append([([p for s, e, p in x if b < e <= c], [q for s, e, q in y if b < e <= c]) for b, c in zip([0, *ends], ends)])
    best = {}
    for (_, q), n in total.items():
        best[q] = max(best.get(q, 0), n)
    out = []
    for text, link, group in zip(texts, links, groups):
        if link is None:
            out.append(NONE)
            continue
        spelled = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in group)
        a, b = plain_ids(text)
        out.append((len(a), len(b), len(group), len(link), sum(total[k] == best[k[1]] for k in link), sum(total[k] for k in link), hashlib.sha256(spelled.encode()).hexdigest()))
    return out, total


TEXTS = [
    None, "", " ", "  ", "\n", "\n\n a", "one", "One two  three", " lead and trail ", "line\nline\n\nline \n x", "tab\tand\r\nreturn", "don't we'll  it's", "日本語 の テキスト", "naïve café — “quoted”", "😀👍🏽 é", "▁mark", "a▁b",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "x" * 3000, "0x1f 12345 3.14", "a b   c", "\x1c x \x00 y", "same words same words", "same words same words", "a ́b", "ﬁ ½ Å",
]


def test_equals_brute_force(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice(["a", "b", " ", "\n", "the ", "ing", "é", "1", ".", "'s", "　", "\t"]) for _ in range(r.randrange(80))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in enumerate(texts)], "doc_id long, text string, n long, key string, b long, groups string").repartition(5)
    want, total = plain(texts)
    aligner = alignment.Aligner(docs)
    got = {x["doc_id"]: tuple(x)[1:] for x in aligner.align(groups=True).collect()}
    assert [got[i][:-1] for i in range(len(texts))] == want
    assert all(hashlib.sha256(g[-1].encode()).hexdigest() == g[-2] for g in got.values() if g[0])
    assert {(x["a"], x["b"]): x["n"] for x in aligner.pairs().collect()} == total


def test_edges(spark, edge, none):
    rows = edge.select("doc_id", "text").collect()
    want, _ = plain([x["text"] if len(x["text"] or "") < 5000 else None for x in rows])
    got = alignment.align(edge.filter("text is null or length(text) < 5000").unionByName(edge.filter("length(text) >= 5000").withColumn("text", edge["text"].substr(1, 0)))).collect()
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(str((x["doc_id"], *w)) for x, w in zip(rows, want))
    assert alignment.align(none).count() == 0
    assert [tuple(x)[1:] for x in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()] == [NONE, NONE]
    long = {x["doc_id"]: x for x in alignment.align(edge.filter("length(text) > 5000")).collect()}
    text = {x["doc_id"]: x["text"] for x in edge.filter("length(text) > 5000").collect()}
    for i, t in text.items():
        a, b = plain_ids(t)
        assert (long[i]["n_a"], long[i]["n_b"]) == (len(a), len(b))


@pytest.mark.parametrize("seed", range(4))
def test_units_give_the_ids_of_whole_texts(seed):
    r = random.Random(seed)
    parts = [" ", "  ", "\n", " \n", "\t", "\x85", " ", "\x1d", "a", "The", "'ll", "12", "é", "語", "😀", ".", "́", "\r", "zz", "­", "<s>"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        cuts = alignment.cut(text)
        a, b = TOOLS.encode(cuts)
        whole = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
        assert [i for x in a for i in x] == whole[0], repr(text)
        assert [i for x in b for i in x] == whole[1], repr(text)


def test_forgetting_units_changes_nothing():
    r = random.Random(0)
    texts = [" ".join(r.choice(["the", "of", "house", "ing", "x1"]) + str(r.randrange(9)) for _ in range(20)) for _ in range(30)]
    forgetful, steady = alignment.Units(TOOLS, 3), alignment.Units(TOOLS)
    for t in texts * 2:
        if forgetful.full():
            forgetful.clear()
        one, two = (k([t])[0] for k in (forgetful, steady))
        assert [forgetful.groups[u] for u in one] == [steady.groups[u] for u in two]


def test_bytes_of_ids_are_those_of_the_libraries():
    import base64

    ranks = {int(n): base64.b64decode(t) for t, n in (line.split() for line in open(alignment.BYTE_BPE.replace(".json", ".tiktoken"), "rb"))}
    assert {i: b for i, b in enumerate(BYTES_A) if b} == ranks
    for i in range(3, 2000):
        assert BYTES_B[i].decode("utf-8", "replace").lstrip(" ") == B.decode([i]).lstrip(" ")


def test_runs_are_added_up_across_batches():
    batches = [pa.record_batch([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "n"]) for k, n in (([1, 1, 2], [1, 2, 3]), ([], []), ([2], [4]), ([2, 5], [1, 1]), ([5, 9], [1, 1]))]
    got = [(k, n) for ks, ns in alignment.runs(iter(batches)) for k, n in zip(ks.tolist(), ns.tolist())]
    assert got == [(1, 3), (2, 8), (5, 2), (9, 1)]


def test_empty_shards():
    assert alignment.Shards([]).counts(np.array([1, 2])).tolist() == [0, 0]
