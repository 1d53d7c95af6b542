import base64
import gzip
import hashlib
import io
import os
import random
import zlib

import pytest

from tidewire.llm import stores, warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, n_bytes long, sha1 string, salt long, first long, least long, revisit boolean"
LONG = "<p>" + "very long text " * 200_000
PAGES = [(7, "http://a/", "same"), (3, "http://b/\r\nWARC-Type: x", "same"), (9, None, "same"), (None, "http://c/é x", "same"), (4, "", None), (2, "u", ""), (5, "u", "own ü\r\n\r\nWARC/1.1\r\n"), (5, "u", "own ü\r\n\r\nWARC/1.1\r\n"), (None, "v", "no id"), (None, "w", "no id"), (-6, "x", LONG), (8, "y", LONG), (5, "z", "another page of this id")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, *[None] * 8) for i, u, h in PAGES], SCHEMA).repartition(3)


def plain(pages, least):
    """Brute force: all pages against all."""
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        ids = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        first = min(ids) if ids and len(data) >= least else None
        revisit = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archived_equals_brute_force(pages, least):
    got = warc.archived(pages, least).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(PAGES, least) and all(r["verified"] for r in got)


def test_payloads_come_back(spark, pages):
    path = stores.fresh(spark)
    warc.write(pages, path, archive_bytes=100)
    rows = warc.read(spark, path).collect()
    stored = {r["payload"] for r in rows if r["record_type"] == "response"}
    assert {bytes(p) for p in stored} == {(h or "").encode() for _, _, h in PAGES}
    ids = {r["record_id"] for r in rows if r["record_type"] == "response"}
    assert all(r["refers_to"] in ids and not r["payload"] for r in rows if r["record_type"] == "revisit")
    warc.write(pages.limit(1), path)
    assert warc.read(spark, path, payload=False).count() == len(PAGES) + 1


def test_one_member_a_record(spark, pages):
    path = stores.fresh(spark)
    warc.write(pages, path)
    fs, folder = stores.located(path)
    n = 0
    for name in os.listdir(folder):
        if name.endswith(".warc.gz"):
            rest = open(f"{folder}/{name}", "rb").read()
            whole = gzip.decompress(rest)
            parts = []
            while rest:
                d = zlib.decompressobj(31)
                parts.append(d.decompress(rest))
                rest = d.unused_data
            assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts) and b"".join(parts) == whole
            n += len(parts)
    assert n == len(PAGES)


def test_archives_of_tasks_that_did_not_commit_are_not_read(spark, pages):
    path = stores.fresh(spark)
    warc.write(pages, path)
    fs, folder = stores.located(path)
    with open(f"{folder}/lost.warc.gz", "wb") as f:
        f.write(warc.member(warc.record(1, "u", b"x", warc.sha1(b"x"), 1, None, False, "d"))[:-9])
    assert warc.read(spark, path).count() == len(PAGES)


def test_empty_table(spark, pages):
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 2, 7, 64, 1 << 18])
def test_sequential_reading_in_any_steps(step):
    r = random.Random(step)
    payloads = [r.randbytes(r.randrange(300)) for _ in range(20)] + [b"", b"\r\n\r\n" * 50]
    raw = b"".join(warc.member(warc.record(i, "u", p, warc.sha1(p), len(p), None, False, "d")) for i, p in enumerate(payloads))
    got = list(warc.records(io.BytesIO(raw), step))
    assert [x.payload for x in got] == payloads and all(x.verified for x in got)


def test_members_that_hold_several_records_or_parts_of_one():
    raw = b"".join(warc.record(i, "u", b"p" * i, warc.sha1(b"p" * i), i, None, False, "d") for i in range(9))
    for cuts in ([0], [0, 10, 400, 1000], [0, 333]):
        data = b"".join(warc.member(raw[a:b]) for a, b in zip(cuts, [*cuts[1:], len(raw)]))
        assert [x.n_bytes for x in warc.records(io.BytesIO(data))] == list(range(9))


def test_broken_archives():
    whole = warc.record(1, "u", b"payload", warc.sha1(b"payload"), 7, None, False, "d")
    for bad in (whole.replace(b"payload", b"pAyload"), whole.replace(b"Content-Length: 7", b"Content-Length: 8")):
        assert [x.verified for x in warc.records(io.BytesIO(warc.member(bad)))] == [False]
    for bad in (warc.member(whole)[:-12], warc.member(whole[:-5]), warc.member(b"x" + whole), warc.member(whole[:60]), warc.member(whole + b"GET")):
        with pytest.raises((warc.Broken, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


def test_a_digest_that_differs_is_an_error_only_if_strict(spark, tmp_path):
    whole = warc.record(1, "u", b"payload", warc.sha1(b"payload"), 7, None, False, "d").replace(b"payload", b"pAyload")
    (tmp_path / "a.warc.gz").write_bytes(warc.member(whole))
    assert [r["verified"] for r in warc.read(spark, str(tmp_path), strict=False).collect()] == [False]
    with pytest.raises(Exception, match="digests of"):
        warc.read(spark, str(tmp_path)).collect()
