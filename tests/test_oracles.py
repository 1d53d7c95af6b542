"""Every registered query of the main library against its SQL in DuckDB, on the small tables."""

import glob
import os

import pandas as pd
import pytest

from tidewire.plans import cycle_queries, more_queries, ops_queries, record_queries, signal_queries, source_queries, stream_queries

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = signal_queries.QUERIES | ops_queries.QUERIES | source_queries.QUERIES | more_queries.QUERIES | record_queries.QUERIES | cycle_queries.QUERIES | stream_queries.QUERIES
ORACLES = signal_queries.ORACLES | ops_queries.ORACLES | source_queries.ORACLES | more_queries.ORACLES | record_queries.ORACLES | cycle_queries.ORACLES | stream_queries.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else repr(round(float(v), 9)) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_every_order_has_a_message(spark):
    orders = {r[0] for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    got = [r["folder_id"] for r in QUERIES["q_enrichment_payload_all"](spark, DATA).collect()]
    assert orders <= set(got) and len(got) == len(set(got))


def test_editorial_hash_on_odd_texts(spark, tmp_path):
    """Blanks of all kinds, empty and null titles and languages: the digests are those of the SQL."""
    marks = [chr(c) for c in (*range(0x20), 0x22, 0x5C, 0x7F, 0x85, 0xA0, 0x1680, 0x2007, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x1F600)]
    texts = ["", " ", "\nx", None, *(x for m in marks for x in (f"a{m}{m}b", f"{m}ab", f"ab {m}", m))]
    some = [(t, "en") for t in texts] + [("a b", x) for x in ("", " ", None, "EN", " e  n ", "e\u00a0n", "\u0130")]
    docs = [(3 * i + k, text, lang, "s", 0) for i, (text, lang) in enumerate(some) for k in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    mine = {r["seq"]: r["digest"] for r in QUERIES["q_editorial_hash"](spark, str(tmp_path)).collect()}
    theirs = dict(con.execute(ORACLES["q_editorial_hash"]).fetchall())
    assert len(theirs) == len(docs) and {d[0]: d[1:3] for d in docs if mine[d[0]] != theirs[d[0]]} == {}
