"""Every query of the store against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from stratakv.operators.lru import Cache
from stratakv.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(table):
    columns = sorted(table.column_names)
    return sorted(map(repr, zip(*[table[c].to_pylist() for c in columns], strict=True)))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toArrow(), duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_byte_limited_caches_match_a_plain_simulation(spark):
    log = catalog.sharded_log(spark, DATA).orderBy("shard", "seq").collect()
    want, caches = [], {}
    for r in log:
        c = caches.setdefault(r.shard, Cache(catalog.LRU_BYTES))
        hit, evicted = c.step(r.op, r.key, r["size"], False)
        want.append((r.shard, r.seq, hit, ",".join(evicted), c.size))
    got = catalog.QUERIES["q19_lru_bytes"](spark, DATA).orderBy("shard", "seq").collect()
    assert [(r.shard, r.seq, r.hit, r.evicted, r.bytes) for r in got] == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "value", "created_at", "ttl_secs"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
