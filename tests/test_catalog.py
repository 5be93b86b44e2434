"""Every core query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillon.plans import catalog


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tzinfo") and v.tzinfo:
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v if v is None or isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, data, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    rel = sql.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())


def test_streaming_intake(spark, tmp_path):
    from quillon.streaming import landing

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Note interne sur la morsure de chien.")
    (inbox / "b.zip").write_bytes(b"x")
    matters = spark.createDataFrame([("m1", "c1", "Morsure de chien", None, None)], "id string, client_id string, name string, responsible string, created_at timestamp")
    got = {}
    q = landing.take_in(spark, f"file://{inbox}", f"file://{tmp_path}/ck", lambda: matters, "u", lambda new, _: got.update({k: v.collect() for k, v in new.items()}))
    q.awaitTermination(120)
    assert {(r["filename"], r["status"], r["matter_id"]) for r in got["documents"]} == {("a.txt", "indexed", "m1"), ("b.zip", "error", None)}
    assert len(got["pages"]) == len(got["alerts"]) == 1 and len(got["audit_logs"]) == 2


def test_streaming_landing(spark, tmp_path):
    from quillon.streaming import landing

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("bonjour le monde")
    got = []
    q = landing.watch(spark, f"file://{inbox}", f"file://{tmp_path}/ck", lambda df, _: got.extend(r["status"] for r in df.collect()))
    q.awaitTermination(60)
    assert got == ["indexed"]
