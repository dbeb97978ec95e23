"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest
from test_kernels import slow_ancestor

import __spark_entry__ as entry
from genloom.operators.ancestors import descriptors
from genloom.plans import queries
from genloom.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:  # the inferred tables: their own test decodes them
        assert name == "q32_full_pipeline"
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_driver_rows_in_columns(spark, monkeypatch):
    """Rows of the driver become a table by lots, in order, and rates of a haplotype are no number for each site."""
    from genloom.operators import lshmm, matching

    rows = [(k, ["F", "O"][: k % 3]) for k in range(25)]
    for lot in (4, 25, 100):
        assert [tuple(r) for r in queries._framed(spark, iter(rows), "position int, decoded array<string>", lot).collect()] == rows
    assert queries._framed(spark, iter([]), "position int, decoded array<string>").count() == 0
    seen = []
    monkeypatch.setattr(lshmm, "match", lambda p, codes, lo, hi, rho, mu: seen.extend((rho, mu)) or [])
    matching.match_codes(None, np.zeros((3, 1000), np.int8), np.full(3, 0.1), np.full(3, 0.2))
    assert all(r.shape == (3, 1000) and r.strides[1] == 0 for r in seen)


def test_many_driver_rows_become_files(spark, monkeypatch):
    """Of more rows than a few lots, the driver never holds all, nor makes them objects of Spark's."""
    from genloom import session

    monkeypatch.setattr(session, "LOCAL_BYTES", 1)
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda s, rows, *a, **k: made.append(rows.num_rows) or create(s, rows, *a, **k))
    rows = [(k, ["F", "O"][: k % 3]) for k in range(25)]
    found = queries._framed(spark, iter(rows), "position int, decoded array<string>", 4, 4)
    assert max(made) <= 8 and sum(made) == 25
    assert "LocalTableScan" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in found.collect()) == rows


def test_inferred_tables(spark):
    """Genotypes read off the tables of q32, by their edges and mutations alone, are those that went in."""
    rows = QUERIES["q32_full_pipeline"](spark, DATA).collect()
    kinds = {k: [r for r in rows if r["kind"] == k] for k in ("node", "edge", "site", "mutation")}
    samples = [r["id"] for r in sorted(kinds["node"], key=lambda r: r["id"]) if int(r["x"]) & 1]
    told = {}
    for site in kinds["site"]:
        parent = {int(e["value"]): e["parent"] for e in kinds["edge"] if e["x"] <= site["x"] < e["y"]}
        mine = {}
        for m in sorted((m for m in kinds["mutation"] if m["x"] == site["id"]), key=lambda m: m["id"]):
            mine[int(m["y"])] = m["value"]
        out = []
        for u in samples:
            while u in parent and u not in mine:
                u = parent[u]
            out.append(mine.get(u, site["value"]))
        told[int(site["x"])] = out
    want = {r["position"]: ["FO"[c] for c in r["calls"]] for r in queries._small(spark, DATA)[0].collect()}
    assert told == want


def test_ancestors_of_the_skin(spark):
    """q29 over the whole skin against the slow rules, beside its SQL."""
    rows = queries._sites4(spark, DATA).orderBy("position").collect()
    calls = np.array([r["calls"] for r in rows], np.int8)
    times, position = np.array([r["time"] for r in rows]), [r["position"] for r in rows]
    want = []
    for focal in descriptors(calls, times):
        slow = slow_ancestor(calls, times, focal)
        a, b = min(slow), max(slow)
        want.append((times[focal[0]], position[a], position[b] + 1, ",".join(str(position[f]) for f in focal), "".join({-1: "FF", 0: "00", 1: "01"}[slow[s]] for s in range(a, b + 1))))
    got = QUERIES["q29_make_ancestors"](spark, DATA).drop("interval_idx").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
