"""Relational operators on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from genloom import functions
from genloom.operators import grouping, jobs, sites, tables, unify
from genloom.sources.catalog import Store, open_store, resolve_field, write_store
from genloom.sources.filters import filter_variants, select_samples, to_sql


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def runs_of(positions, gap):
    out = []
    for p in sorted(positions):
        if out and p - out[-1][-1] <= gap:
            out[-1].append(p)
        else:
            out.append([p])
    return [(r[0], r[-1] + 1) for r in out]


@pytest.mark.parametrize("gap", [0, 7, 30, 900_000, 5_000_000])
def test_intervals(spark, gap):
    rng = random.Random(gap)
    scale = max(10, 3 * gap)
    positions = sorted({rng.randrange(scale) + rng.choice([0, gap, 4 * scale, 9 * scale]) for _ in range(60)} | {0, gap, 2 * gap + 1})
    df = spark.createDataFrame([(p,) for p in positions], "position long")
    assert rows(sites.sequence_intervals(df, gap), "start", "end") == runs_of(positions, gap)
    numbered = rows(sites.with_interval(df.withColumn("more", F.lit(1)), gap), "position", "interval_idx")
    spans = runs_of(positions, gap)
    assert numbered == [(p, next(k for k, (a, b) in enumerate(spans) if a <= p < b)) for p in positions]
    assert rows(sites.sequence_intervals(df.where("false"), gap), "start", "end") == []


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1, ["A", "", ""]), (1 << 16, ["", "T", ""]), (None, []), (65537, [""])], "flags int, alleles array<string>")
    told = df.select(functions.is_sample("flags").alias("s"), functions.is_compressed("flags").alias("c"), functions.without_padding("alleles").alias("a"), functions.ancestor_name("flags").alias("n")).collect()
    assert [tuple(r) for r in told] == [(True, False, ["A"], "a1"), (False, True, ["", "T"], "a65536"), (False, False, [], None), (True, True, [], "a65537")]


def test_position_sets(spark):
    df = spark.createDataFrame([(100,), (200,), (300,), (400,)], "position int")
    spans = spark.createDataFrame([(150, 450)], "start int, end int")
    inside = sites.in_intervals(df, spans, 100)
    assert rows(unify.exclude_positions(inside, df.where("position = 300")), "position") == [(200,), (400,)]
    assert rows(unify.unique_positions(spark.createDataFrame([(100,), (100,), (200,)], "position int")), "position") == [(200,)]


def source(spark, data):
    return spark.createDataFrame(data, "position int, alleles array<string>, calls array<tinyint>")


def test_unify(spark):
    a = source(spark, [(100, ["A", "T"], [1]), (300, ["C", "G"], [0])])
    b = source(spark, [(200, ["A", "G"], [0]), (300, ["C", "G"], [1])])
    notes = spark.createDataFrame([(100, "A"), (200, "A"), (300, "C")], "position int, ancestral_allele string")
    out = unify.unified([(a, a, 1), (b, b, 1)], notes)
    assert rows(out, "position", "codes") == [(100, [1, -1]), (200, [-1, 0]), (300, [0, 1])]
    filtered = unify.unified([(a.where("position > 100"), a, 1), (b, b, 1)], notes)
    assert rows(filtered, "position", "codes")[0] == (100, [-1, -1])


def test_unify_alleles_and_duplicates(spark):
    a = source(spark, [(100, ["A", "T"], [1, 0]), (200, ["A", "T"], [1, 0]), (200, ["A", "T"], [0, 1])])
    b = source(spark, [(100, ["G", "A", ""], [0]), (200, ["A", "C"], [-1])])
    notes = spark.createDataFrame([(100, "A"), (200, "X")], "position int, ancestral_allele string")
    out = unify.unified([(a, a, 2), (b, b, 1)], notes)
    assert rows(out, "position", "dictionary", "codes") == [(100, ["A", "T", "G"], [1, 0, 2]), (200, ["X", "A", "T", "C"], [-1, -1, -1])]


def test_stats(spark):
    df = spark.createDataFrame([(1, "A", ["A", "T"], [-1, 1, 0, 0]), (2, "A", ["A", "T"], [0, 0, 0, 0]), (3, "A", ["A", "T"], [1, 2, 1, -1]), (4, "A", ["A"], [-1] * 4)], "position int, ancestral string, dictionary array<string>, codes array<tinyint>")
    out = sites.inference_sites(df, 4)
    assert rows(out, "position", "derived", "called", "time", "calls") == [(1, 1, 3, 0.25, [-1, 1, 0, 0])]


def test_fields(spark):
    base = spark.createDataFrame([("s0", 2.0), ("s1", 3.0)], "sample_id string, age double")
    other = spark.createDataFrame([("s0", 1.0, 0), ("s0", 7.0, 1)], "sample_id string, t double, k int")
    assert resolve_field(base, "sample_id", None, "x").columns == base.columns
    assert rows(resolve_field(base, "sample_id", "age", "x"), "x") == [(2.0,), (3.0,)]
    assert rows(resolve_field(base, "sample_id", 4, "x"), "x") == [(4,), (4,)]
    assert rows(resolve_field(base, "sample_id", {"path": other, "field": "t"}, "x", fill=-1.0, order="k"), "sample_id", "x") == [("s0", 7.0), ("s1", -1.0)]
    with pytest.raises(ValueError, match="path and field"):
        resolve_field(base, "sample_id", {"path": other}, "x")
    with pytest.raises(TypeError):
        resolve_field(base, "sample_id", ["age"], "x")


def test_filters(spark):
    v = spark.createDataFrame([(100, 5.0, ["A", "T"], "PASS", "1"), (200, 50.0, ["A", "TT"], "q10", "1"), (300, 40.0, ["A", "T", "G"], None, "2")], "position int, qual double, alleles array<string>, filter string, contig_id string")
    pick = lambda **k: [r[0] for r in rows(filter_variants(v, **k), "position")]
    assert pick(include="POS=100 | POS==300") == [100, 300]
    assert pick(include="TYPE='snp' && N_ALT=1") == [100]
    assert pick(include="!(QUAL < 45) & POS >= 200") == [200]
    assert pick(exclude="FILTER != 'PASS'") == [100, 300]
    assert pick(regions="1:100-150") == [100]
    assert pick(targets="1,2:1-") == [100, 200, 300]
    for bad in ("POS >", "POS = 1 )", "NOPE = 1", "POS ~ 1"):
        with pytest.raises(ValueError):
            to_sql(bad, v.columns)


def test_samples(spark):
    s = spark.createDataFrame([(0, "s0", 1), (1, "s1", 2), (2, "s2", 1)], "sample_idx int, sample_id string, ploidy int")
    assert rows(select_samples(s, "^s1"), "sample_id") == [("s0",), ("s2",)]
    with pytest.raises(ValueError, match="no such samples"):
        select_samples(s, "s0,nobody")
    v = spark.createDataFrame([(100, ["A", "T"], [0, 1, 1, 0], "1")], "position int, alleles array<string>, calls array<tinyint>, contig_id string")
    cut = Store(v, s, 1000).of_samples("s0,s1")
    assert rows(cut.variants, "calls") == [([0, 1, 1],)]
    assert cut.haplotypes() == 3


def test_store_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(0, "s0", 1)], "sample_idx int, sample_id string, ploidy int")
    v = spark.createDataFrame([(100, ["A", "T"], [1], "1")], "position int, alleles array<string>, calls array<tinyint>, contig_id string")
    write_store(Store(v, s, 1000), str(tmp_path / "store"))
    back = open_store(str(tmp_path / "store"), spark)
    assert back.length == 1000
    assert rows(back.variants, "position", "calls") == [(100, [1])]
    assert open_store(back) is back
    with pytest.raises(Exception, match="exists"):
        write_store(back, str(tmp_path / "store"))


@pytest.mark.parametrize(
    ("start", "end", "time", "merged"),
    [
        ([0, 0], [1, 1], [1.0, 0.0], {(0, 1, 0.0), (0, 1, 1.0)}),
        ([0, 0], [1, 1], [0.0, 0.0], {(0, 1, 0.0)}),
        ([1, 0], [3, 2], [0.5, 0.5], {(0, 3, 0.5)}),
        ([0, 1, 3], [5, 2, 4], [0.0] * 3, {(0, 5, 0.0)}),
        ([0, 1, 2], [1, 2, 3], [0.0] * 3, {(0, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0)}),
        ([2, 3, 5, 1, 2, 1, 1, 2], [4, 6, 6, 3, 3, 2, 3, 3], [4.0, 4, 4, 1, 1, 2, 3, 3], {(1, 3, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 6, 4.0)}),
    ],
)
def test_merge_and_group(spark, start, end, time, merged):
    df = spark.createDataFrame(list(zip(range(len(start)), start, end, map(float, time))), "ord int, start int, end int, time double")
    out = grouping.merge_spans(df)
    assert set(rows(out, "merged.start", "merged.end", "merged.time")) == merged
    import numpy as np

    expected = grouping.group_spans(np.array(start), np.array(end), np.array(time))
    assert rows(grouping.assign_groups(df), "ord", "grp") == list(enumerate(expected.tolist()))


def test_jobs(spark):
    s = spark.createDataFrame([(0, "a", 0, "x", 2), (1, "b", 0, "x", 1)], "source_ord int, source string, sample_idx int, sample_id string, ploidy int")
    h = jobs.haplotype_rows(s)
    assert rows(h, "haplotype_index", "source", "sample_id", "ploidy_index") == [(0, "a", "x", 0), (1, "a", "x", 1), (2, "b", "x", 0)]
    there = spark.createDataFrame([("a", 0, "s1", 0, 1), ("a", 0, "s0", 0, 0), ("b", 1, "s0", 0, 5)], "source string, source_ord int, sample_id string, ploidy_index int, column int")
    wanted = spark.createDataFrame([("a", "s1", 0), ("z", "s0", 0), ("a", "none", 0)], "source string, sample_id string, ploidy_index int")
    assert rows(jobs.permutation(wanted, there), "sample_id", "column") == [("none", -1), ("s0", 0), ("s1", 1)]


def test_tables(spark):
    e = spark.createDataFrame([(0.0, 50.0, 9, 0), (50.0, 100.0, 9, 0), (20.0, 30.0, 9, 1)], "left double, right double, parent long, child long")
    assert rows(tables.squashed(e), "left", "right", "parent", "child") == [(0.0, 100.0, 9, 0), (20.0, 30.0, 9, 1)]
    spans = spark.createDataFrame([(10.0, 25.0), (90.0, 300.0)], "start double, end double")
    assert rows(tables.clipped(e, spans, 10), "left", "right", "child") == [(10.0, 25.0, 0), (20.0, 25.0, 1), (90.0, 100.0, 0)]
    at = spark.createDataFrame([(25.0,), (60.0,)], "position double")
    assert rows(tables.parents_at(e, at, 10), "position", "child", "parent") == [(25.0, 0, 9), (25.0, 1, 9), (60.0, 0, 9)]


def test_compression_matches_kernel(spark):
    from genloom.operators.treekernel import Graph

    g = Graph(100.0)
    for flags, time in ((1, 0), (1, 0), (1, 0), (0, 1), (0, 2), (0, 2)):
        g.add_node(time, flags)
    g.edges = [(0.0, 50.0, 4, 0), (50.0, 100.0, 5, 0), (0.0, 50.0, 4, 1), (50.0, 100.0, 5, 1), (0.0, 100.0, 3, 2)]
    out = g.compress()
    edges = spark.createDataFrame(g.edges, "left double, right double, parent long, child long")
    nodes = spark.createDataFrame(list(zip(range(6), g.time, g.flags)), "id long, time double, flags int")
    e, n = tables.compressed(edges, nodes)
    assert rows(e, "left", "right", "parent", "child") == sorted(out.edges)
    assert rows(n, "id", "time") == list(enumerate(out.time))


def test_histogram(spark):
    j = spark.createDataFrame([(0, "a", 0, 0, 2000), (0, "a", 1, 0, 4000), (1, "a", 0, 0, 1000)], "group int, source string, sample_chunk int, start_position int, end_position int")
    assert rows(jobs.histogram(j), "group", "n", "chunks", "mean_kb", "var_kb", F.length("bar")) == [(0, 2, 2, 3.0, 1.0, 60), (1, 1, 1, 1.0, 0.0, 30)]
