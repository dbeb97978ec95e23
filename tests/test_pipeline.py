"""End to end: what goes in comes out."""

import json

import pytest

from genloom.cli import main
from genloom.config import Config
from genloom.operators import unify
from genloom.plans import pipeline, runner
from genloom.sources.catalog import Store, write_store

NINE = ["01010101", "01011001", "01100101", "01101010", "01010110", "10011010", "10100110", "10101001", "10010101", "10011001"]


def store(spark, calls, alleles, positions=None, length=1000, ids="s", ploidy=1):
    positions = positions or [100 * (k + 1) for k in range(len(calls))]
    v = spark.createDataFrame([(p, list(a), list(map(int, c)), "1") for p, a, c in zip(positions, alleles, calls)], "position int, alleles array<string>, calls array<tinyint>, contig_id string")
    n = len(calls[0]) // ploidy
    return Store(v, spark.createDataFrame([(k, f"{ids}{k}", ploidy) for k in range(n)], "sample_idx int, sample_id string, ploidy int"), length)


def notes(spark, pairs):
    return spark.createDataFrame(pairs, "position int, ancestral_allele string")


def decoded(g):
    return {int(x): a for x, a in g.genotypes()}


def expected(s, positions=None):
    return {r["position"]: [r["alleles"][c] for c in r["calls"]] for r in s.variants.collect() if positions is None or r["position"] in positions}


@pytest.mark.parametrize(
    ("calls", "alleles", "ancestral"),
    [
        ([[0, 1], [1, 0]], ["AT", "CG"], "AC"),
        ([[0, 1, 1], [0, 0, 1], [1, 0, 1]], ["AT", "CG", "AT"], "ACA"),
        ([[0, 1, 1], [0, 1, 2], [1, 0, 1]], ["AT", "CGT", "AT"], "ACA"),
        ([[0, 1, 1, 0], [0, 0, 0, 1], [0, 1, 2, 0], [1, 0, 0, 1]], ["AT", "CG", "CGT", "AT"], "ACCA"),
        ([[0, 1, 1], [0, 0, 0], [1, 0, 1]], ["AT", "CG", "AT"], "ACA"),
        ([[0, 1, 1], [1, 1, 1], [1, 0, 1]], ["AT", "CG", "AT"], "ACA"),
        ([[0, 1, 1, 0], [1, 1, 1, 0], [1, 0, 0, 1]], ["AT", "TA", "AT"], "AAA"),
    ],
)
def test_round_trip(spark, calls, alleles, ancestral):
    s = store(spark, calls, alleles)
    g = pipeline.infer(spark, {"s": s}, notes(spark, [(100 * (k + 1), a) for k, a in enumerate(ancestral)]), augment=True)
    assert decoded(g) == expected(s)


def test_two_sources_and_compression(spark):
    a = store(spark, [r[:4] for r in NINE], ["AT"] * 10, length=2000, ids="a")
    b = store(spark, [r[4:] for r in NINE], ["AT"] * 10, length=2000, ids="b")
    note = notes(spark, [(100 * (k + 1), "A") for k in range(10)])
    for compress in (False, True):
        g = pipeline.infer(spark, {"a": a, "b": b}, note, compress=compress)
        assert decoded(g) == {100 * (k + 1): ["AT"[int(c)] for c in r] for k, r in enumerate(NINE)}
        assert [m["sample_id"] for m in g.meta[:8]] == [f"{x}{k}" for x in "ab" for k in range(4)]
        assert g.intervals == [(100, 1001)]


def test_diploid_with_metadata(spark):
    s = store(spark, NINE, ["AT"] * 10, length=2000, ploidy=2)
    s = Store(s.variants, s.samples.selectExpr("*", "concat('p', sample_idx % 2) AS pop"), s.length)
    g = pipeline.infer(spark, {"s": s}, notes(spark, [(100 * (k + 1), "A") for k in range(10)]), population="pop", fields={"group": "pop"})
    assert [m["ploidy_index"] for m in g.meta[:8]] == [0, 1] * 4
    assert g.individuals[1] == {"source": "s", "sample_id": "s1", "group": "p1"}
    assert [p["name"] for p in g.populations] == ["p0", "p1"]


def test_triallelic_across_sources(spark):
    a = store(spark, ["0101", "0101", "0110", "0110", "1001", "1010"], ["AT"] * 6, ids="a")
    b = store(spark, ["0101", "0110", "0101", "1001", "0110", "1001"], ["AG"] + ["AT"] * 5, ids="b")
    g = pipeline.infer(spark, {"a": a, "b": b}, notes(spark, [(100 * (k + 1), "A") for k in range(6)]), augment=True)
    ea, eb = expected(a), expected(b)
    assert decoded(g) == {p: ea[p] + eb[p] for p in ea}
    assert {*decoded(g)[100]} == {"A", "T", "G"}


def test_augment_further_source(spark):
    s = store(spark, [[0, 1, 1], [1, 0, 1]], ["AT", "CG"], [100, 300])
    more = store(spark, [[0, 0, 1], [0, 1, 1], [1, 0, 0]], ["AG"] * 3, [200, 250, 250])
    note = notes(spark, [(100, "A"), (200, "A"), (250, "A"), (300, "C")])
    g = pipeline.infer(spark, {"s": s}, note)
    out = pipeline.augment_sites(spark, g, {"more": more}, note)
    assert decoded(out)[200] == ["A", "A", "G"]
    assert 250 not in decoded(out)
    g.meta[0] = {}
    with pytest.raises(ValueError, match="metadata"):
        pipeline.augment_sites(spark, g, {"more": more}, note)


def test_nothing_to_infer(spark):
    s = store(spark, [[0, 0], [1, 1]], ["AT", "AT"])
    g = pipeline.infer(spark, {"s": s}, notes(spark, [(100, "A"), (200, "A")]))
    assert g.sites == []
    assert len(g.samples()) == 2


def test_executors_match_like_the_driver(spark):
    s = store(spark, NINE, ["AT"] * 10, length=2000)
    a = pipeline.infer_ancestors([(s, s)], notes(spark, [(100 * (k + 1), "A") for k in range(10)]))
    plan = pipeline.plan_match(spark, a, {"s": s})
    near = pipeline.match(plan, 2000, a.intervals, strict=False)
    far = pipeline.match(plan, 2000, a.intervals, local_rows=0, strict=False)
    assert near.edges == far.edges
    assert near.mutations == far.mutations


@pytest.fixture
def configured(spark, tmp_path):
    s = store(spark, NINE, ["AT"] * 10, length=2000)
    write_store(Store(s.variants.selectExpr("*", "'A' AS variant_ancestral_allele"), s.samples, 2000), str(tmp_path / "in"))
    text = f"""
[[source]]
name = "s"
path = "{tmp_path}/in"
[ancestral_state]
path = "{tmp_path}/in"
field = "variant_ancestral_allele"
[[ancestors]]
path = "{tmp_path}/anc"
sources = ["s"]
[match]
output = "{tmp_path}/out"
[match.sources.ancestors]
node_flags = 0
create_individuals = false
[match.sources.s]
recombination = 1e-2
mismatch = 1e-6
[post_process]
[augment_sites]
sources = ["s"]
"""
    (tmp_path / "c.toml").write_text(text)
    return tmp_path


def test_cli(spark, configured, capsys):
    c = str(configured / "c.toml")
    assert main(["config", "check", c]) == 0
    assert main(["config", "show", c]) == 0
    assert "mismatch = 1e-06" in capsys.readouterr().out
    assert main(["infer-ancestors", c], spark) == 0
    assert main(["infer-ancestors", c], spark) == 1
    (configured / "anc.part" / "sites").mkdir(parents=True)  # as a broken run leaves it
    assert main(["infer-ancestors", c, "--force"], spark) == 0
    work = str(configured / "work")
    assert main(["match", c, "-w", work, "--group-stop", "2", "--match-file", str(configured / "m.jsonl")], spark) == 0
    assert main(["match", c, "-w", work], spark) == 1
    assert main(["match", c, "-w", work, "-f"], spark) == 0
    lines = [json.loads(x) for x in (configured / "m.jsonl").read_text().splitlines()]
    assert lines[0]["group"] == 0
    jobs = json.loads((configured / "work" / "match-jobs.json").read_text())
    assert [(j["group"], j["haplotype_index"]) for j in jobs] == sorted((j["group"], j["haplotype_index"]) for j in jobs)
    assert {j["sample_chunk"] for j in jobs} == {0}
    assert main(["show-match-jobs", f"{work}/match-jobs.json"], spark) == 0
    assert "#" in capsys.readouterr().out
    whole = runner.match(spark, Config.from_toml(c))
    resumed = pipeline.read_graph(spark, str(configured / "out"))
    assert (len(whole.time), len(whole.edges), whole.mutations) == (len(resumed.time), len(resumed.edges), resumed.mutations)
    assert main(["post-process", c, "--input", str(configured / "out"), "-f"], spark) == 0
    assert main(["augment-sites", c, "--input", str(configured / "out"), "--output", str(configured / "more")], spark) == 0
    g = pipeline.read_graph(spark, str(configured / "more"))
    assert decoded(g) == {100 * (k + 1): ["AT"[int(x)] for x in r] for k, r in enumerate(NINE)}
    assert main(["run", c, "-f"], spark) == 0


def test_match_file_under_compression(spark, configured):
    """Lines are what matching found, though compression moves edges; each group's nodes follow those before it."""
    text = (configured / "c.toml").read_text().replace("[match]", "[match]\npath_compression = true")
    (configured / "c.toml").write_text(text)
    cfg = Config.from_toml(str(configured / "c.toml"))
    runner.infer_ancestors(spark, cfg)
    seen = []
    plan, a, _ = runner._plan(spark, cfg)
    pipeline.match(plan, 2000, a.intervals, {"s": (1e-2, 1e-6)}, True, on_group=lambda k, g, results: seen.append((k, results)))
    runner.match(spark, cfg, match_file=str(configured / "m.jsonl"))
    lines = [json.loads(x) for x in (configured / "m.jsonl").read_text().splitlines()]
    told = {x["haplotype_index"]: x for x in lines}
    assert len(told) == len(lines) == len(plan.jobs)
    for k, results in seen:
        for i, (path, off) in results.items():
            assert told[i]["group"] == k
            assert [(p["left"], p["right"], p["parent"]) for p in told[i]["path"]] == [tuple(p) for p in path]
            assert [m["position"] for m in told[i]["mutations"]] == [x for x, _ in off]


def test_match_against_a_reference_graph(spark, configured):
    c = configured / "c.toml"
    assert main(["run", str(c)], spark) == 0
    text = c.read_text()
    (configured / "ref.toml").write_text(text.replace("[match]\n", f'[match]\nreference_ts = "{configured}/out"\n').replace(f"{configured}/out\"\n[match.sources.anc", f"{configured}/again\"\n[match.sources.anc"))
    cut = (configured / "ref.toml").read_text()
    cut = cut.replace(f'output = "{configured}/out"', f'output = "{configured}/again"')
    lo, hi = cut.index("[[ancestors]]"), cut.index("[match]")
    cut = cut[:lo] + cut[hi:]
    lo, hi = cut.index("[match.sources.ancestors]"), cut.index("[match.sources.s]")
    cut = cut[:lo] + cut[hi:cut.index("[post_process]")]
    (configured / "ref.toml").write_text(cut)
    assert main(["match", str(configured / "ref.toml")], spark) == 0
    before, after = (pipeline.read_graph(spark, str(configured / n)) for n in ("out", "again"))
    assert len(after.time) == len(before.time) + 8
    assert decoded(after) == {x: a + a for x, a in decoded(before).items()}


def test_empty_ancestors(spark, tmp_path):
    runner.write_empty_ancestors(spark, str(tmp_path / "none"), 500)
    a = runner.read_ancestors(spark, str(tmp_path / "none"))
    plan = pipeline.plan_match(spark, a, {"s": store(spark, [[0, 1]], ["AT"])})
    g = pipeline.match(plan, 500, a.intervals)
    assert (len(plan.jobs), g.sites, len(g.samples())) == (2, [], 2)


def test_rows_of_one_position(spark):
    """The first row of an annotation counts, and the last of a source that is matched."""
    rows = spark.createDataFrame([(100, ["A", "T"], [0, 1], "1"), (100, ["A", "C"], [1, 1], "1"), (200, ["G"], [0, 0], "1")], "position int, alleles array<string>, calls array<tinyint>, contig_id string")
    assert {(r["position"], tuple(r["alleles"])) for r in unify.last_calls(rows).collect()} == {(100, ("A", "C")), (200, ("G",))}
    note = spark.createDataFrame([(100, "T"), (100, "A"), (200, "G")], "position int, ancestral_allele string")
    assert {tuple(r) for r in unify.first_annotation(note).collect()} == {(100, "T"), (200, "G")}


def test_public_names():
    import genloom

    assert all(callable(getattr(genloom, n)) for n in genloom.__all__)
    assert len(genloom.__all__) == 15


BASE = {"source": [{"name": "s", "path": "p"}], "ancestral_state": {"path": "p", "field": "f"}, "ancestors": {"path": "a", "sources": ["s"]}, "match": {"output": "o", "sources": {"ancestors": {}, "s": True}}}


@pytest.mark.parametrize(
    "change",
    [
        {"extra": {}},
        {"source": [{"name": "", "path": "p"}]},
        {"source": [{"name": "s", "path": "p"}, {"name": "s", "path": "q"}]},
        {"source": [{"name": "s", "path": "p", "what": 1}]},
        {"source": [{"name": "ancestors", "path": "p"}]},
        {"ancestral_state": {"path": "p"}},
        {"ancestral_state": {"path": "p", "field": "f", "is_reference": True}},
        {"ancestors": {"path": "a", "sources": ["s"], "genotype_encoding": "one_bit"}},
        {"ancestors": {"path": "a"}},
        {"ancestors": 3},
        {"ancestors": []},
        {"match": {"output": "o", "sources": {"s": {}}}},
        {"match": {"output": "o", "sources": []}},
        {"match": {"sources": {"ancestors": {}}}},
        {"match": {"output": "o", "sources": {"ancestors": {}}, "keep_intermediates": True}},
        {"augment_sites": {}},
        {"augment_sites": {"sources": "s"}},
    ],
)
def test_config_rules(change):
    with pytest.raises(ValueError):
        Config.from_dict({**BASE, **change})


def test_config_defaults():
    c = Config.from_dict(BASE)
    assert c.sources["ancestors"].sample_time == "sample_time"
    assert c.ancestors[0].max_gap_length == 500_000
    assert c.match.sources["s"].node_flags == 1
    assert not c.match.path_compression
    assert any("no such path" in w for w in c.validate())
    with pytest.raises(ValueError):
        Config.from_dict({k: v for k, v in BASE.items() if k != "match"})


def test_metrics():
    one = {"elapsed_time": 1.0, "user_time": 2.0, "sys_time": 0.5, "max_memory": 10}
    assert runner.combined([one, {**one, "max_memory": 7}]) == {"elapsed_time": 2.0, "user_time": 4.0, "sys_time": 1.0, "max_memory": 10}
    with pytest.raises(ValueError):
        runner.combined([])


def test_haplotypes_are_stored_by_span(spark):
    """An ancestor takes the bytes of the sites it spans, not of the whole genome."""
    positions = [100 * (k + 1) + 10**6 * (k > 4) for k in range(10)]
    s = store(spark, NINE, ["AT"] * 10, positions, length=2 * 10**6)
    a = pipeline.infer_ancestors([(s, s)], notes(spark, [(p, "A") for p in positions]))
    plan = pipeline.plan_match(spark, a, {"s": s})
    n = a.found.count()
    sizes = {r["haplotype_index"]: len(r["codes"]) for r in plan.haps.collect()}
    assert len(a.intervals) == 2 and max(sizes[i] for i in range(n)) <= 5
    assert all(sizes[i] == 10 for i in sizes if i >= n)
    near = pipeline.match(plan, s.length, a.intervals, strict=False)
    far = pipeline.match(plan, s.length, a.intervals, local_rows=0, strict=False)
    assert near.edges == far.edges and near.mutations == far.mutations
    assert decoded(near) == expected(s)


def test_wide_groups_go_to_executors(spark, monkeypatch):
    """A group of few haplotypes over many sites is not matched where the driver is; results are the same."""
    s = store(spark, NINE, ["AT"] * 10, length=2000)
    a = pipeline.infer_ancestors([(s, s)], notes(spark, [(100 * (k + 1), "A") for k in range(10)]))
    plan = pipeline.plan_match(spark, a, {"s": s})
    here, group = [], pipeline.match_group
    monkeypatch.setattr(pipeline, "match_group", lambda *a, **k: here.append("fetched" in k) or group(*a, **k))
    near = pipeline.match(plan, 2000, a.intervals, strict=False)
    monkeypatch.setattr(pipeline, "LOCAL_CODES", 1)
    far = pipeline.match(plan, 2000, a.intervals, strict=False)
    n = len(here) // 2
    assert all(here[:n]) and not any(here[n:])
    assert near.edges == far.edges and near.mutations == far.mutations
