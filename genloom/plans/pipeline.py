"""Genealogy inference end to end: ancestors, matching, post-processing, further sites."""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.operators import ancestors as anc
from genloom.operators import augment as aug
from genloom.operators import sites as site_ops
from genloom.operators import unify
from genloom.operators.grouping import group_spans
from genloom.operators.matching import MU, RHO, extend, make_root, match_group
from genloom.operators.treekernel import NULL, Graph
from genloom.session import from_arrow, release, stage
from genloom.sources.catalog import Store

MAX_GAP = 500_000
#: Samples of a chunk in the jobs file, and haplotypes of small groups that are fetched together.
SAMPLES_CHUNK, FETCHED = 100, 2048
#: Bytes of codes, one a site that a haplotype spans, that are fetched together.
FETCHED_BYTES = 64 << 20
#: Codes of a group beyond which it goes to executors, however few its haplotypes are.
LOCAL_CODES = 1 << 20


@dataclass(frozen=True)
class Ancestors:
    """Inference sites, intervals and ancestral haplotypes of a set of sources."""

    sites: DataFrame  # position, ancestral, dictionary, time, derived, called, calls, interval_idx
    found: DataFrame  # anc.FOUND with ancestor_id and sample_id
    intervals: list[tuple[int, int]]


def infer_ancestors(sources: list[tuple[Store, Store]], annotation: DataFrame, max_gap: int = MAX_GAP, splits: int | None = None) -> Ancestors:
    """From ``(filtered, whole)`` stores and an annotation."""
    parts = [(kept.variants, whole.variants, whole.haplotypes()) for kept, whole in sources]
    n = sum(p[2] for p in parts)
    unified = unify.unified(parts, annotation)
    sites = stage(site_ops.with_interval(site_ops.inference_sites(unified, n), max_gap), "sites")
    found = stage(anc.numbered(stage(anc.build(sites, splits), "unnumbered")), "ancestors")
    spans = sites.groupBy("interval_idx").agg(F.min("position").alias("a"), (F.max("position") + 1).alias("b")).orderBy("interval_idx").collect()
    return Ancestors(sites, found, [(r["a"], r["b"]) for r in spans])


@dataclass
class MatchPlan:
    """What matching works through: jobs in groups, and each haplotype's codes."""

    jobs: list[dict]
    haps: DataFrame  # haplotype_index, grp, start (position of the first code), codes
    positions: Sequence[int]
    ancestral: list[str]
    dictionary: list[list[str]]
    individuals: list[dict] = field(default_factory=list)
    populations: list[dict] = field(default_factory=list)


def plan_match(spark: SparkSession, a: Ancestors, stores: dict[str, Store], times: dict[str, str | float] | None = None, individuals: bool = True, fields: dict[str, str] | None = None, population: str | None = None, ancestor_source: str = "ancestors", flags: dict[str, int] | None = None) -> MatchPlan:
    """Jobs and haplotypes of the ancestors and then of each store, in order."""
    times, fields, flags = times or {}, fields or {}, flags or {}
    rows = a.sites.select("position", "ancestral").orderBy("position").toArrow()
    positions = array("q", rows["position"].to_numpy().astype("i8").tobytes())
    ancestral = [sys.intern(x) for lot in rows["ancestral"].chunks for x in lot.to_pylist()]
    span = (positions[0], positions[-1] + 1) if positions else (0, 1)
    jobs: list[dict] = []
    for r in a.found.select("ancestor_id", "sample_id", "time", "start_position", "end_position").orderBy("ancestor_id").toLocalIterator():
        jobs.append({"source": ancestor_source, "sample_id": r["sample_id"], "sample_chunk": r["ancestor_id"] // SAMPLES_CHUNK, "ploidy_index": 0, "time": r["time"], "start_position": r["start_position"], "end_position": r["end_position"], "node_flags": flags.get(ancestor_source, 0), "individual_id": NULL, "population_id": NULL})
    people: list[dict] = []
    groups: dict[str, int] = {}
    for name, store in stores.items():
        spec = times.get(name, 0.0)
        ends = {"start_position", "end_position"} <= set(store.samples.columns)
        first_of: dict[str, dict] = {}  # metadata are those of the first sample with the id
        for r in (r.asDict() for r in store.samples.orderBy("sample_idx").toLocalIterator()):
            person = pop = NULL
            if individuals:
                person = len(people)
                told = first_of.setdefault(r["sample_id"], r)
                people.append({"source": name, "sample_id": r["sample_id"], **{k: told[v] for k, v in fields.items()}})
            if population:
                pop = groups.setdefault(str(first_of.setdefault(r["sample_id"], r)[population]), len(groups))
            lo, hi = (r["start_position"], r["end_position"]) if ends else span
            for k in range(r["ploidy"]):
                jobs.append({"source": name, "sample_id": r["sample_id"], "sample_chunk": r["sample_idx"] // SAMPLES_CHUNK, "ploidy_index": k, "time": float(r[spec] if isinstance(spec, str) else spec), "start_position": lo, "end_position": hi, "node_flags": flags.get(name, 1), "individual_id": person, "population_id": pop})
    grp = group_spans(*(np.array([j[c] for j in jobs], float) for c in ("start_position", "end_position", "time"))) if jobs else []
    for i, (j, k) in enumerate(zip(jobs, grp)):
        j["haplotype_index"], j["group"] = i, int(k)

    # one dictionary: ancestral allele and first derived one of the ancestors, then the sources'
    base = a.sites.select("position", F.slice("dictionary", 1, 2).alias("alleles"))
    notes = a.sites.select("position", F.col("ancestral").alias("ancestral_allele"))
    words = stage(unify.dictionaries([base, *(s.variants for s in stores.values())], notes), "dictionary")
    alike: dict[tuple, list[str]] = {}  # sites of equal dictionaries share one list
    dictionary = [alike.setdefault(tuple(one), one) for lot in words.orderBy("position").select("dictionary").toArrow().column(0).chunks for k in range(0, len(lot), 10_000) for one in lot[k : k + 10_000].to_pylist()]
    sites = pa.table({"position": rows["position"].cast(pa.int32()), "site": pa.array(np.arange(len(positions), dtype=np.int32))})
    number = stage(words.select("position", "dictionary").join(from_arrow(spark, sites, "position int, site int"), "position"), "site-numbers")
    first = 0
    frames = []
    index = spark.createDataFrame([(j["haplotype_index"], j["group"]) for j in jobs], "haplotype_index long, grp int")
    for name, store in stores.items():
        n = store.haplotypes()
        begin = sum(1 for j in jobs if j["source"] == ancestor_source) + first
        last = unify.last_calls(store.variants)
        coded = number.join(last, "position").select("site", unify.canonical(F.col("calls"), F.col("alleles"), F.col("dictionary")).alias("codes"))
        frames.append(anc.transpose(coded, len(positions)).select((F.col("hap") + begin).alias("haplotype_index"), F.lit(span[0]).cast("int").alias("start"), "codes"))
        first += n
    haps = a.found.select(F.col("ancestor_id").cast("long").alias("haplotype_index"), F.col("start_position").alias("start"), F.col("hap").alias("codes"))
    for f in frames:
        haps = haps.unionByName(f)
    # files by group, so that a group's haplotypes are read without the others
    haps = stage(haps.join(index, "haplotype_index").repartitionByRange("grp").sortWithinPartitions("grp"), "haplotypes")
    return MatchPlan(jobs, haps, positions, ancestral, dictionary, people, [{"name": n} for n in groups])


def match(plan: MatchPlan, length: float, intervals: list[tuple[int, int]], rates: dict[str, tuple[float, float]] | None = None, compress: bool = False, start: tuple[int, Graph] | None = None, group_stop: int | None = None, on_group=None, local_rows: int = 64, strict: bool = True) -> Graph:
    """Match all groups in order; ``start`` is ``(last group, its graph)`` of an earlier run, or ``(-1, a graph)`` to begin with.

    ``on_group(number, graph, results)`` is called after each group, with the
    sorted graph and what matching found, for checkpoints. Groups from
    ``group_stop`` on are left out. Haplotypes of small groups that follow
    each other are fetched by one job, FETCHED at most, and about FETCHED_BYTES.
    """
    groups: dict[int, list[dict]] = {}
    for j in plan.jobs:
        groups.setdefault(j["group"], []).append(j)
    if start is None:
        g = make_root(plan.positions, plan.ancestral, length, max((j["time"] for j in plan.jobs), default=0.0))
        g.individuals, g.populations, g.intervals = list(plan.individuals), list(plan.populations), list(intervals)
        done = -1
    else:
        done, g = start[0], start[1].copy()
    todo = [k for k in sorted(groups) if k > done and (group_stop is None or k < group_stop)]
    where = np.array(plan.positions)
    fetched: dict[int, tuple[int, bytes]] = {}
    upto = -1
    wide_of = {}
    for k in todo:
        ends = np.array([(j["start_position"], j["end_position"]) for j in groups[k]])
        wide_of[k] = int((np.searchsorted(where, ends[:, 1]) - np.searchsorted(where, ends[:, 0])).sum())
    near = {k for k in todo if len(groups[k]) <= local_rows and wide_of[k] <= LOCAL_CODES}
    for i, k in enumerate(todo):
        jobs = groups[k]
        if not plan.positions:
            results = {j["haplotype_index"]: ([], []) for j in jobs}
        elif k in near:
            if k > upto:
                n = wide = 0
                for m in todo[i:]:
                    n += len(groups[m])
                    wide += wide_of[m]
                    if m > k and (n > FETCHED or wide > FETCHED_BYTES or m not in near):
                        break
                    upto = m
                rows = plan.haps.where((F.col("grp") >= k) & (F.col("grp") <= upto)).select("haplotype_index", "start", "codes").collect()
                fetched = {r["haplotype_index"]: (r["start"], bytes(r["codes"])) for r in rows}
            own = {j["haplotype_index"]: fetched[j["haplotype_index"]] for j in jobs if j["haplotype_index"] in fetched}
            results = match_group(plan.haps, g, jobs, plan.dictionary, rates or {}, local_rows, strict=strict, fetched=own)
        else:
            results = match_group(plan.haps.where(F.col("grp") == k), g, jobs, plan.dictionary, rates or {}, 0, strict=strict)
        g = extend(g, jobs, results, plan.dictionary, compress, in_place=True)
        g.provenances.append({"software": "genloom", "command": "match", "group": k, "haplotypes": len(jobs)})
        if on_group:
            g.sort()
            on_group(k, g, results)
    g.sort()
    return g


def post_process(g: Graph, erase_flanks: bool = True) -> Graph:
    return (g.erase_flanks() if erase_flanks else g).simplify()


def augment_sites(spark: SparkSession, g: Graph, stores: dict[str, Store], annotation: DataFrame | None) -> Graph:
    """Place positions of ``stores`` that the graph lacks, within its intervals, on its trees.

    An annotated ancestral allele is the root's state; otherwise parsimony
    chooses. Sites without any call are left out.
    """
    samples = g.samples()
    if any(not {"source", "sample_id", "ploidy_index"} <= g.meta[u].keys() for u in samples):
        raise ValueError("each sample needs source, sample_id and ploidy_index in its metadata")
    parts = [(s.variants, s.variants, s.haplotypes()) for s in stores.values()]
    if annotation is None:
        positions = unify.position_union([s.variants for s in stores.values()])
        annotation = positions.withColumn("ancestral_allele", F.lit(""))
    rows = unify.unified(parts, annotation)
    if g.intervals is not None:
        spans = spark.createDataFrame([(int(lo), int(hi)) for lo, hi in g.intervals], "start long, end long")
        width = max(1, *(int(hi - lo) for lo, hi in g.intervals)) if g.intervals else 1
        inside = site_ops.in_intervals(rows.select("position"), spans, width).select("position").distinct()
        rows = rows.join(inside, "position", "left_semi")
    there = from_arrow(spark, pa.table({"position": pa.array(g.sites.columns()[0].astype(np.int32))}), "position int")
    rows = unify.exclude_positions(rows, there)
    columns: dict[tuple, int] = {}
    loose: dict[tuple, int] = {}
    k = 0
    for name, store in stores.items():
        for r in store.samples.orderBy("sample_idx").toLocalIterator():
            for p in range(r["ploidy"]):
                columns[name, r["sample_id"], p] = k
                loose.setdefault((r["sample_id"], p), k)
                k += 1
    keys = [(g.meta[u]["source"], g.meta[u]["sample_id"], g.meta[u]["ploidy_index"]) for u in samples]
    order = [columns.get(key, loose.get(key[1:], -1)) for key in keys]
    # one literal however many samples there are
    picked = F.transform(F.split(F.lit(",".join(map(str, order))), ",").cast("array<int>"), lambda i: F.when(i < 0, F.lit(-1).cast("tinyint")).otherwise(F.get("codes", i)))
    wanted = rows.select(F.col("position").cast("double").alias("position"), picked.alias("calls"), "dictionary", F.when(F.col("ancestral") != "", F.lit(0)).alias("root_state"))
    wanted = stage(wanted.where(F.exists("calls", lambda c: c >= 0)), "augment")
    words = {r["position"]: r["dictionary"] for r in wanted.select("position", "dictionary").toLocalIterator()}
    if not words:
        return aug.augmented(g, [], words)
    placed = [(r["position"], r["root_state"], [tuple(m) for m in r["mutations"]]) for r in aug.place_frame(wanted, g, samples).toLocalIterator()]
    return aug.augmented(g, placed, words)


def infer(spark: SparkSession, stores: dict[str, Store], annotation: DataFrame, max_gap: int = MAX_GAP, compress: bool = False, erase_flanks: bool = True, augment: bool = False, rates: dict[str, tuple[float, float]] | None = None, strict: bool = False, **jobs) -> Graph:
    """All steps over stores that serve both for ancestors and as samples."""
    a = infer_ancestors([(s, s) for s in stores.values()], annotation, max_gap)
    length = next(iter(stores.values())).length
    # the plan goes with the call: the further steps don't need it
    g = match(plan_match(spark, a, stores, **jobs), length, a.intervals, rates or {n: (RHO, MU) for n in stores}, compress, strict=strict)
    g = post_process(g, erase_flanks)
    release(spark)
    return augment_sites(spark, g, stores, annotation) if augment else g


def write_graph(spark: SparkSession, g: Graph, path: str, mode: str = "errorifexists") -> None:
    """The seven tables and the metadata as Parquet below ``path``."""
    kinds = {
        "nodes": "id long, time double, flags int, individual int, population int, source string, sample_id string, ploidy_index int",
        "edges": "left double, right double, parent long, child long",
        "sites": "id long, position double, ancestral_state string",
        "mutations": "id long, site long, node long, derived_state string, parent long",
        "individuals": "id long, metadata string",
        "populations": "id long, metadata string",
        "provenances": "id long, record string",
    }
    for name, rows in g.rows().items():
        spark.createDataFrame(rows, kinds[name]).coalesce(1).write.mode(mode).parquet(f"{path}/{name}")
    meta = [(json.dumps({"length": g.length, "intervals": g.intervals}),)]
    spark.createDataFrame(meta, "metadata string").coalesce(1).write.mode(mode).parquet(f"{path}/metadata")


def read_graph(spark: SparkSession, path: str) -> Graph:
    def rows(name: str, order: str = "id") -> list:
        return spark.read.parquet(f"{path}/{name}").orderBy(order).collect()

    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
    g = Graph(meta["length"])
    for r in rows("nodes"):
        told = {k: r[k] for k in ("source", "sample_id", "ploidy_index")}
        g.add_node(r["time"], r["flags"], r["individual"], r["population"], told if r["sample_id"] is not None else {})
    g.edges = [(r["left"], r["right"], r["parent"], r["child"]) for r in rows("edges", "left")]
    g.sites = [(r["position"], r["ancestral_state"]) for r in rows("sites")]
    g.mutations = [(r["site"], r["node"], r["derived_state"], r["parent"]) for r in rows("mutations")]
    g.individuals, g.populations = ([json.loads(r["metadata"]) for r in rows(n)] for n in ("individuals", "populations"))
    g.provenances = [json.loads(r["record"]) for r in rows("provenances")]
    g.intervals = None if meta["intervals"] is None else [tuple(i) for i in meta["intervals"]]
    g.sort()
    return g
