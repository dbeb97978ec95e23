"""The steps of a configured run, over stores on disk."""

from __future__ import annotations

import json
import platform
import resource
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.config import Config
from genloom.operators import ancestors, unify
from genloom.operators.matching import MU, RHO
from genloom.operators.treekernel import Graph
from genloom.plans import pipeline
from genloom.sources.catalog import Store, open_store, resolve_field


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def resources(began: float) -> dict:
    """Times and peak memory since ``began``."""
    used = resource.getrusage(resource.RUSAGE_SELF)
    return {"elapsed_time": time.time() - began, "user_time": used.ru_utime, "sys_time": used.ru_stime, "max_memory": used.ru_maxrss * 1024}


def combined(parts: list[dict]) -> dict:
    """Sums of times and the largest memory of several steps."""
    if not parts:
        raise ValueError("there is nothing to combine")
    return {k: (max if k == "max_memory" else sum)(p[k] for p in parts) for k in parts[0]}


def record(command: str, cfg: Config, began: float, **more: object) -> dict:
    """A provenance record."""
    return {
        "schema_version": "1.0.0",
        "software": {"name": "genloom", "version": "0.1"},
        "parameters": {"command": command, "config": cfg.format(), "argv": sys.argv, **more},
        "resources": resources(began),
        "environment": {"python": platform.python_version(), "os": platform.platform()},
    }


def _whole(spark: SparkSession, cfg: Config, name: str) -> Store:
    s = cfg.sources[name]
    return open_store(s.path, spark).of_samples(s.samples)


def _filtered(store: Store, cfg: Config, name: str) -> Store:
    s = cfg.sources[name]
    return store.narrowed(s.include, s.exclude, s.regions, s.targets)


def annotation(spark: SparkSession, cfg: Config) -> DataFrame:
    a = cfg.ancestral_state
    v = open_store(a.path, spark).variants
    allele = F.get("alleles", F.lit(0)) if a.is_reference else F.col(a.field)
    return v.select("position", allele.alias("ancestral_allele"), unify.row_number(v).alias("row"))


def infer_ancestors(spark: SparkSession, cfg: Config, force: bool = False) -> None:
    """Make the first set of ancestors and publish its tables at once; an existing one is an error unless ``force``.

    What a broken run left behind is removed.
    """
    a = cfg.ancestors[0]
    if exists(spark, a.path) and not force:
        raise ValueError(f"{a.path} exists already; use --force to replace it")
    _remove(spark, f"{a.path}.part")
    pairs = [(_filtered(w, cfg, n), w) for n in a.sources for w in [_whole(spark, cfg, n)]]
    made = pipeline.infer_ancestors(pairs, annotation(spark, cfg), a.max_gap_length)
    made.sites.write.parquet(f"{a.path}.part/sites")
    made.found.write.parquet(f"{a.path}.part/ancestors")
    spark.createDataFrame([(json.dumps({"intervals": made.intervals, "length": pairs[0][1].length}),)], "metadata string").write.parquet(f"{a.path}.part/metadata")
    p = spark._jvm.org.apache.hadoop.fs.Path
    _remove(spark, a.path)
    p(a.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p(f"{a.path}.part"), p(a.path))


def write_empty_ancestors(spark: SparkSession, path: str, length: int, mode: str = "errorifexists") -> None:
    """A set of ancestors without sites or haplotypes, with all its tables and columns."""
    sites = "position int, ancestral string, dictionary array<string>, codes array<tinyint>, derived int, called int, calls array<tinyint>, time double, interval_idx int"
    found = ", ".join(f for f in ancestors.FOUND.split(", ") if not f.startswith("descriptor ")) + ", ancestor_id int, sample_id string"
    spark.createDataFrame([], sites).write.mode(mode).parquet(f"{path}/sites")
    spark.createDataFrame([], found).write.mode(mode).parquet(f"{path}/ancestors")
    spark.createDataFrame([(json.dumps({"intervals": [], "length": length}),)], "metadata string").write.mode(mode).parquet(f"{path}/metadata")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file at a path of any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_ancestors(spark: SparkSession, path: str) -> pipeline.Ancestors:
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
    return pipeline.Ancestors(spark.read.parquet(f"{path}/sites"), spark.read.parquet(f"{path}/ancestors"), [tuple(i) for i in meta["intervals"]])


def _plan(spark: SparkSession, cfg: Config) -> tuple[pipeline.MatchPlan, pipeline.Ancestors, dict[str, Store]]:
    a = read_ancestors(spark, cfg.ancestors[0].path) if cfg.ancestors else sites_of(spark, pipeline.read_graph(spark, cfg.match.reference_ts))
    own = cfg.ancestors[0].name if cfg.ancestors else "ancestors"
    stores: dict[str, Store] = {}
    times: dict[str, str | float] = {}
    for n in cfg.match.sources:
        if n == own and cfg.ancestors:
            continue
        stores[n] = _whole(spark, cfg, n)
        spec = cfg.sources[n].sample_time
        if spec is not None:
            rows = resolve_field(stores[n].samples, "sample_id", spec, "_time", fill=spec.get("fill_value", 0.0) if isinstance(spec, dict) else None, spark=spark)
            stores[n] = Store(stores[n].variants, rows, stores[n].length)
            times[n] = "_time"
    meta = cfg.individual_metadata
    flags = {n: m.node_flags for n, m in cfg.match.sources.items()}
    people = any(m.create_individuals for n, m in cfg.match.sources.items() if n in stores)
    plan = pipeline.plan_match(spark, a, stores, times, people, meta.fields if meta else None, meta.population if meta else None, own, flags)
    return plan, a, stores


def sites_of(spark: SparkSession, g: Graph) -> pipeline.Ancestors:
    """The sites of a graph as those of an inference without ancestors of its own; mutations tell the derived alleles."""
    derived: dict[int, list[str]] = {}
    for s, _, d, _ in g.mutations:
        derived.setdefault(s, []).append(d)
    rows = [(int(x), a, list(dict.fromkeys([a, *derived.get(s, [])]))) for s, (x, a) in enumerate(g.sites)]
    sites = spark.createDataFrame(rows, "position int, ancestral string, dictionary array<string>")
    found = spark.createDataFrame([], ", ".join(f for f in ancestors.FOUND.split(", ") if not f.startswith("descriptor ")) + ", ancestor_id int, sample_id string")
    return pipeline.Ancestors(sites, found, g.intervals or [])


def match(spark: SparkSession, cfg: Config, group_stop: int | None = None, match_file: str | None = None) -> Graph:
    """Match all groups; with a work directory each group's graph is kept, and a later run goes on after the last.

    ``[match] reference_ts`` names a graph (as ``write_graph`` leaves it) that
    matching begins with. ``match_file`` gets a line for each haplotype with
    the path and mutations that matching found, as its group returns; a run
    that goes on adds to it.
    """
    began = time.time()
    plan, a, stores = _plan(spark, cfg)
    length = next((s.length for s in stores.values()), max((b for _, b in a.intervals), default=1))
    rates = {n: (RHO if m.recombination is None else m.recombination, MU if m.mismatch is None else m.mismatch) for n, m in cfg.match.sources.items()}
    work, start, last = cfg.match.workdir, None, None
    if cfg.match.reference_ts:
        reference = pipeline.read_graph(spark, cfg.match.reference_ts)
        if [int(x) for x, _ in reference.sites] != list(plan.positions):
            raise ValueError("the reference graph has other sites than the ancestors")
        shift, kinds = len(reference.individuals), len(reference.populations)
        for j in plan.jobs:
            j["individual_id"] += shift if j["individual_id"] >= 0 else 0
            j["population_id"] += kinds if j["population_id"] >= 0 else 0
        reference.individuals += plan.individuals
        reference.populations += plan.populations
        start, length = (-1, reference), reference.length
    if work:
        done = [k for k in range(1 + max((j["group"] for j in plan.jobs), default=-1)) if exists(spark, f"{work}/group_{k}/_DONE")]
        if done:
            last = done[-1]
            start = (last, pipeline.read_graph(spark, f"{work}/group_{last}/graph"))
        elif not exists(spark, f"{work}/match-jobs.json"):
            ordered = sorted(plan.jobs, key=lambda j: (j["group"], j["haplotype_index"]))
            write_text(spark, f"{work}/match-jobs.json", "[" + ",\n".join(json.dumps(j) for j in ordered) + "]\n")
    if match_file and last is None:
        open(match_file, "w").close()
    of_group: dict[int, list[dict]] = {}
    for j in plan.jobs:
        of_group.setdefault(j["group"], []).append(j)

    def keep(k: int, g: Graph, results: dict[int, tuple[list, list]]) -> None:
        nonlocal last
        if match_file:
            site_at = {x: s for s, x in enumerate(plan.positions)}
            with open(match_file, "a") as f:
                for j in sorted(of_group[k], key=lambda j: j["haplotype_index"]):
                    path, off = results[j["haplotype_index"]]
                    row = {c: j[c] for c in ("group", "haplotype_index", "source", "sample_id", "ploidy_index", "time")}
                    row["path"] = [{"left": float(a), "right": float(b), "parent": int(u)} for a, b, u in path]
                    row["mutations"] = [{"position": float(x), "derived_state": plan.dictionary[site_at[int(x)]][c]} for x, c in off]
                    f.write(json.dumps(row) + "\n")
        if not work:
            return
        pipeline.write_graph(spark, g, f"{work}/group_{k}/graph", "overwrite")
        spark.range(1).write.mode("overwrite").parquet(f"{work}/group_{k}/_DONE")
        if last is not None and not cfg.match.keep_intermediates:
            _remove(spark, f"{work}/group_{last}")
        last = k

    g = pipeline.match(plan, length, a.intervals, rates, cfg.match.path_compression, start, group_stop, keep)
    g.provenances.append(record("match", cfg, began))
    return g


def post_process(g: Graph, cfg: Config) -> Graph:
    """Clip and simplify, if the section is there; splitting ultimate ancestors changes nothing so far."""
    return g if cfg.post_process is None else pipeline.post_process(g, cfg.post_process.erase_flanks)


def augment_sites(spark: SparkSession, g: Graph, cfg: Config) -> Graph:
    if cfg.augment_sites is None:
        return g
    stores = {n: _filtered(_whole(spark, cfg, n), cfg, n) for n in cfg.augment_sites.sources}
    return pipeline.augment_sites(spark, g, stores, annotation(spark, cfg))


def run(spark: SparkSession, cfg: Config, match_file: str | None = None) -> Graph:
    """All steps; ancestors that exist are used as they are."""
    if cfg.ancestors and not exists(spark, cfg.ancestors[0].path):
        infer_ancestors(spark, cfg)
    return augment_sites(spark, post_process(match(spark, cfg, match_file=match_file), cfg), cfg)
