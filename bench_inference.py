"""Times of the inference steps on simulated haplotypes: ``bench_inference.py HAPLOTYPES SITES``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")


def simulated(haplotypes: int, sites: int, seed: int = 7) -> np.ndarray:
    """Sites by haplotypes of 0 and 1: a random binary tree whose branches are cut and joined anew along the genome, one mutation a site."""
    rng = np.random.default_rng(seed)
    parent = np.full(2 * haplotypes - 1, -1)
    live = list(range(haplotypes))
    for u in range(haplotypes, 2 * haplotypes - 1):
        a, b = (live.pop(int(rng.integers(len(live)))) for _ in range(2))
        parent[a] = parent[b] = u
        live.append(u)
    out = np.zeros((sites, haplotypes), np.int8)
    for s in range(sites):
        if s % 10 == 9:  # one leaf moves under another's parent, which gets a third child
            a, b = rng.integers(0, haplotypes, 2)
            parent[a] = parent[b]
        while True:
            u = int(rng.integers(0, 2 * haplotypes - 2))
            v = np.arange(haplotypes)
            below = v == u
            while (v >= 0).any():
                v = np.where(v >= 0, parent[v], -1)
                below |= v == u
            if 0 < below.sum() < haplotypes:
                break
        out[s] = below
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from genloom.plans import pipeline
    from genloom.sources.catalog import Store

    n, sites = int(sys.argv[1]), int(sys.argv[2])
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    calls = simulated(n, sites)
    rows = [(100 * (k + 1), ["A", "T"], c.tolist(), "1") for k, c in enumerate(calls)]
    v = spark.createDataFrame(rows, "position int, alleles array<string>, calls array<tinyint>, contig_id string")
    store = Store(v, spark.range(n).selectExpr("int(id) AS sample_idx", "concat('s', id) AS sample_id", "1 AS ploidy"), 100 * (sites + 2))
    notes = v.selectExpr("position", "'A' AS ancestral_allele")
    began = time.time()
    a = pipeline.infer_ancestors([(store, store)], notes)
    ancestors, made = a.found.count(), time.time()
    plan = pipeline.plan_match(spark, a, {"s": store})
    planned = time.time()
    g = pipeline.match(plan, store.length, a.intervals, {"s": (1e-2, 1e-20), "ancestors": (1e-2, 1e-20)}, strict=False)
    matched = time.time()
    g = pipeline.post_process(g)
    done = time.time()
    right = sum(np.array_equal([c == "T" for c in alleles], calls[int(x) // 100 - 1] == 1) for x, alleles in g.genotypes())
    print(json.dumps({"haplotypes": n, "sites": sites, "ancestors": ancestors, "groups": len({j["group"] for j in plan.jobs}), "edges": len(g.edges), "sites_right": right, "ancestors_s": round(made - began, 2), "plan_s": round(planned - made, 2), "match_s": round(matched - planned, 2), "post_s": round(done - matched, 2), "ancestors_per_s": round(ancestors / (made - began), 1), "haplotypes_per_s": round(len(plan.jobs) / (matched - planned), 2), "genotypes_per_s": round(n * sites / (done - began))}))


if __name__ == "__main__":
    main()
