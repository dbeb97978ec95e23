"""Commands: infer-ancestors, match, post-process, augment-sites, run, show-match-jobs, config."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genloom.config import Config
from genloom.operators.jobs import histogram
from genloom.plans import pipeline, runner


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="genloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def shared(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("config")
        p.add_argument("-t", "--threads", type=int, default=1, help="ignored: Spark decides")
        p.add_argument("-f", "--force", action="store_true", help="replace an existing output")
        p.add_argument("-p", "--progress", action="store_true", help="show Spark's progress")
        p.add_argument("-v", "--verbose", action="count", default=0)
        p.add_argument("-l", "--log-file")
        return p

    p = shared("infer-ancestors", "make ancestral haplotypes")
    p.add_argument("-w", "--write-threads", type=int, default=4, help="ignored")
    p.add_argument("--genotype-encoding", choices=("eight_bit", "one_bit"), default="eight_bit", help="ignored: one byte a call")
    p = shared("match", "match ancestors and samples")
    p.add_argument("-w", "--workdir")
    p.add_argument("--keep-intermediates", action="store_true")
    p.add_argument("-c", "--cache-size", type=int, default=256, help="ignored")
    p.add_argument("--group-stop", type=int)
    p.add_argument("--read-workers", type=int, default=1, help="ignored")
    p.add_argument("--match-file")
    p = shared("post-process", "clip flanks and simplify")
    p.add_argument("--input", required=True)
    p = shared("augment-sites", "place further sites")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p = shared("run", "all steps")
    p.add_argument("-c", "--cache-size", type=int, default=256, help="ignored")
    p.add_argument("--genotype-encoding", choices=("eight_bit", "one_bit"), default="eight_bit", help="ignored")
    p.add_argument("--read-workers", type=int, default=1, help="ignored")
    p.add_argument("--match-file")
    p = commands.add_parser("show-match-jobs", help="sizes of the groups of a work directory")
    p.add_argument("file")
    p = commands.add_parser("config", help="show or check a configuration")
    p.add_argument("action", choices=("show", "check"))
    p.add_argument("config")
    return out


def _guard(spark: SparkSession, path: str, force: bool) -> str:
    if runner.exists(spark, path) and not force:
        raise ValueError(f"{path} exists already; use --force to replace it")
    return "overwrite" if force else "errorifexists"


def show_jobs(spark: SparkSession, path: str) -> list[str]:
    schema = "source string, sample_chunk int, start_position long, end_position long, `group` int"
    jobs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("sample_chunk", F.coalesce("sample_chunk", F.lit(0)))
    return [f"{r['group']}\t{r['n']}\t{r['chunks']}\t{r['mean_kb']:.2f}\t{r['var_kb']:.2f}\t{r['bar']}" for r in histogram(jobs).orderBy("group").toLocalIterator()]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        if a.command == "config":
            cfg = Config.from_toml(a.config)
            if a.action == "show":
                print(cfg.format())
                return 0
            wrong = cfg.validate()
            print("\n".join(wrong) or "ok")
            return int(bool(wrong))
        spark = spark or SparkSession.builder.appName("genloom").getOrCreate()
        if a.command == "show-match-jobs":
            print("\n".join(show_jobs(spark, a.file)))
            return 0
        cfg = Config.from_toml(a.config)
        if a.command == "infer-ancestors":
            runner.infer_ancestors(spark, cfg, a.force)
        elif a.command == "match":
            mode = _guard(spark, cfg.match.output, a.force)
            cfg.match.workdir = a.workdir or cfg.match.workdir
            cfg.match.keep_intermediates |= a.keep_intermediates
            pipeline.write_graph(spark, runner.match(spark, cfg, a.group_stop, a.match_file), cfg.match.output, mode)
        elif a.command == "post-process":
            out = runner.post_process(pipeline.read_graph(spark, a.input), cfg)
            pipeline.write_graph(spark, out, cfg.match.output, _guard(spark, cfg.match.output, a.force))
        elif a.command == "augment-sites":
            mode = _guard(spark, a.output, a.force)
            pipeline.write_graph(spark, runner.augment_sites(spark, pipeline.read_graph(spark, a.input), cfg), a.output, mode)
        elif a.command == "run":
            mode = _guard(spark, cfg.match.output, a.force)
            pipeline.write_graph(spark, runner.run(spark, cfg, a.match_file), cfg.match.output, mode)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
