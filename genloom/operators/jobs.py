"""Match jobs: one row a haplotype, with individuals, populations, spans and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genloom.operators.numbering import numbered

JOB_FIELDS = ("haplotype_index", "source", "sample_id", "ploidy_index", "time", "start_position", "end_position", "group", "node_flags", "individual_id", "population_id", "sample_chunk")


def first_seen_ids(rows: DataFrame, keys: list[str], order: Column, out: str) -> DataFrame:
    """``keys`` with dense ids from 0 by first appearance."""
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    return numbered(firsts, ["_first"], out).drop("_first")


def haplotype_rows(samples: DataFrame) -> DataFrame:
    """Samples of ``source_ord, source, sample_idx, sample_id, ploidy`` as haplotypes, numbered by source, sample and ploidy."""
    each = samples.withColumn("ploidy_index", F.explode(F.sequence(F.lit(0), F.col("ploidy") - 1)))
    return numbered(each, ["source_ord", "sample_idx", "ploidy_index"], "haplotype_index")


def permutation(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """``wanted`` with ``column``: by source, id and ploidy; else by id and ploidy from the first source; else -1."""
    exact = present.select("source", "sample_id", "ploidy_index", F.col("column").alias("_exact"))
    loose = present.groupBy("sample_id", "ploidy_index").agg(F.min_by("column", "source_ord").alias("_loose"))
    joined = wanted.join(exact, ["source", "sample_id", "ploidy_index"], "left").join(loose, ["sample_id", "ploidy_index"], "left")
    return joined.withColumn("column", F.coalesce("_exact", "_loose", F.lit(-1))).drop("_exact", "_loose")


def as_json(jobs: DataFrame) -> DataFrame:
    """``group, haplotype_index, json`` with one JSON object a job, in order of group and haplotype."""
    fields = [F.col(c) for c in JOB_FIELDS if c in jobs.columns]
    rows = jobs.select("group", "haplotype_index", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
    return rows.orderBy("group", "haplotype_index")


def progress(jobs: DataFrame) -> DataFrame:
    """Per group, in order: its haplotypes, those done after it, the same in per cent, and the median size of all groups."""
    counts = jobs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_total"), F.percentile("n", F.lit(0.5)).alias("median_n"))
    done = F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0))  # a row a group
    told = counts.withColumn("done", done).join(F.broadcast(whole))
    return told.withColumn("percent", F.col("done") * 100.0 / F.col("_total")).drop("_total")


def histogram(jobs: DataFrame, width: int = 60) -> DataFrame:
    """Per group: count, distinct sample chunks, mean and population variance of spans in kb, and a bar."""
    kb = (F.col("end_position") - F.col("start_position")) / 1000.0
    sums = jobs.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source", "sample_chunk").alias("chunks"), F.avg(kb).alias("mean_kb"), F.var_pop(kb).alias("var_kb"))
    most = sums.agg(F.max("n").alias("_most"))
    bar = F.bround(F.col("n") / F.col("_most") * width, 0).cast("int")
    return sums.join(F.broadcast(most)).withColumn("bar", F.repeat(F.lit("#"), bar)).drop("_most")
