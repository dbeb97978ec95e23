"""Site statistics, the polymorphism filter, times and sequence intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genloom.operators.unify import ancestral_index, first_annotation


@dataclass(frozen=True)
class InferenceSites:
    """Sites whose ancestral allele is one of their alleles: ``position, alleles, ancestral_index``."""

    rows: DataFrame

    @classmethod
    def of(cls, variants: DataFrame, annotation: DataFrame) -> InferenceSites:
        """Rows of ``variants`` that the annotation has, without those that it gives another allele."""
        both = variants.select("position", "alleles").join(first_annotation(annotation), "position")
        index = ancestral_index(F.col("alleles"), F.col("ancestral_allele"))
        return cls(both.select("position", "alleles", index.alias("ancestral_index")).where("ancestral_index is not null"))


def stats_of_codes(codes: Column) -> tuple[Column, Column]:
    """Numbers of derived and of called haplotypes in an array of codes."""
    return F.size(F.filter(codes, lambda c: c > 0)), F.size(F.filter(codes, lambda c: c >= 0))


def polymorphic(rows: DataFrame) -> DataFrame:
    """Rows with a call, a derived one and an ancestral one."""
    return rows.where("called > 0 AND derived > 0 AND derived < called")


def site_stats(long: DataFrame, haplotypes: int) -> DataFrame:
    """``position, derived, called, time`` of ``position, code`` rows; time is derived over all haplotypes, missing ones too."""
    sums = long.groupBy("position").agg(F.sum((F.col("code") > 0).cast("int")).alias("derived"), F.sum((F.col("code") >= 0).cast("int")).alias("called"))
    return polymorphic(sums).withColumn("time", F.col("derived") / F.lit(float(haplotypes)))


def inference_sites(unified: DataFrame, haplotypes: int) -> DataFrame:
    """Polymorphic sites of ``unified`` with ``derived, called, time`` and ``calls`` of 0, 1 and -1."""
    derived, called = stats_of_codes(F.col("codes"))
    rows = unified.withColumns({"derived": derived, "called": called, "calls": F.transform("codes", lambda c: F.least(c, F.lit(1).cast("tinyint")))})
    return polymorphic(rows).withColumn("time", F.col("derived") / F.lit(float(haplotypes)))


def with_interval(sites: DataFrame, max_gap: int, contig: str | None = None) -> DataFrame:
    """``sites`` with ``interval_idx``: a new one after each gap of more than ``max_gap``, numbered from 0."""
    keys = [contig] if contig else []
    slim = intervals_of(sites.select(*keys, "position"), max_gap, contig)
    return sites.join(slim, [*keys, "position"])


def intervals_of(positions: DataFrame, max_gap: int, contig: str | None = None) -> DataFrame:
    """Distinct ``position`` (and ``contig``) with ``interval_idx``.

    Positions are dealt to stretches of the genome, in each of which neighbours
    are compared; only the first and last position of each stretch, with the
    number of gaps in it, meet in one task. So no task gets a whole genome, and
    genotypes are not moved at all.
    """
    keys = [contig] if contig else []
    width = max(1 << 20, 2 * max_gap)
    cut = positions.distinct().withColumn("_bin", F.floor(F.col("position") / width))
    inside = Window.partitionBy(*keys, "_bin").orderBy("position")
    gap = F.col("position") - F.lag("position").over(inside)
    cut = cut.withColumn("_local", F.sum(F.when(gap > max_gap, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    bins = cut.groupBy(*keys, "_bin").agg(F.min("position").alias("_lo"), F.max("position").alias("_hi"), F.max("_local").alias("_n"))
    order = (Window.partitionBy(*keys) if keys else Window).orderBy("_bin")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_new", F.when(F.col("_lo") - F.lag("_hi").over(order) > max_gap, 1).otherwise(0))
    bins = bins.withColumn("_base", F.sum("_new").over(before) + F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = cut.join(bins.select(*keys, "_bin", "_base"), [*keys, "_bin"])
    return joined.select(*keys, "position", (F.col("_base") + F.col("_local")).cast("int").alias("interval_idx"))


def sequence_intervals(sites: DataFrame, max_gap: int, contig: str | None = None) -> DataFrame:
    """``interval_idx, start, end`` (half-open) of the runs of sites."""
    keys = [contig, "interval_idx"] if contig else ["interval_idx"]
    return with_interval(sites, max_gap, contig).groupBy(*keys).agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end"))


def in_intervals(points: DataFrame, intervals: DataFrame, bin_size: int) -> DataFrame:
    """``points`` with ``start, end`` of the interval that holds their position: an equi-join on bins and a residual test.

    An interval is listed in each bin that it touches, so choose bins about as
    long as intervals.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size)))
    cut = intervals.where("start < end").withColumn("_bin", bins)
    keyed = points.withColumn("_bin", F.floor(F.col("position") / bin_size))
    return keyed.join(cut, "_bin").where("position >= start AND position < end").drop("_bin")
