"""Stores of phased genotypes as DataFrames, and the values that fields resolve to."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genloom.sources.filters import filter_variants, select_samples

#: A site-major store: one row a site, calls in sample order, then ploidy; -1 is missing.
#: A column ``row`` orders rows of one position; ``write_store`` adds it.
VARIANTS = "position int, alleles array<string>, calls array<tinyint>, contig_id string"
SAMPLES = "sample_idx int, sample_id string, ploidy int"


@dataclass(frozen=True)
class Store:
    """``variants`` (VARIANTS and any further columns), ``samples`` (SAMPLES and further), and the contig's length."""

    variants: DataFrame
    samples: DataFrame
    length: int
    extras: dict[str, DataFrame] = field(default_factory=dict)

    def narrowed(self, include: str | None = None, exclude: str | None = None, regions: str | None = None, targets: str | None = None) -> Store:
        return replace(self, variants=filter_variants(self.variants, include, exclude, regions, targets))

    def of_samples(self, selection: str | None) -> Store:
        """Only the chosen samples, in store order; calls are cut to match."""
        if selection is None:
            return self
        chosen = select_samples(self.samples, selection)
        begin = Window.orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
        spans = self.samples.withColumn("_at", F.coalesce(F.sum("ploidy").over(begin), F.lit(0)))
        spans = spans.join(chosen.select("sample_idx"), "sample_idx", "left_semi")
        wanted = ",".join(str(a + k) for a, p in sorted((r["_at"], r["ploidy"]) for r in spans.select("_at", "ploidy").collect()) for k in range(p))
        # one literal however many haplotypes are chosen
        cut = F.transform(F.split(F.lit(wanted), ","), lambda i: F.get("calls", i.cast("int"))) if wanted else F.array().cast("array<tinyint>")
        return replace(self, variants=self.variants.withColumn("calls", cut), samples=chosen)

    def haplotypes(self) -> int:
        return int(self.samples.agg(F.coalesce(F.sum("ploidy"), F.lit(0))).first()[0])


def open_store(source: str | Store, spark: SparkSession | None = None) -> Store:
    """A store at a path that Spark reads, or the one given."""
    if isinstance(source, Store):
        return source
    read = spark.read
    length = read.parquet(f"{source}/contigs").orderBy("contig_idx").first()["length"]
    return Store(read.parquet(f"{source}/variants"), read.parquet(f"{source}/samples"), int(length))


def write_store(store: Store, path: str, mode: str = "errorifexists") -> None:
    """Variants by position, so row groups prune; an existing store is refused unless ``mode`` says otherwise."""
    spark = store.variants.sparkSession
    numbered = store.variants if "row" in store.variants.columns else store.variants.withColumn("row", F.monotonically_increasing_id())
    numbered.repartitionByRange("position").sortWithinPartitions("position", "row").write.mode(mode).option("compression", "zstd").parquet(f"{path}/variants")
    store.samples.write.mode(mode).parquet(f"{path}/samples")
    contig = spark.range(1).select(F.col("id").cast("int").alias("contig_idx"), F.lit("1").alias("id"), F.lit(store.length).cast("long").alias("length"))
    contig.write.mode(mode).parquet(f"{path}/contigs")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key: the value of the last row by ``order``."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def resolve_field(base: DataFrame, key: str, spec: object, out: str, fill: object = None, spark: SparkSession | None = None, order: str | None = None) -> DataFrame:
    """``base`` with column ``out`` by a field spec.

    A name is a column of ``base``, a number a constant, None nothing, and
    ``{"path": ..., "field": ...}`` (``path`` may be a DataFrame) a left join on
    ``key`` where the last of several rows wins and ``fill`` stands for none.
    """
    if spec is None:
        return base
    if isinstance(spec, bool) or not isinstance(spec, str | int | float | dict):
        raise TypeError(f"not a field spec: {spec!r}")
    if isinstance(spec, str):
        return base.withColumn(out, F.col(spec))
    if isinstance(spec, int | float):
        return base.withColumn(out, F.lit(spec))
    if "path" not in spec or "field" not in spec:
        raise ValueError("a joined field needs path and field")
    other = spec["path"] if isinstance(spec["path"], DataFrame) else spark.read.parquet(spec["path"])
    if order is None:
        order = "_row"
        other = other.withColumn(order, F.monotonically_increasing_id())
    found = last_wins(other.select(key, F.col(spec["field"]).alias(out), order), key, out, order)
    joined = base.drop(out).join(found, key, "left")
    return joined if fill is None else joined.withColumn(out, F.coalesce(F.col(out), F.lit(fill)))
