"""Several sources as one: sites, allele dictionaries, canonical genotypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_positions(rows: DataFrame, position: str = "position", source: str | None = None) -> DataFrame:
    """Positions that occur once (in their source); the others go altogether."""
    keys = [position] if source is None else [source, position]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def annotated(rows: DataFrame, annotation: DataFrame) -> DataFrame:
    """Rows whose position the annotation has."""
    return rows.join(annotation.select("position"), "position", "left_semi")


def row_number(rows: DataFrame) -> Column:
    """What orders rows of one position: their column ``row``, else their order as they are read."""
    return F.col("row") if "row" in rows.columns else F.monotonically_increasing_id()


def first_annotation(annotation: DataFrame) -> DataFrame:
    """``position, ancestral_allele``: of several rows of a position the first counts."""
    rows = annotation.select("position", "ancestral_allele", row_number(annotation).alias("_row"))
    return rows.groupBy("position").agg(F.min_by("ancestral_allele", "_row").alias("ancestral_allele"))


def last_calls(rows: DataFrame) -> DataFrame:
    """``position, alleles, calls``: of several rows of a position the last counts."""
    numbered = rows.select("position", F.struct("alleles", "calls").alias("_v"), row_number(rows).alias("_row"))
    return numbered.groupBy("position").agg(F.max_by("_v", "_row").alias("_v")).select("position", "_v.alleles", "_v.calls")


def position_union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0].select("position")
    for f in frames[1:]:
        out = out.unionByName(f.select("position"))
    return out.distinct()


def exclude_positions(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("position"), "position", "left_anti")


def ancestral_index(alleles: Column, ancestral: Column) -> Column:
    """Index of the first allele that is the ancestral one; null if none is, and the empty one never is."""
    at = F.array_position(alleles, ancestral)
    return F.when((at > 0) & (ancestral != ""), (at - 1).cast("int"))


def polarised(call: Column, ancestral: Column) -> Column:
    """0 for the ancestral allele, 1 for another, -1 for missing."""
    return F.when(call < 0, -1).when(call == ancestral, 0).otherwise(1).cast("tinyint")


def raw_genotypes(variants: DataFrame, positions: DataFrame, haplotypes: Sequence[int] | None = None) -> DataFrame:
    """``position, calls`` as stored, at the given positions; of the given haplotypes, in their order, or of all."""
    found = variants.join(positions.select("position"), "position", "left_semi")
    if haplotypes is None:
        return found.select("position", "calls")
    wanted = F.split(F.lit(",".join(map(str, haplotypes))), ",") if haplotypes else F.array().cast("array<string>")
    return found.select("position", F.transform(wanted, lambda i: F.get("calls", i.cast("int"))).alias("calls"))


def derived_genotypes(variants: DataFrame, indexes: DataFrame, haplotypes: Sequence[int] | None = None) -> DataFrame:
    """``position, calls`` of 0 (ancestral), 1 (another allele) and -1, at the positions of ``position, ancestral_index``."""
    raw = raw_genotypes(variants, indexes, haplotypes).join(indexes.select("position", "ancestral_index"), "position")
    return raw.select("position", F.transform("calls", lambda c: polarised(c, F.col("ancestral_index"))).alias("calls"))


def dictionaries(sources: Sequence[DataFrame], annotation: DataFrame) -> DataFrame:
    """``position, dictionary``: the ancestral allele, then unseen non-empty ones by source and allele order."""
    rows = None
    for k, s in enumerate(sources):
        part = s.select("position", F.struct(F.lit(k).alias("ord"), row_number(s).alias("row"), F.col("alleles").alias("alleles")).alias("one"))
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy("position").agg(F.sort_array(F.collect_list("one")).alias("all"))
    seen = F.filter(F.flatten(F.transform("all", lambda s: s["alleles"])), lambda a: a != "")
    both = annotation.join(merged, "position", "left")
    return both.select("position", F.array_distinct(F.concat(F.array("ancestral_allele"), F.coalesce(seen, F.array().cast("array<string>")))).alias("dictionary"))


def encode(allele: Column, dictionary: Column) -> Column:
    """Canonical code of an allele string; -1 if the dictionary lacks it."""
    return (F.coalesce(F.array_position(dictionary, allele), F.lit(0)) - 1).cast("int")


def decode(code: Column, dictionary: Column) -> Column:
    return F.get(dictionary, code)


def canonical(calls: Column, alleles: Column, dictionary: Column) -> Column:
    """Calls of one source as canonical codes."""
    return F.transform(calls, lambda c: F.when(c < 0, -1).otherwise(encode(F.get(alleles, c.cast("int")), dictionary)).cast("tinyint"))


def unified(sources: Sequence[tuple[DataFrame, DataFrame, int]], annotation: DataFrame) -> DataFrame:
    """``position, ancestral, dictionary, codes`` over all sources.

    Each source is its rows after filters, all its rows, and its number of
    haplotypes. A position that occurs twice among all rows of a source is none of its;
    one its filters dropped, or that it lacks, is missing for its haplotypes.
    Dictionaries come from all rows, filtered or not.
    """
    first = first_annotation(annotation)
    single = []
    for kept, every, _ in sources:
        once = unique_positions(every)
        single.append(kept.join(once, "position", "left_semi"))
    sites = annotated(position_union([every.join(unique_positions(every), "position", "left_semi") for _, every, _ in sources]), first)
    words = dictionaries([every for _, every, _ in sources], first)
    out = sites.join(words, "position")
    pieces = []
    for k, (rows, (_, _, n)) in enumerate(zip(single, sources)):
        out = out.join(rows.select("position", F.col("alleles").alias(f"_a{k}"), F.col("calls").alias(f"_c{k}")), "position", "left")
        missing = F.array_repeat(F.lit(-1).cast("tinyint"), n)
        pieces.append(F.coalesce(canonical(F.col(f"_c{k}"), F.col(f"_a{k}"), F.col("dictionary")), missing))
    return out.select("position", F.get("dictionary", F.lit(0)).alias("ancestral"), "dictionary", F.concat(*pieces).alias("codes"))
