"""Scalar functions of the domain, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genloom.operators.treekernel import COMPRESSED, SAMPLE


def has_flag(flags: Column | str, flag: int) -> Column:
    """Whether a bit is set in node flags; a null has none."""
    flags = F.col(flags) if isinstance(flags, str) else flags
    return F.coalesce(flags.bitwiseAND(F.lit(flag)) != 0, F.lit(False))


def is_sample(flags: Column | str) -> Column:
    return has_flag(flags, SAMPLE)


def is_compressed(flags: Column | str) -> Column:
    """Whether a node was made by path compression."""
    return has_flag(flags, COMPRESSED)


def without_padding(alleles: Column | str) -> Column:
    """Alleles without the empty ones at the end; empty ones before a real allele stay."""
    alleles = F.col(alleles) if isinstance(alleles, str) else alleles
    places = F.transform(alleles, lambda a, i: F.when(a != "", i + 1).otherwise(0))
    return F.slice(alleles, F.lit(1), F.coalesce(F.array_max(places), F.lit(0)))


def ancestor_name(ancestor: Column | str) -> Column:
    """``a0``, ``a1`` ... of an ancestor's number."""
    ancestor = F.col(ancestor) if isinstance(ancestor, str) else ancestor
    return F.concat(F.lit("a"), ancestor.cast("string"))
