"""Variant filters: a small expression language, regions, sample selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<name>[A-Za-z_][\w.]*)|(?P<op>&&|\|\||==|!=|<=|>=|[=<>&|!()-]))")


def _name(name: str, columns: list[str]) -> str:
    """The SQL of a field: POS, QUAL, FILTER, TYPE, N_ALT, AC, or a column."""
    known = {
        "POS": "position",
        "N_ALT": "(size(filter(alleles, a -> a <> '')) - 1)",
        "TYPE": "(CASE WHEN forall(filter(alleles, a -> a <> ''), a -> length(a) = 1) THEN 'snp' ELSE 'other' END)",
        "AC": "size(filter(calls, c -> c > 0))",
    }
    if name in known:
        return known[name]
    for column in (name, f"variant_{name.lower()}", f"variant_{name}", name.lower()):
        if column in columns:
            return f"`{column}`"
    raise ValueError(f"no field is named {name}")


def to_sql(expression: str, columns: list[str]) -> str:
    """SQL of a filter expression.

    Comparisons ``= == != < <= > >=`` of fields, numbers and quoted text,
    joined by ``& && | ||``, with ``!`` and parentheses; ``&`` binds tighter.
    """
    tokens, at = [], 0
    expression = expression.rstrip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"can't read the filter at: {expression[at:]}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    tokens.append(("end", ""))
    k = 0

    def take(*wanted: str) -> str | None:
        nonlocal k
        if tokens[k][0] == "op" and tokens[k][1] in wanted:
            k += 1
            return tokens[k - 1][1]
        return None

    def value() -> str:
        nonlocal k
        if take("("):
            inner = either()
            if not take(")"):
                raise ValueError("a parenthesis is not closed")
            return f"({inner})"
        if take("-"):
            return f"-{value()}"
        kind, text = tokens[k]
        k += 1
        if kind == "number":
            return text
        if kind == "text":
            return "'" + text[1:-1].replace("'", "''") + "'"
        if kind == "name":
            return _name(text, columns)
        raise ValueError(f"a value is missing in: {expression}")

    def compared() -> str:
        if take("!"):
            return f"(NOT {compared()})"
        left = value()
        op = take("=", "==", "!=", "<=", ">=", "<", ">")
        return f"({left} {'=' if op == '==' else op} {value()})" if op else left

    def both() -> str:
        out = compared()
        while take("&", "&&"):
            out = f"({out} AND {compared()})"
        return out

    def either() -> str:
        out = both()
        while take("|", "||"):
            out = f"({out} OR {both()})"
        return out

    sql = either()
    if tokens[k][0] != "end":
        raise ValueError(f"something is left over in: {expression}")
    return sql


def region(spec: str) -> Column:
    """``contig``, ``contig:start-end``, ``contig:start`` or ``contig:start-``; positions count from 1, both ends in."""
    contig, _, span = spec.partition(":")
    cond = F.col("contig_id") == contig
    if span:
        start, dash, end = span.replace(",", "").partition("-")
        cond = cond & (F.col("position") >= int(start))
        if not dash:
            cond = cond & (F.col("position") <= int(start))
        elif end:
            cond = cond & (F.col("position") <= int(end))
    return cond


def filter_variants(variants: DataFrame, include: str | None = None, exclude: str | None = None, regions: str | None = None, targets: str | None = None) -> DataFrame:
    """Rows that pass; ``exclude`` drops rows for which it is true, not those where it is unknown."""
    if include is not None:
        variants = variants.where(to_sql(include, variants.columns))
    if exclude is not None:
        variants = variants.where(f"NOT coalesce({to_sql(exclude, variants.columns)}, false)")
    for spec in (regions, targets):
        if spec is not None:
            any_of = F.lit(False)
            for part in spec.split(","):
                any_of = any_of | region(part)
            variants = variants.where(any_of)
    return variants


def select_samples(samples: DataFrame, selection: str | None) -> DataFrame:
    """``a,b`` keeps those samples, ``^a,b`` keeps the others, None keeps all; an unknown name is an error."""
    if selection is None:
        return samples
    names = [s for s in selection.lstrip("^").split(",") if s]
    known = {r[0] for r in samples.where(F.col("sample_id").isin(names)).select("sample_id").collect()}
    if missing := set(names) - known:
        raise ValueError(f"no such samples: {', '.join(sorted(missing))}")
    chosen = F.col("sample_id").isin(names)
    return samples.where(~chosen if selection.startswith("^") else chosen)
