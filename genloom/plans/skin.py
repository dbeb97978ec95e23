"""The synthetic tables read as genotypes: what stands for sites, haplotypes, alleles and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.session import table

HAPLOTYPES = 16


def position(key: str) -> Column:
    return ((F.col(key) + 1) * 100).cast("long")


def calls(spark: SparkSession, sf_dir: str, haplotypes: int = HAPLOTYPES) -> DataFrame:
    """``position, h, raw``: parts are sites, suppliers modulo ``haplotypes`` haplotypes, the line status the allele."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
    both = rows.groupBy(position("l_partkey").alias("position"), (F.col("l_suppkey") % haplotypes).cast("int").alias("h"))
    return both.agg(F.max((F.col("l_linestatus") == "O").cast("int")).alias("raw"))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``position, ancestral_allele``; X is an allele that no site has."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(position("p_partkey").alias("position"), F.when(size % 7 == 0, "X").when(size % 5 == 0, "O").otherwise("F").alias("ancestral_allele"))


def derived(spark: SparkSession, sf_dir: str, haplotypes: int = HAPLOTYPES) -> DataFrame:
    """``position, h, code``: 0 where the call is the ancestral allele, else 1."""
    allele = F.when(F.col("raw") == 1, "O").otherwise("F")
    coded = calls(spark, sf_dir, haplotypes).join(annotation(spark, sf_dir), "position")
    return coded.select("position", "h", (allele != F.col("ancestral_allele")).cast("int").alias("code"))


def matrix(spark: SparkSession, sf_dir: str, haplotypes: int = HAPLOTYPES) -> DataFrame:
    """``position, calls``: an array of codes by haplotype, -1 where there is none."""
    d = derived(spark, sf_dir, haplotypes)
    cells = [F.coalesce(F.max(F.when(F.col("h") == k, F.col("code"))), F.lit(-1)).cast("tinyint") for k in range(haplotypes)]
    return d.groupBy("position").agg(F.array(*cells).alias("calls"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, start, end, time``: the seconds between a user's first and last event, and their number."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    second = F.unix_timestamp(F.date_trunc("second", "ts"))
    return e.groupBy("user_id").agg(F.min(second).alias("start"), (F.max(second) + 1).alias("end"), F.count(F.lit(1)).cast("double").alias("time"))


#: The same in DuckDB, as common table expressions.
SQL = f"""
c AS (SELECT 100 * (l_partkey + 1) AS position, CAST(l_suppkey % {HAPLOTYPES} AS INTEGER) AS h,
             CASE WHEN max(l_linestatus) = 'O' THEN 1 ELSE 0 END AS raw FROM lineitem GROUP BY 1, 2),
a AS (SELECT 100 * (p_partkey + 1) AS position,
             CASE WHEN p_size % 7 = 0 THEN 'X' WHEN p_size % 5 = 0 THEN 'O' ELSE 'F' END AS ancestral_allele FROM part),
d AS (SELECT c.position, c.h, CASE WHEN (CASE WHEN raw = 1 THEN 'O' ELSE 'F' END) <> ancestral_allele THEN 1 ELSE 0 END AS code
      FROM c JOIN a ON c.position = a.position)"""
SPANS_SQL = """
sp AS (SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS s, CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) + 1 AS e,
              CAST(count(*) AS DOUBLE) AS t FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"""
