"""One registered query for each operator, over the synthetic tables, with the SQL that DuckDB answers the same."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from genloom.functions import ancestor_name, is_compressed, without_padding
from genloom.operators import grouping, jobs, lshmm, sites, tables, unify
from genloom.operators.ancestors import build, described, packed_sites, transpose
from genloom.operators.matching import active_frame, extend, make_root, match_frame
from genloom.operators.numbering import numbered
from genloom.operators.treekernel import Graph
from genloom.plans import skin
from genloom.session import from_arrow, scratch, table
from genloom.sources.catalog import Store, open_store, resolve_field, write_store
from genloom.sources.filters import filter_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@query("q01_site_stats", f"""WITH {skin.SQL} SELECT position, CAST(sum(code) AS BIGINT) AS derived, count(*) AS called, sum(code) / 16.0 AS time
FROM d GROUP BY position HAVING sum(code) > 0 AND sum(code) < count(*)""")
def q01(spark: SparkSession, sf: str) -> DataFrame:
    return sites.site_stats(skin.derived(spark, sf), skin.HAPLOTYPES)


@query("q02_variant_filter", """SELECT 100 * (p_partkey + 1) AS position, p_size AS qual FROM part
WHERE ((100 * (p_partkey + 1) >= 1000 AND p_size > 10) OR p_size = 3) AND NOT coalesce(p_brand = 'Brand#11' OR p_size >= 45, false)""")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "part").select(skin.position("p_partkey").alias("position"), F.col("p_size").alias("qual"), F.col("p_brand").alias("filter"))
    return filter_variants(v, include="POS >= 1000 & QUAL > 10 | QUAL == 3", exclude="FILTER = 'Brand#11' || QUAL >= 45").select("position", "qual")


@query("q03_derived_genotypes", f"""WITH {skin.SQL}, g AS (SELECT position, h, ancestral_allele FROM a, (SELECT CAST(range AS INTEGER) AS h FROM range(16)))
SELECT g.position, g.h, CASE WHEN raw IS NULL THEN -1 WHEN (CASE WHEN raw = 1 THEN 'O' ELSE 'F' END) = ancestral_allele THEN 0 ELSE 1 END AS code
FROM g LEFT JOIN c ON g.position = c.position AND g.h = c.h""")
def q03(spark: SparkSession, sf: str) -> DataFrame:
    grid = skin.annotation(spark, sf).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(15))))
    raw = grid.join(skin.calls(spark, sf), ["position", "h"], "left")
    ancestral = F.when(F.col("ancestral_allele") == "F", 0).when(F.col("ancestral_allele") == "O", 1).otherwise(9)
    return raw.select("position", "h", unify.polarised(F.coalesce("raw", F.lit(-1)), ancestral).cast("int").alias("code"))


@query("q04_haplotype_scan", f"""WITH {skin.SQL} SELECT a.position, CAST(g.range AS BIGINT) AS h, coalesce(d.code, -1) AS code
FROM a CROSS JOIN range(16) g LEFT JOIN d ON a.position = d.position AND d.h = g.range""")
def q04(spark: SparkSession, sf: str) -> DataFrame:
    haps, n = _haplotypes(spark, sf)
    byte = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.hex(F.substring("codes", i + 1, F.lit(1))))
    each = haps.select("hap", F.posexplode(byte).alias("site", "byte"))
    code = F.when(F.col("byte") == "FF", -1).otherwise(F.conv("byte", 16, 10).cast("int"))
    numbers = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("site"), skin.position("p_partkey").alias("position"))
    return each.join(numbers, "site").select("position", F.col("hap").alias("h"), code.alias("code"))


def _haplotypes(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """``hap, codes`` of the skin, a byte a part key, and the number of part keys."""
    n = table(spark, sf, "part").agg(F.max("p_partkey") + 1).first()[0]
    rows = skin.matrix(spark, sf).select((F.col("position") / 100 - 1).cast("int").alias("site"), F.col("calls").alias("codes"))
    return transpose(rows, n), n


@query("q05_resolve_field", """WITH r AS (SELECT c_nationkey, arg_max(c_acctbal, c_custkey) AS bal FROM customer WHERE c_acctbal > 9500 GROUP BY 1)
SELECT s_suppkey, coalesce(bal, 0.0) AS value FROM supplier LEFT JOIN r ON s_nationkey = c_nationkey""")
def q05(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    other = table(spark, sf, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    out = resolve_field(base, "nation", {"path": other, "field": "c_acctbal"}, "value", fill=0.0, order="c_custkey")
    return out.select("s_suppkey", "value")


@query("q06_ancestor_rows", f"""WITH {skin.SQL}, s AS (SELECT position, sum(code) / 16.0 AS time FROM d GROUP BY position HAVING sum(code) > 0 AND sum(code) < count(*)),
r AS (SELECT s.position, time, ancestral_allele, row_number() OVER (ORDER BY time DESC, s.position) - 1 AS k FROM s JOIN a ON s.position = a.position)
SELECT 'a' || k AS sample_id, time, position, ancestral_allele || '/' || CASE ancestral_allele WHEN 'F' THEN 'O' ELSE 'F' END AS alleles FROM r""")
def q06(spark: SparkSession, sf: str) -> DataFrame:
    s = sites.site_stats(skin.derived(spark, sf), skin.HAPLOTYPES)
    words = unify.dictionaries([skin.annotation(spark, sf).select("position", F.array(F.lit("F"), F.lit("O")).alias("alleles"))], skin.annotation(spark, sf))
    ranked = numbered(s.join(words, "position").withColumn("younger", -F.col("time")), ["younger", "position"], "rank")
    named = ranked.withColumn("sample_id", ancestor_name("rank"))
    return named.select("sample_id", "time", "position", F.array_join(F.slice(without_padding("dictionary"), 1, 2), "/").alias("alleles"))


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as samples of two sources; accounts as times, keys as spans."""
    s = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 2).cast("int").alias("source_ord"), F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("source"), F.col("s_suppkey").alias("sample_idx"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("sample_id"),
        (F.col("s_suppkey") % 3 + 1).cast("int").alias("ploidy"), F.col("s_nationkey").cast("double").alias("time"), (F.col("s_suppkey") * 10).cast("long").alias("start_position"), (F.col("s_suppkey") * 10 + 500).cast("long").alias("end_position"))
    rows = jobs.haplotype_rows(s)
    level = grouping.assign_groups(rows.select(F.col("haplotype_index").alias("ord"), F.col("start_position").alias("start"), F.col("end_position").alias("end"), "time"))
    return rows.join(level.select(F.col("ord").alias("haplotype_index"), F.col("grp").alias("group")), "haplotype_index").withColumn("node_flags", F.lit(1)).withColumn("sample_chunk", (F.col("sample_idx") / 10).cast("int"))


@query("q07_match_jobs_json", """WITH RECURSIVE o AS (SELECT s_suppkey, s_suppkey % 2 AS so, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, 's' || s_nationkey AS id, CAST(p.range AS INTEGER) AS p,
  CAST(s_nationkey AS DOUBLE) AS t, s_suppkey * 10 AS s, s_suppkey * 10 + 500 AS e FROM supplier, range(3) p WHERE p.range <= s_suppkey % 3),
j AS (SELECT *, row_number() OVER (ORDER BY so, s_suppkey, p) - 1 AS i FROM o),
m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY t ORDER BY s, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM j),
r AS (SELECT *, sum(n) OVER (PARTITION BY t ORDER BY s, i ROWS UNBOUNDED PRECEDING) AS run FROM m), g AS (SELECT t, run, min(s) AS s, max(e) AS e FROM r GROUP BY t, run),
l AS (SELECT t, run, s, e, 0 AS lvl FROM g UNION SELECT y.t, y.run, y.s, y.e, l.lvl + 1 FROM l JOIN g y ON y.t < l.t AND y.s < l.e AND l.s < y.e),
k AS (SELECT t, run, CAST(max(lvl) AS BIGINT) AS grp FROM l GROUP BY t, run)
SELECT grp AS "group", i AS haplotype_index, '{"haplotype_index":' || i || ',"source":"' || source || '","sample_id":"' || id || '","ploidy_index":' || p || ',"time":' || CAST(r.t AS VARCHAR) || ',"start_position":' || s
  || ',"end_position":' || e || ',"group":' || grp || ',"node_flags":1,"sample_chunk":' || (s_suppkey // 10) || '}' AS json FROM r JOIN k ON r.t = k.t AND r.run = k.run""")
def q07(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.as_json(_jobs(spark, sf))


@query("q08_region_filter", "SELECT 100 * (p_partkey + 1) AS position, p_name AS name FROM part WHERE 100 * (p_partkey + 1) BETWEEN 7000 AND 12000 OR 100 * (p_partkey + 1) = 5500")
def q08(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "part").select(skin.position("p_partkey").alias("position"), F.col("p_name").alias("name"), F.lit("1").alias("contig_id"))
    return filter_variants(v, regions="1:5000-12000", targets="1:7000-,1:5500,2:1-6000").select("position", "name")


@query("q09_sample_select", """SELECT s_suppkey, s_name, CASE WHEN s_nationkey IN (1, 2, 3) THEN 'kept' ELSE 'others' END AS part FROM supplier""")
def q09(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("sample_id", F.col("s_nationkey").cast("string"))
    known = [str(r[0]) for r in s.where("s_nationkey in (1, 2, 3)").select("s_nationkey").distinct().collect()] or [str(s.first()["s_nationkey"])]
    from genloom.sources.filters import select_samples

    keep = select_samples(s, ",".join(known)).withColumn("part", F.lit("kept"))
    rest = select_samples(s, "^" + ",".join(known)).withColumn("part", F.lit("others"))
    return keep.unionByName(rest).select("s_suppkey", "s_name", "part")


@query("q10_duplicate_positions", "SELECT o_custkey AS position FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    return unify.unique_positions(table(spark, sf, "orders").select(F.col("o_custkey").alias("position")))


@query("q11_annotated_sites", f"""WITH {skin.SQL}, p AS (SELECT DISTINCT position FROM c) SELECT p.position, CASE ancestral_allele WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS ancestral_index
FROM p JOIN a ON p.position = a.position WHERE ancestral_allele IN ('F', 'O')""")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    found = skin.calls(spark, sf).select("position").distinct()
    known = unify.annotated(found, skin.annotation(spark, sf)).join(skin.annotation(spark, sf), "position")
    index = unify.ancestral_index(F.array(F.lit("F"), F.lit("O")), F.col("ancestral_allele"))
    return known.select("position", index.alias("ancestral_index")).where("ancestral_index is not null")


@query("q12_positions_in_intervals", """WITH i AS (SELECT 1000 * s_suppkey AS s, 1000 * s_suppkey + 300 AS e FROM supplier)
SELECT o_orderkey AS position, i.s AS "start" FROM (SELECT DISTINCT o_orderkey FROM orders) o JOIN i ON o_orderkey >= i.s AND o_orderkey < i.e""")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position")).distinct()
    i = table(spark, sf, "supplier").select((F.col("s_suppkey") * 1000).alias("start"), (F.col("s_suppkey") * 1000 + 300).alias("end"))
    return sites.in_intervals(points, i, 300).select("position", "start")


@query("q13_exclude_positions", "SELECT 100 * (p_partkey + 1) AS position FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    every = table(spark, sf, "part").select(skin.position("p_partkey").alias("position"))
    return unify.exclude_positions(every, table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(skin.position("l_partkey").alias("position")))


def _sources(spark: SparkSession, sf: str) -> list[tuple[DataFrame, DataFrame, int]]:
    """Even and odd haplotypes as two sources of eight; the odd one's alleles are the other way round, and it is filtered."""
    raw = skin.calls(spark, sf)
    slight = table(spark, sf, "part").where("p_size <= 45").select(skin.position("p_partkey").alias("position"))
    out = []
    for k, alleles in ((0, ("F", "O")), (1, ("O", "F"))):
        code = F.col("raw") if k == 0 else 1 - F.col("raw")
        cells = [F.coalesce(F.max(F.when(F.col("h") == 2 * j + k, code)), F.lit(-1)).cast("tinyint") for j in range(8)]
        rows = raw.where(f"h % 2 = {k}").groupBy("position").agg(F.array(*cells).alias("calls")).withColumn("alleles", F.array(*map(F.lit, alleles)))
        out.append((rows.join(slight, "position", "left_semi") if k else rows, rows, 8))
    return out


@query("q14_multi_source_rows", f"""WITH {skin.SQL}, p AS (SELECT position, max(CASE WHEN h % 2 = 0 THEN 1 ELSE 0 END) AS even FROM c GROUP BY position),
x AS (SELECT p.position, p.even, a.ancestral_allele, CAST(g.range % 2 AS INTEGER) AS k, CAST(g.range AS INTEGER) AS h FROM p JOIN a ON p.position = a.position CROSS JOIN range(16) g),
y AS (SELECT x.*, CASE WHEN x.k = 1 AND x.position IN (SELECT 100 * (p_partkey + 1) FROM part WHERE p_size > 45) THEN NULL WHEN c.raw = 1 THEN 'O' WHEN c.raw = 0 THEN 'F' END AS allele
      FROM x LEFT JOIN c ON x.position = c.position AND x.h = c.h)
SELECT position, string_agg(CASE WHEN allele IS NULL THEN '-1' WHEN allele = ancestral_allele THEN '0'
       WHEN ancestral_allele = 'X' AND allele = (CASE even WHEN 1 THEN 'O' ELSE 'F' END) THEN '2' ELSE '1' END, ',' ORDER BY k, h) AS codes FROM y GROUP BY position""")
def q14(spark: SparkSession, sf: str) -> DataFrame:
    out = unify.unified(_sources(spark, sf), skin.annotation(spark, sf))
    return out.select("position", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query("q15_active_range", f"""WITH {skin.SQL} SELECT g.range AS h, coalesce(min(position), 100) AS first_site, coalesce(max(position), (SELECT 100 * (max(p_partkey) + 1) FROM part)) AS last_site
FROM range(16) g LEFT JOIN d ON d.h = g.range AND code >= 0 GROUP BY g.range""")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    haps, _ = _haplotypes(spark, sf)
    return active_frame(haps).select("hap", ((F.col("first") + 1) * 100).alias("first_site"), (F.col("end") * 100).alias("last_site")).withColumnRenamed("hap", "h")


@query("q16_allele_dictionary", f"""WITH {skin.SQL}, f AS (SELECT 100 * (l_partkey + 1) AS position, l_returnflag AS allele, min(CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS src FROM lineitem GROUP BY 1, 2),
r AS (SELECT position, ancestral_allele AS allele, -1 AS src FROM a UNION ALL SELECT f.position, f.allele, f.src FROM f),
n AS (SELECT position, allele, row_number() OVER (PARTITION BY position ORDER BY src, allele) - 1 AS code FROM r)
SELECT position, allele, CAST(code AS INTEGER) AS code FROM n""")
def q16(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(skin.position("l_partkey").alias("position"), "l_returnflag", "l_linestatus")
    sources = [rows.where(F.col("l_linestatus") == s).groupBy("position").agg(F.sort_array(F.collect_set("l_returnflag")).alias("alleles")) for s in ("F", "O")]
    words = unify.dictionaries(sources, skin.annotation(spark, sf))
    each = words.select("position", "dictionary", F.explode("dictionary").alias("word"))
    code = unify.encode(F.col("word"), F.col("dictionary"))
    return each.select("position", "dictionary", code.alias("code")).select("position", unify.decode(F.col("code"), F.col("dictionary")).alias("allele"), "code")


@query("q17_sequence_intervals", f"""WITH {skin.SQL}, s AS (SELECT position FROM d GROUP BY position HAVING sum(code) > 0 AND sum(code) < count(*)),
b AS (SELECT position, CASE WHEN position - lag(position) OVER (ORDER BY position) > 200 THEN 1 ELSE 0 END AS n FROM s),
i AS (SELECT position, sum(n) OVER (ORDER BY position) AS k FROM b) SELECT CAST(k AS INTEGER) AS interval_idx, min(position) AS "start", max(position) + 1 AS "end" FROM i GROUP BY k""")
def q17(spark: SparkSession, sf: str) -> DataFrame:
    return sites.sequence_intervals(sites.site_stats(skin.derived(spark, sf), skin.HAPLOTYPES), 200)


@query("q18_permutation", """WITH w AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, 's' || (s_suppkey % 20) AS id, CAST(s_suppkey % 2 AS INTEGER) AS p FROM supplier),
h AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'A' ELSE 'C' END AS source, 's' || n_nationkey AS id, CAST(n_nationkey % 2 AS INTEGER) AS p, n_nationkey AS col FROM nation WHERE n_nationkey < 15)
SELECT k, CAST(coalesce((SELECT col FROM h WHERE h.source = w.source AND h.id = w.id AND h.p = w.p), (SELECT min(col) FROM h WHERE h.id = w.id AND h.p = w.p), -1) AS INTEGER) AS "column" FROM w""")
def q18(spark: SparkSession, sf: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("n_nationkey")
    wanted = table(spark, sf, "supplier").select(key.alias("k"), F.when(key % 2 == 0, "A").otherwise("B").alias("source"), F.concat(F.lit("s"), (key % 20).cast("string")).alias("sample_id"), (key % 2).cast("int").alias("ploidy_index"))
    there = table(spark, sf, "nation").where("n_nationkey < 15").select(F.when(nation % 3 == 0, "A").otherwise("C").alias("source"), F.when(nation % 3 == 0, 0).otherwise(1).alias("source_ord"), F.concat(F.lit("s"), nation.cast("string")).alias("sample_id"), (nation % 2).cast("int").alias("ploidy_index"), nation.alias("column"))
    return jobs.permutation(wanted, there).select("k", F.col("column").cast("int").alias("column"))


@query("q19_haplotype_groups", f"""WITH RECURSIVE {skin.SPANS_SQL}, m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY t ORDER BY s, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM sp),
r AS (SELECT *, sum(n) OVER (PARTITION BY t ORDER BY s, user_id ROWS UNBOUNDED PRECEDING) AS run FROM m), g AS (SELECT t, run, min(s) AS s, max(e) AS e FROM r GROUP BY t, run),
l AS (SELECT t, run, s, e, 0 AS lvl FROM g UNION SELECT y.t, y.run, y.s, y.e, l.lvl + 1 FROM l JOIN g y ON y.t < l.t AND y.s < l.e AND l.s < y.e)
SELECT user_id, CAST(max(lvl) AS BIGINT) AS grp FROM r JOIN l ON r.t = l.t AND r.run = l.run GROUP BY user_id""")
def q19(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.assign_groups(skin.spans(spark, sf).withColumnRenamed("user_id", "ord")).select(F.col("ord").alias("user_id"), "grp")


_W4 = f"""{skin.SQL.replace('l_suppkey % 16', 'l_suppkey % 4')}, w AS (SELECT position, CAST(sum(code) AS BIGINT) AS n, count(*) AS called,
 string_agg(code, '' ORDER BY h) AS x, string_agg(h, '' ORDER BY h) AS y, CAST(sum(CASE WHEN code = 1 THEN 1 << h ELSE 0 END) AS INTEGER) AS ones, CAST(sum(1 << h) AS INTEGER) AS seen,
 row_number() OVER (ORDER BY position) AS k FROM d GROUP BY position HAVING sum(code) > 0 AND sum(code) < count(*)),
before AS (SELECT *, lag(position) OVER (PARTITION BY n, x, y ORDER BY position) AS prev FROM w),
broken AS (SELECT DISTINCT g.position FROM before g JOIN w o ON o.position > g.prev AND o.position < g.position AND o.n > g.n
  WHERE bit_count(o.ones & g.ones) <> 0 AND bit_count(o.ones & g.ones) <> bit_count(o.seen & g.ones)),
runs AS (SELECT g.*, sum(CASE WHEN prev IS NULL OR b.position IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY n, x, y ORDER BY g.position) AS run FROM before g LEFT JOIN broken b ON g.position = b.position),
lists AS (SELECT n, x, y, run, any_value(ones) AS ones, min(k) AS a, max(k) AS b, string_agg(position, ',' ORDER BY position) AS sites FROM runs GROUP BY n, x, y, run)"""


@query("q20_descriptors", f"WITH {_W4} SELECT n / 4.0 AS time, sites FROM lists")
def q20(spark: SparkSession, sf: str) -> DataFrame:
    rows = sites.with_interval(_sites4(spark, sf), 100_000_000)
    found = described(packed_sites(rows), 1)
    numbers = rows.groupBy("interval_idx").agg(F.sort_array(F.collect_list(F.struct("position", "time"))).alias("all"))
    at = F.transform("focal", lambda i: F.get("all", i)["position"])
    both = found.join(numbers, "interval_idx")
    return both.select(F.get("all", F.col("focal")[0])["time"].alias("time"), F.array_join(at, ",").alias("sites"))


def _sites4(spark: SparkSession, sf: str) -> DataFrame:
    return sites.inference_sites(skin.matrix(spark, sf, 4).withColumnRenamed("calls", "codes"), 4).select("position", "derived", "called", "time", "calls")


@query("q21_individuals_populations", """WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS src, 's' || s_nationkey AS id FROM supplier),
i AS (SELECT src, id, row_number() OVER (ORDER BY min(src * 100000000 + s_suppkey)) - 1 AS individual_id FROM o GROUP BY src, id),
p AS (SELECT id, row_number() OVER (ORDER BY min(src * 100000000 + s_suppkey)) - 1 AS population_id FROM o GROUP BY id)
SELECT CASE i.src WHEN 0 THEN 'A' ELSE 'B' END AS source, i.id AS sample_id, individual_id, population_id FROM i JOIN p ON i.id = p.id""")
def q21(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("source"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("sample_id"), F.struct(F.col("s_suppkey") % 2, "s_suppkey").alias("ord"))
    people = jobs.first_seen_ids(s, ["source", "sample_id"], F.col("ord"), "individual_id")
    return people.join(jobs.first_seen_ids(s, ["sample_id"], F.col("ord"), "population_id"), "sample_id").select("source", "sample_id", "individual_id", "population_id")


@query("q22_position_union", f"WITH {skin.SQL} SELECT position FROM c WHERE h < 8 AND raw = 1 UNION SELECT position FROM c WHERE h >= 8 AND raw = 0")
def q22(spark: SparkSession, sf: str) -> DataFrame:
    c = skin.calls(spark, sf)
    return unify.position_union([c.where("h < 8 AND raw = 1"), c.where("h >= 8 AND raw = 0")])


@query("q23_group_histogram", f"""WITH {skin.SPANS_SQL}, g AS (SELECT t % 7 AS grp, user_id % 5 AS chunk, (e - s) / 1000.0 AS kb FROM sp),
x AS (SELECT CAST(grp AS BIGINT) AS "group", count(*) AS n, count(DISTINCT chunk) AS chunks, avg(kb) AS m, var_pop(kb) AS v FROM g GROUP BY grp)
SELECT "group", n, chunks, round(m, 3) AS mean_kb, round(v, 1) AS var_kb, repeat('#', CAST(round_even(n * 60.0 / (SELECT max(n) FROM x), 0) AS BIGINT)) AS bar FROM x""")
def q23(spark: SparkSession, sf: str) -> DataFrame:
    s = skin.spans(spark, sf).select((F.col("time") % 7).cast("long").alias("group"), F.lit("A").alias("source"), (F.col("user_id") % 5).alias("sample_chunk"), F.col("start").alias("start_position"), F.col("end").alias("end_position"))
    out = jobs.histogram(s)
    return out.select("group", "n", "chunks", F.round("mean_kb", 3).alias("mean_kb"), F.round("var_kb", 1).alias("var_kb"), "bar")


@query("q24_extend_tables", """WITH o AS (SELECT max(s_acctbal) AS oldest FROM supplier), p AS (SELECT 100 * (p_partkey + 1) AS position, row_number() OVER (ORDER BY p_partkey) - 1 AS site FROM part),
r AS (SELECT s_suppkey, s_acctbal, 2 + row_number() OVER (ORDER BY s_suppkey) - 1 AS id FROM supplier), z AS (SELECT CAST(max(position) + 1 AS DOUBLE) AS len, CAST(min(position) AS DOUBLE) AS lo FROM p)
SELECT 'node' AS kind, id, s_acctbal AS x, 1.0 AS y FROM r UNION ALL SELECT 'node', 0, oldest + 2, 0.0 FROM o UNION ALL SELECT 'node', 1, oldest + 1, 0.0 FROM o
UNION ALL SELECT 'edge', 1, lo, len FROM z UNION ALL SELECT 'edge', id, CAST(s_suppkey % 10 AS DOUBLE), len FROM r, z
UNION ALL SELECT 'mutation', id, CAST(site AS DOUBLE), -1.0 FROM r JOIN p ON position = 100 * (s_suppkey % 50 + 1) WHERE s_suppkey % 2 = 0""")
def q24(spark: SparkSession, sf: str) -> DataFrame:
    """The root graph of all parts as sites, and suppliers added below its node 1."""
    positions = [r[0] for r in table(spark, sf, "part").select(skin.position("p_partkey").alias("p")).orderBy("p").toLocalIterator()]
    rows = [r for r in table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").toLocalIterator()]
    length, there = positions[-1] + 1, set(positions)
    g = make_root(positions, ["F"] * len(positions), length, max(r["s_acctbal"] for r in rows))
    work = [{"haplotype_index": r["s_suppkey"], "time": r["s_acctbal"], "source": "s", "sample_id": str(r["s_suppkey"]), "ploidy_index": 0} for r in rows]
    results = {}
    for r in rows:
        k = r["s_suppkey"]
        x = 100 * (k % 50 + 1)
        results[k] = [(float(k % 10), float(length), 1)], ([(x, 1)] if k % 2 == 0 and x in there else [])
    told = extend(g, work, results, [["F", "O"]] * len(positions)).rows()
    out = [("node", r["id"], r["time"], float(r["flags"])) for r in told["nodes"]] + [("edge", r["child"], r["left"], r["right"]) for r in told["edges"]]
    return spark.createDataFrame(out + [("mutation", r["node"], float(r["site"]), float(r["parent"])) for r in told["mutations"]], "kind string, id long, x double, y double")


@query("q38_mutation_parents", """WITH m AS (SELECT 100 * (p_partkey + 1) AS position, p_size % 16 AS node, 0 AS age FROM part UNION ALL SELECT 100 * (p_partkey + 1), 16 + p_size % 16 // 2, 1 FROM part WHERE p_size % 3 <> 0
  UNION ALL SELECT 100 * (p_partkey + 1), 24 + p_size % 16 // 4, 2 FROM part WHERE p_size % 3 <> 1 UNION ALL SELECT 100 * (p_partkey + 1), (p_size + 8) % 16, 0 FROM part),
i AS (SELECT *, row_number() OVER (ORDER BY position, age DESC, node) - 1 AS id FROM m)
SELECT i.id, CAST(i.position AS DOUBLE) AS position, CAST(i.node AS BIGINT) AS node, coalesce((SELECT max_by(j.id, -j.age) FROM i j WHERE j.position = i.position AND j.age > i.age
  AND j.node = CASE j.age WHEN 1 THEN 16 + i.node // 2 ELSE 24 + (CASE i.age WHEN 0 THEN i.node // 4 ELSE (i.node - 16) // 2 END) END), -1) AS parent FROM i""")
def q38(spark: SparkSession, sf: str) -> DataFrame:
    """Up to four mutations a site on a balanced tree: a leaf, what is above it, and a leaf of the other half."""
    g = _balanced(16)
    for r in table(spark, sf, "part").select("p_partkey", "p_size").orderBy("p_partkey").toLocalIterator():
        leaf, s = r["p_size"] % 16, len(g.sites)
        g.sites.append((float(100 * (r["p_partkey"] + 1)), "A"))
        above = ([16 + leaf // 2] if r["p_size"] % 3 != 0 else []) + ([24 + leaf // 4] if r["p_size"] % 3 != 1 else [])
        g.mutations += [(s, u, "T", -1) for u in (leaf, (leaf + 8) % 16, *above)]
    g.sort()
    rows = [(k, g.sites[s][0], u, p) for k, (s, u, _, p) in enumerate(g.mutations)]
    return spark.createDataFrame(rows, "id long, position double, node long, parent long")


@query("q39_store_round_trip", f"""WITH {skin.SQL} SELECT position, CAST(16 AS INTEGER) AS n_calls, CAST(sum(raw) AS BIGINT) AS alternate, (SELECT 100 * (max(p_partkey) + 2) FROM part) AS length, CAST(16 AS INTEGER) AS haplotypes FROM c GROUP BY position""")
def q39(spark: SparkSession, sf: str) -> DataFrame:
    """A store written to the shared folder and opened again: its rows, its contig's length and its haplotypes."""
    cells = [F.coalesce(F.max(F.when(F.col("h") == k, F.col("raw"))), F.lit(-1)).cast("tinyint") for k in range(skin.HAPLOTYPES)]
    rows = skin.calls(spark, sf).groupBy(F.col("position").cast("int").alias("position")).agg(F.array(*cells).alias("calls"))
    rows = rows.select("position", F.array(F.lit("F"), F.lit("O")).alias("alleles"), "calls", F.lit("1").alias("contig_id"))
    people = spark.range(skin.HAPLOTYPES // 2).select(F.col("id").cast("int").alias("sample_idx"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"), F.lit(2).alias("ploidy"))
    path = scratch(spark, "store")
    write_store(Store(rows, people, table(spark, sf, "part").agg((F.max("p_partkey") + 2) * 100).first()[0]), path)
    s = open_store(path, spark)
    alternate = F.size(F.filter("calls", lambda c: c == 1)).cast("long")
    return s.variants.select(F.col("position").cast("long"), F.size("calls").alias("n_calls"), alternate.alias("alternate"), F.lit(s.length).cast("long").alias("length"), F.lit(s.haplotypes()).alias("haplotypes"))


@query("q36_raw_genotypes", f"""WITH {skin.SQL}, p AS (SELECT 100 * (p_partkey + 1) AS position FROM part WHERE p_size < 10), k AS (SELECT DISTINCT position FROM c WHERE position IN (SELECT position FROM p))
SELECT k.position, string_agg(coalesce(c.raw, -1), ',' ORDER BY g.range DESC) AS calls, string_agg(CASE WHEN c.raw IS NULL THEN -1 WHEN c.raw = 1 THEN 0 ELSE 1 END, ',' ORDER BY g.range DESC) AS derived
FROM k CROSS JOIN range(8) g LEFT JOIN c ON c.position = k.position AND c.h = g.range GROUP BY k.position""")
def q36(spark: SparkSession, sf: str) -> DataFrame:
    """Eight of the haplotypes, from the last to the first, at the sites of small parts; allele 1 is the ancestral one."""
    raw = skin.calls(spark, sf)
    cells = [F.coalesce(F.max(F.when(F.col("h") == k, F.col("raw"))), F.lit(-1)).cast("tinyint") for k in range(skin.HAPLOTYPES)]
    rows = raw.groupBy("position").agg(F.array(*cells).alias("calls"))
    some = table(spark, sf, "part").where("p_size < 10").select(skin.position("p_partkey").alias("position"), F.lit(1).alias("ancestral_index"))
    order = list(range(7, -1, -1))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    derived = unify.derived_genotypes(rows, some, order).select("position", text("calls").alias("derived"))
    return unify.raw_genotypes(rows, some, order).select("position", text("calls").alias("calls")).join(derived, "position")


@query("q37_running_totals", f"""WITH {skin.SPANS_SQL}, x AS (SELECT CAST(t % 7 AS BIGINT) AS "group", count(*) AS n FROM sp GROUP BY 1)
SELECT "group", n, CAST(sum(n) OVER w AS BIGINT) AS done, round(CAST(sum(n) OVER w AS BIGINT) * 100.0 / (SELECT sum(n) FROM x), 6) AS percent, (SELECT median(n) FROM x) AS median_n FROM x WINDOW w AS (ORDER BY "group")""")
def q37(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.progress(skin.spans(spark, sf).select((F.col("time") % 7).cast("long").alias("group")))
    return out.select("group", "n", "done", F.round("percent", 6).alias("percent"), "median_n")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    left = (F.col("o_orderkey") % 40).cast("double")
    return o.select(left.alias("left"), (left + 1 + F.col("o_custkey") % 5).alias("right"), (F.col("o_custkey") % 7).alias("parent"), (F.col("o_orderkey") % 11 + 10).alias("child")).distinct()


_EDGES = "ed AS (SELECT DISTINCT CAST(o_orderkey % 40 AS DOUBLE) AS l, CAST(o_orderkey % 40 + 1 + o_custkey % 5 AS DOUBLE) AS r, o_custkey % 7 AS p, o_orderkey % 11 + 10 AS c FROM orders)"


@query("q25_squash_edges", f"""WITH {_EDGES}, b AS (SELECT *, CASE WHEN l <= max(r) OVER (PARTITION BY p, c ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ed),
g AS (SELECT *, sum(n) OVER (PARTITION BY p, c ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT p AS parent, c AS child, min(l) AS "left", max(r) AS "right" FROM g GROUP BY p, c, k""")
def q25(spark: SparkSession, sf: str) -> DataFrame:
    return tables.squashed(_edges(spark, sf))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_COMPRESSION = f"""c AS (SELECT c_custkey AS id, 1000000000 + c_nationkey AS p, 2000000000 + list_position([{", ".join(f"'{x}'" for x in _SEGMENTS)}], c_mktsegment) AS q, c_nationkey, CAST(c_custkey % 3 AS DOUBLE) AS t FROM customer),
g AS (SELECT p, q, count(*) AS k, min(id) AS first_child, max(t) AS oldest, least(10.0 + p - 1000000000, 2.0 + q - 2000000000) - pow(2, -32) AS t FROM c GROUP BY p, q HAVING count(*) >= 2),
f AS (SELECT *, (SELECT max(greatest(p, q)) FROM c) + row_number() OVER (ORDER BY first_child) AS id FROM g WHERE t > oldest)"""


def _two_parents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers below their nation in the left half of the genome, and below their segment in the right one; and the times."""
    c = table(spark, sf, "customer")
    nation = (F.col("c_nationkey") + 1_000_000_000).cast("long")
    segment = F.array_position(F.array(*map(F.lit, _SEGMENTS)), F.col("c_mktsegment")) + 2_000_000_000
    halves = F.explode(F.array(F.struct(F.lit(0.0).alias("left"), F.lit(0.5).alias("right"), nation.alias("parent")), F.struct(F.lit(0.5).alias("left"), F.lit(1.0).alias("right"), segment.alias("parent"))))
    edges = c.select(F.col("c_custkey").cast("long").alias("child"), halves.alias("e")).select("e.left", "e.right", "e.parent", "child")
    ages = [c.select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") % 3).cast("double").alias("time")), c.select(nation.alias("id"), (10.0 + F.col("c_nationkey")).alias("time")).distinct(), c.select(segment.alias("id"), (2.0 + segment - 2_000_000_000).alias("time")).distinct()]
    return edges, ages[0].unionByName(ages[1]).unionByName(ages[2]).withColumn("flags", F.lit(0))


@query("q26_compress_paths", f"WITH {_COMPRESSION} SELECT p AS parent, q AS other, k AS n_children, first_child, t AS time FROM f")
def q26(spark: SparkSession, sf: str) -> DataFrame:
    groups = tables.compression_groups(*_two_parents(spark, sf))
    return groups.select(F.col("path")[0]["parent"].alias("parent"), F.col("path")[1]["parent"].alias("other"), F.size("children").cast("long").alias("n_children"), F.col("children")[0].alias("first_child"), "time")


@query("q34_compressed_tables", f"""WITH {_COMPRESSION}, u AS (SELECT c.id, c.p, c.q, f.id AS up FROM c LEFT JOIN f ON c.p = f.p AND c.q = f.q)
SELECT 0.0 AS "left", 0.5 AS "right", coalesce(up, p) AS parent, id AS child, false AS made FROM u UNION ALL SELECT 0.5, 1.0, coalesce(up, q), id, false FROM u
UNION ALL SELECT 0.0, 0.5, p, id, true FROM f UNION ALL SELECT 0.5, 1.0, q, id, true FROM f""")
def q34(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = tables.compressed(*_two_parents(spark, sf))
    # flags of the new nodes must name them as made by compression
    made = nodes.where(is_compressed("flags")).select(F.col("id").alias("made"))
    told = edges.join(made, edges["child"] == made["made"], "left")
    return told.select("left", "right", "parent", "child", F.col("made").isNotNull().alias("made"))


@query("q35_vestigial_root", """WITH k AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS u FROM supplier), e AS (SELECT 0.0 AS l, 50.0 AS r, u // 2 AS p, u AS c FROM k WHERE u > 0
  UNION ALL SELECT 50.0, 100.0, u // 3, u FROM k WHERE u > 0 AND u % 5 <> 0),
t AS (SELECT DISTINCT l, r, p AS u FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.l = e.l AND x.c = e.p)), s AS (SELECT u, min(l) AS l, max(r) AS r FROM t GROUP BY u)
SELECT l AS "left", r AS "right", p + 1 AS parent, c + 1 AS child FROM e UNION ALL SELECT l, r, 0, u + 1 FROM s""")
def q35(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as nodes of two trees, in the right one of which some hang loose."""
    n = table(spark, sf, "supplier").count()
    g = Graph(100.0)
    for u in range(n):
        g.add_node(float(n - u))
    g.edges = [(0.0, 50.0, u // 2, u) for u in range(1, n)] + [(50.0, 100.0, u // 3, u) for u in range(1, n) if u % 5]
    return spark.createDataFrame([(a, b, p, c) for a, b, p, c in g.vestigial_root().edges], "left double, right double, parent long, child long")


@query("q27_erase_flanks", f"""WITH {_EDGES}, i AS (SELECT n_nationkey * 3 AS s, n_nationkey * 3 + 2 AS e FROM nation)
SELECT greatest(l, s) AS "left", least(r, e) AS "right", p AS parent, c AS child FROM ed JOIN i ON greatest(l, s) < least(r, e)""")
def q27(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "nation").select((F.col("n_nationkey") * 3).cast("double").alias("start"), (F.col("n_nationkey") * 3 + 2).cast("double").alias("end"))
    return tables.clipped(_edges(spark, sf), i, 3)


@query("q28_local_trees", f"WITH {_EDGES} SELECT x AS position, c AS child, p AS parent FROM ed JOIN (SELECT CAST(range * 4 AS DOUBLE) AS x FROM range(11)) ON l <= x AND x < r")
def q28(spark: SparkSession, sf: str) -> DataFrame:
    return tables.parents_at(_edges(spark, sf), spark.range(11).select((F.col("id") * 4).cast("double").alias("position")), 4)


#: Extension by the rules of ``make_ancestor``: sets of haplotypes are bits of a number.
_EXTENDED = f"""{_W4}, seeds AS (SELECT *, row_number() OVER () AS id FROM lists),
x AS (SELECT id, 1 AS step, b AS k, ones AS held, 0 AS astray, bit_count(ones) // 2 AS least, n AS age, CAST(NULL AS INTEGER) AS value, true AS more FROM seeds
  UNION ALL SELECT id, -1, a, ones, 0, bit_count(ones) // 2, n, NULL, true FROM seeds),
walk AS (SELECT * FROM x UNION ALL
  SELECT id, step, k, held & ~(astray & off) AS held, (CASE WHEN older OR n > one THEN off ELSE astray END) & held & ~(astray & off) AS astray, least, age,
    CASE WHEN NOT older THEN 0 WHEN one + zero = 0 THEN -1 ELSE agreed END AS value, bit_count(held & ~(astray & off)) > least AS more
  FROM (SELECT *, held & seen & CASE WHEN agreed = 1 THEN ~ones ELSE ones END AS off FROM
    (SELECT *, CASE WHEN one >= zero THEN 1 ELSE 0 END AS agreed FROM
      (SELECT v.id, v.step, w.k, v.held, v.astray, v.least, v.age, w.n, w.ones, w.seen, w.n > v.age AS older, bit_count(v.held & w.ones) AS one, bit_count(v.held & w.seen & ~w.ones) AS zero
       FROM walk v JOIN w ON w.k = v.k + v.step WHERE v.more)))),
focal AS (SELECT s.id, w.k, 1 AS value FROM seeds s JOIN runs w ON s.n = w.n AND s.x = w.x AND s.y = w.y AND s.run = w.run),
between AS (SELECT s.id, w.k, CASE WHEN w.n <= s.n THEN 0 WHEN bit_count(s.ones & w.seen) = 0 THEN -1 WHEN 2 * bit_count(s.ones & w.ones) >= bit_count(s.ones & w.seen) THEN 1 ELSE 0 END AS value
  FROM seeds s JOIN w ON w.k > s.a AND w.k < s.b WHERE NOT EXISTS (SELECT 1 FROM focal f WHERE f.id = s.id AND f.k = w.k)),
states AS (SELECT * FROM focal UNION ALL SELECT * FROM between UNION ALL SELECT id, k, value FROM walk WHERE value IS NOT NULL)"""


@query("q29_make_ancestors", f"""WITH RECURSIVE {_EXTENDED} SELECT CAST(0 AS INTEGER) AS interval_idx, s.n / 4.0 AS time, CAST(min(w.position) AS INTEGER) AS start_position, CAST(max(w.position) + 1 AS INTEGER) AS end_position, s.sites AS focal,
string_agg(CASE value WHEN -1 THEN 'FF' WHEN 0 THEN '00' ELSE '01' END, '' ORDER BY t.k) AS states FROM states t JOIN w ON t.k = w.k JOIN seeds s ON t.id = s.id GROUP BY s.id, s.n, s.sites""")
def q29(spark: SparkSession, sf: str) -> DataFrame:
    found = sites.with_interval(_sites4(spark, sf), 100_000_000)
    return build(found).select("interval_idx", "time", "start_position", "end_position", F.array_join("focal_positions", ",").alias("focal"), F.hex("hap").alias("states"))


def _star(n_sites: int, nodes: int) -> Graph:
    """A star of ``nodes`` leaves below node 1, each with the mutations of its own sites."""
    g = Graph(float(n_sites + 1))
    g.add_node(2.0)
    g.add_node(1.0)
    g.edges = [(0.0, g.length, 0, 1)]
    g.sites = [(float(k + 1), "A") for k in range(n_sites)]
    for k in range(nodes):
        u = g.add_node(0.5 - k / 1000)
        g.edges.append((0.0, g.length, 1, u))
        g.mutations += [(s, u, "T", -1) for s in range(k, n_sites, nodes)]
    g.sort()
    return g


#: The panel is a star: node 1 above nodes 2 to 9, node 2 + s % 8 mutated at site s. Codes and likelihoods are lists.
_MATCHED = f"""{skin.SQL}, n AS (SELECT CAST(max(p_partkey) + 1 AS INTEGER) AS n FROM part), obs AS (SELECT h, position // 100 - 1 AS s, code FROM d),
ends AS (SELECT CAST(r.range AS INTEGER) AS h, coalesce(min(s), 0) AS a, coalesce(max(s), (SELECT n - 1 FROM n)) AS b FROM range(16) r LEFT JOIN obs ON h = r.range GROUP BY r.range), grid AS (SELECT e.h, g.range AS s, coalesce(o.code, -1) AS code FROM ends e JOIN n ON true JOIN range((SELECT n FROM n)) g ON g.range BETWEEN e.a AND e.b LEFT JOIN obs o ON o.h = e.h AND o.s = g.range),
codes AS (SELECT h, min(s) AS a, max(s) AS b, list(code ORDER BY s) AS c FROM grid GROUP BY h),
fwd AS (SELECT h, a - 1 AS s, a, b, c, [1e0, 1e0, 1e0, 1e0, 1e0, 1e0, 1e0, 1e0, 1e0] AS likely, CAST([] AS BOOLEAN[]) AS moved, CAST(0 AS BIGINT) AS best FROM codes UNION ALL
  SELECT h, s, a, b, c, list_transform(raw, lambda x: x / list_max(raw)), moved, list_position(raw, list_max(raw)) FROM (
    SELECT h, s + 1 AS s, a, b, c, list_transform(likely, lambda x: NOT (x * (1e0 - 1e-2 + 1e-2 / 1e1) > 1e-2 / 1e1)) AS moved,
      list_transform(likely, lambda x, i: greatest(x * (1e0 - 1e-2 + 1e-2 / 1e1), 1e-2 / 1e1) * CASE WHEN c[s + 2 - a] < 0 OR c[s + 2 - a] = CASE WHEN i = 2 + (s + 1) % 8 THEN 1 ELSE 0 END THEN 1e0 - 1e-3 ELSE 1e-3 END) AS raw
    FROM fwd WHERE s < b)),
f AS (SELECT h, s, a, b, c[s + 1 - a] AS code, moved, best FROM fwd WHERE s >= a),
back AS (SELECT h, s, a, code, best AS u, moved[best] AS cut FROM f WHERE s = b UNION ALL
  SELECT f.h, f.s, f.a, f.code, CASE WHEN back.cut THEN f.best ELSE back.u END, f.moved[CASE WHEN back.cut THEN f.best ELSE back.u END] FROM back JOIN f ON f.h = back.h AND f.s = back.s - 1),
seg AS (SELECT *, sum(CASE WHEN cut AND s > a THEN 1 ELSE 0 END) OVER (PARTITION BY h ORDER BY s ROWS UNBOUNDED PRECEDING) AS k, max(s) OVER (PARTITION BY h) AS last FROM back),
parts AS (SELECT h, k, u, CASE WHEN min(s) = 0 THEN 0 ELSE min(s) + 1 END AS l, max(s) + 2 AS r FROM seg GROUP BY h, k, u)"""


@query("q30_viterbi_match", f"""WITH RECURSIVE {_MATCHED} SELECT CAST(p.h AS BIGINT) AS haplotype_index, string_agg(l || ':' || r || ':' || u, ',' ORDER BY k DESC) AS path,
any_value(m.n) AS n_mutations FROM parts p JOIN (SELECT h, CAST(sum(CASE WHEN code >= 0 AND code <> CASE WHEN u = 2 + s % 8 THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS INTEGER) AS n FROM seg GROUP BY h) m ON m.h = p.h GROUP BY p.h""")
def q30(spark: SparkSession, sf: str) -> DataFrame:
    """All haplotypes of the skin, over all part keys as sites, against a star."""
    haps, n = _haplotypes(spark, sf)
    rated = haps.select(F.col("hap").alias("haplotype_index"), "codes", F.lit(1e-2).alias("rho"), F.lit(1e-3).alias("mu"))
    found = match_frame(rated.repartition(8), lshmm.panel(_star(n, 8), [2] * n))
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["left"].cast("int"), p["right"].cast("int"), p["parent"])), ",")
    return found.select("haplotype_index", path.alias("path"), F.size("mutations").alias("n_mutations"))


def _parsimony_sql() -> str:
    """Sets of states from 16 leaves up and states from the root down, a column each: 1 is ancestral only, 2 derived only, 3 either."""
    kids = {16 + k: (2 * k, 2 * k + 1) for k in range(15)}
    parent = {c: p for p, pair in kids.items() for c in pair}
    leaves = ", ".join(f"coalesce(max(CASE WHEN h = {k} THEN 1 + code END), 3) AS s{k}" for k in range(16))
    out = [f"WITH {skin.SQL}, x15 AS (SELECT position, {leaves} FROM d GROUP BY position)"]
    for p, (a, b) in kids.items():
        out.append(f"x{p} AS (SELECT *, CASE WHEN s{a} & s{b} <> 0 THEN s{a} & s{b} ELSE s{a} | s{b} END AS s{p} FROM x{p - 1})")
    out.append("y30 AS (SELECT *, CASE WHEN s30 & 1 <> 0 THEN 0 ELSE 1 END AS t30 FROM x30)")
    for u in range(29, -1, -1):
        t = f"t{parent[u]}"
        out.append(f"y{u} AS (SELECT *, CASE WHEN (s{u} >> {t}) & 1 <> 0 THEN {t} ELSE 1 - {t} END AS t{u} FROM y{u + 1})")
    changed = {u: f"t{u} <> {f't{parent[u]}' if u in parent else 0}" for u in range(30, -1, -1)}
    listed = ", ".join(f"CASE WHEN {c} THEN '{u}:' || t{u} END" for u, c in changed.items())
    many = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in changed.values())
    return ", ".join(out) + f" SELECT CAST(position AS DOUBLE) AS position, CAST({many} AS INTEGER) AS n_mutations, concat_ws(',', {listed}) AS mutations FROM y0"


@query("q31_augment_parsimony", _parsimony_sql())
def q31(spark: SparkSession, sf: str) -> DataFrame:
    """Mutations that place each site of the skin on a balanced tree of 16 leaves."""
    from genloom.operators.augment import place_frame

    g = _balanced(16)
    rows = skin.matrix(spark, sf).select(F.col("position").cast("double").alias("position"), "calls").where(F.exists("calls", lambda c: c >= 0))
    placed = place_frame(rows.withColumn("root_state", F.lit(0)), g, g.samples())
    return placed.select("position", F.size("mutations").alias("n_mutations"), F.array_join(F.transform("mutations", lambda m: F.concat_ws(":", m["node"], m["code"])), ",").alias("mutations"))


def _balanced(leaves: int) -> Graph:
    g = Graph(1e12)
    level = [g.add_node(0.0, 1) for _ in range(leaves)]
    age = 0.0
    while len(level) > 1:
        age += 1
        up = []
        for a, b in zip(level[::2], level[1::2]):
            u = g.add_node(age)
            g.edges += [(0.0, g.length, u, a), (0.0, g.length, u, b)]
            up.append(u)
        level = up
    g.sort()
    return g


def _small(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Genotypes of eight haplotypes at all part keys, and their annotation.

    A part's size names a branch of a balanced tree of eight leaves, the
    carriers of its derived allele; every 1,000 keys the leaves are dealt anew.
    """
    branch, turned = F.col("p_size") % 14, F.floor(F.col("p_partkey") / 1000) % 2 == 1

    def below(leaf: int) -> Column:
        return F.when(branch < 2, branch == leaf // 4).when(branch < 6, branch - 2 == leaf // 2).otherwise(branch - 6 == leaf)

    bits = [F.when(turned, below(3 * k % 8)).otherwise(below(k)).cast("tinyint") for k in range(8)]
    p = table(spark, sf, "part")
    rows = p.select(skin.position("p_partkey").cast("int").alias("position"), F.array(F.lit("F"), F.lit("O")).alias("alleles"), F.array(*bits).alias("calls"), F.lit("1").alias("contig_id"))
    return rows, rows.select("position", F.lit("F").alias("ancestral_allele"))


def _inferred(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    from genloom.plans import pipeline
    rows, notes = _small(spark, sf)
    people = spark.range(8).select(F.col("id").cast("int").alias("sample_idx"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"), F.lit(1).alias("ploidy"))
    store = Store(rows, people, rows.agg(F.max("position") + 100).first()[0])
    return pipeline.infer(spark, {"s": store}, notes, augment=True), rows


@query("q32_full_pipeline")
def q32(spark: SparkSession, sf: str) -> DataFrame:
    """The inferred tables, one row a row: nodes, edges, sites and mutations."""
    g, _ = _inferred(spark, sf)
    nodes = ((float(f), t, -1, m.get("sample_id")) for f, t, m in zip(g.flags, g.time, g.meta))
    edges = ((float(a), float(b), int(p), str(int(c))) for a, b, p, c in g.edges)
    sites_ = ((float(x), 0.0, -1, a) for x, a in g.sites)
    mutations = ((float(s), float(u), int(p), d) for s, u, d, p in g.mutations)
    kinds = (("node", nodes), ("edge", edges), ("site", sites_), ("mutation", mutations))
    out = ((kind, k, *row) for kind, rows in kinds for k, row in enumerate(rows))
    return _framed(spark, out, "kind string, id long, x double, y double, parent long, value string")


def _framed(spark: SparkSession, rows: Iterable[tuple], schema: str, lot: int = 50_000, most: int = 200_000) -> DataFrame:
    """Rows from the driver, held as Arrow columns and not as objects; beyond ``most`` they are files of the shared folder, in no order."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    lots = iter(lambda it=iter(rows): list(islice(it, lot)), [])
    found, path = [], None
    for some in lots:
        found.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], kind.names))
        if sum(map(len, found)) > most:
            path = path or scratch(spark, "rows")
            from_arrow(spark, pa.concat_tables(found), schema).write.mode("append").parquet(path)
            found = []
    rest = from_arrow(spark, pa.concat_tables(found) if found else kind.empty_table(), schema)
    return rest if path is None else spark.read.schema(schema).parquet(path).unionByName(rest)


@query("q33_decode_genotypes", "SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS sites FROM part")
def q33(spark: SparkSession, sf: str) -> DataFrame:
    g, rows = _inferred(spark, sf)
    decoded = _framed(spark, ((int(x), alleles) for x, alleles in g.genotypes()), "position int, decoded array<string>")
    told = F.transform("calls", lambda c: F.when(c == 1, "O").otherwise("F"))
    both = rows.join(decoded, "position", "left")
    return both.agg(F.sum((~F.col("decoded").eqNullSafe(told)).cast("long")).alias("mismatches"), F.count(F.lit(1)).alias("sites"))
