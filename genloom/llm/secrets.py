"""Secret scans over an incremental ledger of blobs, with DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genloom.llm.common import apart, unused
from genloom.session import scratch, stage, table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run is matched whole, so shorter runs need no match
)
# Formats of issued credentials, beside the base rules.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("mail", r"SG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"://[A-Za-z0-9._~-]{1,64}:([^\x20\x09-\x0D:/@]{6,64})@", 1, 6),
)
RULES = BASE + MORE


def version(rules: tuple[Rule, ...] = RULES) -> str:
    """A name for a set of rules that changes with any of them."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blobs(docs: DataFrame, path: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns that name a path (and its version, where there is one), ``blob`` (SHA-256 of the text, null as empty) and ``text``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*path, F.sha2(text, 256).alias("blob"), text.alias("text"))


def unseen(found: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Distinct ``blob, text`` that may hold a secret and that the ledger does not have under these rules.

    A text that no pattern matches anywhere has no findings; it is told here,
    where it is read, and never shuffled. Copies fall together before the
    shuffle, so a blob in a third of all rows is one row when the ledger is asked.
    """
    may = F.lit(False)
    for r in rules:
        may = may | F.col("text").rlike(r.pattern)
    new = found.where(may).groupBy("blob", "text").agg(F.lit(1).alias("_one")).drop("_one")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version(rules)).select("blob").distinct()
        new = new.join(seen, "blob", "left_anti")
    return new


def _each_at_least(matches: Column, least: int) -> Column:
    return F.transform(matches, lambda m: F.char_length(m) >= least)


def _of_rank(spans: Column, rank: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] == rank)


def scan(new: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings ``blob, rule_version, kind, rank, start, end`` of distinct ``blob, text``.

    Matches and the text between them come from one pattern each; a running
    sum of their lengths within the blob gives code point offsets, end exclusive.
    """
    each = []
    for k, r in enumerate(rules):
        text = F.col("text")
        whole = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        told = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)) if r.group else whole
        between = F.transform(F.split(text, r.pattern, -1), lambda g: F.char_length(g))
        lengths = F.transform(whole, lambda m: F.char_length(m))
        valid = _each_at_least(told, r.least)
        zipped = F.slice(F.arrays_zip(between.alias("gap"), lengths.alias("size"), valid.alias("valid")), F.lit(1), F.size(whole))
        hits = F.when(text.rlike(r.pattern), F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["size"].alias("size"), z["valid"].alias("valid"))))
        each.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(k).alias("rank"), hits.alias("hits")))
    kinds = new.select("blob", F.explode(F.array(*each)).alias("k")).where("k.hits is not null")
    hits = kinds.select("blob", "k.kind", "k.rank", F.posexplode("k.hits").alias("pos", "h"))
    before = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("end", F.sum(F.col("h.gap") + F.col("h.size")).over(before)).where("h.valid")
    return placed.select("blob", F.lit(version(rules)).alias("rule_version"), "kind", "rank", (F.col("end") - F.col("h.size")).alias("start"), "end")


def rolled(findings: DataFrame) -> DataFrame:
    """Per blob: ``spans``, an array of ``start, rank, end, kind`` in order. A text bounds its array."""
    one = F.struct("start", "rank", "end", "kind")
    return findings.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


class Ledger:
    """Pairs of blob and rule version that were scanned, and their findings, as tables in a shared folder.

    Findings are written before the pairs: after a run that broke off in
    between, its blobs count as unseen and are scanned again, and equal
    findings fall together when read.
    """

    PAIR = "blob string, rule_version string"
    FINDING = "blob string, rule_version string, kind string, rank int, start long, end long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        for name, schema in (("pairs", self.PAIR), ("findings", self.FINDING)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")

    def pairs(self) -> DataFrame:
        return self.spark.read.schema(self.PAIR).parquet(f"{self.folder}/pairs")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDING).parquet(f"{self.folder}/findings").distinct()

    def scan(self, docs: DataFrame, path: Sequence[str] = ("doc_id",)) -> DataFrame:
        """Spans for every row of ``docs``, after the blobs that are new were scanned and recorded."""
        found, added, fresh = scanned(docs, self.pairs(), self.findings(), path)
        found, added = stage(found, "spans-of-paths"), stage(added, "added")
        fresh.write.mode("append").parquet(f"{self.folder}/findings")
        added.write.mode("append").parquet(f"{self.folder}/pairs")
        return found


def scanned(docs: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, path: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings for every row of ``docs``, and what to add to the ledger and to the stored findings.

    ``ledger`` (``blob, rule_version``) names what earlier runs scanned and
    ``known`` holds their findings; only other pairs are scanned now. Returned
    are the ``path`` columns with ``blob, spans`` (null where nothing is
    found), the new ledger rows and the new findings. Null and empty texts are
    one blob without findings; rows that repeat each get their blob's
    findings. No rows in, none out.
    """
    found = blobs(docs, path)
    paths = stage(found.select(*path, "blob"), "paths")
    fresh = stage(scan(unseen(found, ledger)), "findings")
    added = paths.select("blob").distinct().withColumn("rule_version", F.lit(version()))
    if ledger is not None:
        added = added.join(ledger, ["blob", "rule_version"], "left_anti")
    every = fresh
    if known is not None:
        every = fresh.unionByName(known.where(F.col("rule_version") == version()).select(fresh.columns))
    spans = stage(rolled(every), "spans").withColumnRenamed("blob", "_blob")
    joined = paths.join(spans, paths["blob"] == spans["_blob"], "left").drop("_blob")
    return joined, added, fresh


def cut(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """``text`` with the union of ``spans`` (code points, by start) replaced: one ``mark`` for spans that overlap or touch."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("open"))

    def step(done: Column, s: Column) -> Column:
        apart_ = ~done["open"] | (s["start"] > done["at"])
        before = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        out = F.when(apart_, F.concat(done["out"], before, F.lit(mark))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], s["end"]).alias("at"), F.lit(True).alias("open"))

    rest = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))
    return F.aggregate(spans, begin, step, rest)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, secrets in ``text`` replaced, and ``n_chars`` (where there is one) to match.

    All rules find their spans in the text as it came; the union of the spans
    is cut out at once, so that secrets which overlap go as a whole. Distinct
    blobs with findings are redacted once each and joined back to every row
    that has them; other rows are passed on as they are, a null text included,
    without a shuffle while the hashes of the blobs can be broadcast.
    """
    found = blobs(docs)
    new = stage(unseen(found, None), "unseen")
    spans = rolled(scan(new)).withColumnRenamed("blob", "_hit")
    dirty = new.join(spans, new["blob"] == spans["_hit"])
    mine, clean = unused("blob"), unused("clean")
    dirty = stage(dirty.select(F.col("blob").alias(mine), F.xxhash64("text").alias("route"), cut(F.col("text"), F.col("spans")).alias(clean)), "clean")
    text = F.coalesce(docs["text"], F.lit(""))
    same, some = apart(docs, F.xxhash64(text), dirty.select("route"))
    out = some.join(dirty.drop("route"), F.sha2(F.coalesce(some["text"], F.lit("")), 256) == dirty[mine], "left")
    hit = F.col(f"`{clean}`")
    new_columns = {"text": F.coalesce(hit, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new_columns["n_chars"] = F.when(hit.isNull(), F.col("n_chars")).otherwise(F.char_length(hit).cast(kind))
    return same.unionByName(out.withColumns(new_columns).drop(mine, clean))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches by a hash of the id, which together are all rows: the second meets the ledger of the first."""
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark, scratch(spark, "ledger"))
    early = F.xxhash64("doc_id", F.lit("batch")) >= 0
    found = ledger.scan(docs.where(early)).unionByName(ledger.scan(docs.where(~early)))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    counts = [F.size(_of_rank(spans, k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(spans).alias("spans"))
