"""What happens to findings after the checks: filters, ranking, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKS = {"low": 0, "medium": 1, "high": 2}
MARKER = "sleuthframe: ignore"


def rank() -> F.Column:
    return F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(rank() >= RANKS[severity])


def in_diff(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings on changed lines (path, line)."""
    return findings.join(lines.select(F.col("path").alias("file"), "line").distinct(), ["file", "line"], "left_semi")


def unsuppressed(findings: DataFrame, files: DataFrame, marker: str = MARKER) -> DataFrame:
    """Findings without a marker in their line or the one above. A list in brackets right after the marker names the checks it is for; an unclosed bracket makes it void."""
    lines = files.select("path", F.posexplode(F.split("src", "\n")).alias("i", "text")).filter(F.col("text").contains(marker))
    tail = F.expr(f"substring(text, locate('{marker}', text) + {len(marker)})")
    listed = F.regexp_extract(tail, r"^\[([^\]]*)\]", 1)
    marks = lines.select(F.col("path").alias("file"), (F.col("i") + 1).alias("at"), F.when(tail.startswith("["), F.when(tail.contains("]"), F.transform(F.split(listed, ","), F.trim)).otherwise(F.array().cast("array<string>"))).alias("names"))
    both = marks.select("file", F.explode(F.array("at", F.col("at") + 1)).alias("line"), "names")
    hit = findings.select("file", "line", "check").distinct().join(both, ["file", "line"]).filter(F.col("names").isNull() | F.array_contains("names", F.col("check"))).select("file", "line", "check")
    return findings.join(hit.distinct(), ["file", "line", "check"], "left_anti")


def ranked(findings: DataFrame, top: int = 10) -> DataFrame:
    """Severe ones first, then those of checks that hit less, then as found; all of them for top = 0."""
    rows = findings.withColumn("hits", F.count("*").over(W.partitionBy("check"))).orderBy(rank().desc(), "hits", "check_ord", "seq")
    return rows.limit(top) if top else rows


def hotspots(findings: DataFrame, checks: int = 3) -> DataFrame:
    """(file, checks, names): files that enough different checks point to."""
    return findings.groupBy("file").agg(F.array_sort(F.collect_set("check")).alias("names")).select("file", F.size("names").alias("checks"), "names").filter(F.col("checks") >= checks)


def summary(findings: DataFrame) -> DataFrame:
    """(check, severity, findings) in order of severity, then of number."""
    return findings.groupBy("check", "severity").agg(F.count("*").alias("findings")).orderBy(rank().desc(), F.desc("findings"), "check")


def collapsed(findings: DataFrame, least: int = 3) -> DataFrame:
    """`least` or more findings of a check in one directory become one, for the directory."""
    from ..functions.paths import name, parent

    w = W.partitionBy("check", "dir")
    rows = findings.withColumn("dir", parent(F.col("file"))).withColumn("n", F.count("*").over(w))
    alone = rows.filter(F.col("n") < least).select(*findings.columns)
    many = rows.filter(F.col("n") >= least).groupBy("check", "dir").agg(F.min("seq").alias("seq"), F.min("check_ord").alias("check_ord"), F.min("severity").alias("severity"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", name(F.col("file")).alias("name")))).alias("names"))
    said = F.concat(F.col("dir"), F.lit("/ — "), F.col("n").cast("string"), F.lit(" files in this package flagged ("), F.array_join(F.transform("names", lambda x: x["name"]), ", "), F.lit(") — tightly-coupled subsystem"))
    return alone.unionByName(many.select(F.col("dir").alias("file"), F.lit(1).alias("line"), "check", said.alias("message"), "severity", "check_ord", "seq").select(*findings.columns))
