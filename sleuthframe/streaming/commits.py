"""Commits as a stream: activity per file and week, kept up to date as commits arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.messages import has

COMMIT = "hash string, ts timestamp, author string, subject string, paths array<string>"


def _once(commits: DataFrame, late: str) -> DataFrame:
    rows = commits.filter("ts is not null")
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"]) if commits.isStreaming else rows.dropDuplicates(["hash"])


def activity(commits: DataFrame, late: str = "14 days", period: str = "7 days") -> DataFrame:
    """(path, start, commits, fixes, authors) from a stream or table of COMMIT rows.

    Commits more than `late` behind the newest one are dropped in a stream; the
    same commit counts once within that time. Null paths and times are left
    out. Authors are counted by a sketch, as a stream can't hold exact sets.
    """
    rows = _once(commits, late)
    each = rows.select("ts", "author", has("fix", F.col("subject")).alias("fix"), F.explode("paths").alias("path")).filter("path is not null")
    got = each.groupBy("path", F.window("ts", period).alias("w")).agg(F.count("*").alias("commits"), F.count_if("fix").alias("fixes"), F.approx_count_distinct("author").alias("authors"))
    return got.select("path", F.col("w.start").alias("start"), "commits", "fixes", "authors")


def unreviewed(commits: DataFrame, reviews: DataFrame) -> DataFrame:
    """COMMIT rows without the paths whose last review, in a table (path, ts), isn't older: a review starts a file's history anew.

    The table is read anew with each batch of a stream; a commit of which no
    path is left, or that has none, goes.
    """
    last = reviews.groupBy("path").agg(F.max("ts").alias("reviewed"))
    each = commits.withColumn("path", F.explode("paths")).join(last, "path", "left").filter("reviewed is null or ts > reviewed")
    return each.select("hash", "ts", "author", "subject", F.array("path").alias("paths"))


def bursts(commits: DataFrame, late: str = "14 days", gap: str = "7 days", least: int = 3) -> DataFrame:
    """(path, start, stop, commits) of each run of commits to a file that no `gap` without one interrupts, if it has `least` of them: session windows.

    `commits` may be what unreviewed gives; a commit repeated for one path counts once.
    """
    rows = commits.filter("ts is not null")
    each = rows.select("hash", "ts", F.explode("paths").alias("path")).filter("path is not null")
    each = each.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash", "path"]) if commits.isStreaming else each.dropDuplicates(["hash", "path"])
    got = each.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("commits")).filter(F.col("commits") >= least)
    return got.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "commits")


def fixes_after_features(commits: DataFrame, late: str = "14 days", within: str = "14 days") -> DataFrame:
    """(path, feature, fix, at, fixed): each fix of a file within some time after a feature of it; an interval join, whose state the watermarks bound."""
    rows = _once(commits, late).select("hash", "ts", "subject", F.explode("paths").alias("path")).filter("path is not null")
    kind = lambda label, *names: rows.filter(has(label, F.col("subject"))).select(*(F.col(c).alias(n) for c, n in zip(("path", "hash", "ts"), names)))
    a, b = kind("feature", "path", "feature", "at"), kind("fix", "of", "fix", "fixed")
    both = a.join(b, F.expr(f"of = path and fixed > at and fixed <= at + interval {within}"))
    return both.select("path", "feature", "fix", "at", "fixed")
