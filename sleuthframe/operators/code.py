"""Operators of the checks over source code; like those in core, they run on any table with the named columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..cluster import Scratch


def only(df: DataFrame, key: str) -> DataFrame:
    """Rows that are the only one with their key."""
    return df.withColumn("__n", F.count("*").over(W.partitionBy(key))).filter("__n = 1").drop("__n")


def kept_home(defined: DataFrame, uses: DataFrame, key: str, home: str, user: str, least: int) -> DataFrame:
    """Rows of defined, with uses counted, that are used `least` times or more and only at home."""
    near = defined.join(uses, key).groupBy(*defined.columns).agg(F.count("*").alias("uses"), F.bool_and(F.col(user) == F.col(home)).alias("near"))
    return near.filter((F.col("uses") >= least) & F.col("near")).drop("near")


def one_value(df: DataFrame, key: list[str], value: str, least: int) -> DataFrame:
    """(key..., value, n): keys with `least` rows or more whose value is never null and always the same."""
    got = df.groupBy(*key).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.min(value).alias("low"), F.max(value).alias("high"))
    return got.filter((F.col("n") >= least) & (F.col("known") == F.col("n")) & (F.col("low") == F.col("high"))).select(*key, F.col("low").alias(value), "n")


def closure(start: DataFrame, edges: DataFrame, s: Scratch) -> DataFrame:
    """(start, end): nodes reached from each start along edges (from, to), itself included; cycles end where nothing new is found. Each round is one join on the last round's new pairs, written to the shared folder."""
    edges = s.table(edges.distinct())
    seen = fresh = s.table(start.select("start", F.col("start").alias("end")).distinct())
    while True:
        further = fresh.join(edges, fresh["end"] == edges["from"]).select("start", F.col("to").alias("end")).distinct()
        fresh = s.table(further.join(seen, ["start", "end"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = s.table(seen.unionByName(fresh))


def places(df: DataFrame, key: list[str], shown: int = 5) -> DataFrame:
    """(key..., n, containers, shown, path, line): rows and files of each key, the first `shown` places by path and line, and the first of all. Only places to be shown are collected, so that a key found everywhere stays small."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy("path", "line"))
    rows = df.withColumn("__r", rank)
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_distinct("path").alias("containers"),
        F.array_sort(F.collect_list(F.when(F.col("__r") <= shown, F.struct("path", "line")))).alias("shown"),
        F.min_by("path", F.struct("file_ord", "ord")).alias("path"), F.min_by("line", F.struct("file_ord", "ord")).alias("line"),
        F.min("file_ord").alias("file_ord"), F.min("ord").alias("ord"),
    )


def twins(df: DataFrame, place: list[str], shown: int, among: list[str] | None = None) -> DataFrame:
    """(x, size, first, among, places, files, shown) of each x: greatest n, first row, a digest of the set of places that have it, their number, and the first few, the largest first."""
    o = F.struct("file_ord", "ord")
    by = F.struct(-F.col("n"), "file_ord", "ord")
    sets = df.select("x", *(among or place)).distinct().groupBy("x").agg(F.count("*").alias("members"), F.sum(F.xxhash64(*(among or place)).cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *(among or place))).alias("b"))
    per = df.groupBy("x", *place).agg(F.min_by(F.struct(*(c for c in df.columns if c != "x")), by).alias("row"), F.max("n").alias("n"), F.min(o).alias("o"), F.min(by).alias("by"))
    per = per.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("by")))
    got = per.groupBy("x").agg(F.max("n").alias("size"), F.min("o").alias("first"), F.count("*").alias("places"), F.count_distinct("path").alias("files"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", "row")))), lambda s: s["row"]).alias("shown"))
    # Only what occurs twice needs the set's digest.
    return got.filter("places > 1 or files > 1").join(sets, "x").withColumn("among", F.struct("members", "a", "b")).drop("members", "a", "b")


def clumps_within(df: DataFrame, items: str, place: list[str], least_items: int, least_places: int, shown: int) -> DataFrame:
    """(set, whole, places, first, shown): sets of items that are within the sets of enough rows: whole sets, and what two sets have in common.

    Sets that share enough items share a triple of them, so pairs are found by
    an equi join on triples, not by comparing all with all; rows that hold a
    candidate are found by its first triple. A candidate within a larger one
    that is found at as many places is left out.
    """
    rows = df.withColumn("set", F.array_sort(F.array_distinct(items))).filter(F.size("set") >= least_items)
    triples = "flatten(flatten(transform(sequence(0, size(set) - 3), i -> transform(sequence(i + 1, size(set) - 2), j -> transform(sequence(j + 1, size(set) - 1), k -> concat_ws('\\0', set[i], set[j], set[k]))))))"
    first3 = F.concat_ws("\0", F.slice("set", 1, 3))
    sets = rows.groupBy("set").agg(F.count("*").alias("rows"))
    keyed = sets.select("set", F.explode(F.expr(triples)).alias("triple"))
    common = keyed.join(keyed.select(F.col("set").alias("other"), "triple"), "triple").filter("set < other").select("set", "other").distinct().select(F.array_sort(F.array_intersect("set", "other")).alias("set")).distinct()
    whole = sets.filter(F.col("rows") >= least_places).select("set")
    wanted = whole.withColumn("whole", F.lit(True)).unionByName(common.withColumn("whole", F.lit(False))).groupBy("set").agg(F.max("whole").alias("whole")).withColumn("triple", first3)
    inside = wanted.join(keyed.select(F.col("set").alias("outer"), "triple"), "triple").filter(F.size(F.array_except("set", "outer")) == 0).select("set", "whole", "outer")
    held = inside.join(rows.withColumnRenamed("set", "outer"), "outer")
    by = F.struct("file_ord", "ord")
    per = held.groupBy("set", "whole", *place).agg(F.min(by).alias("by"), F.count("*").alias("rows"), F.min_by(F.struct("path", "name", "line"), by).alias("row"))
    per = per.withColumn("r", F.row_number().over(W.partitionBy("set").orderBy("by")))
    got = per.groupBy("set", "whole").agg(F.sum("rows").alias("rows"), F.count("*").alias("places"), F.min("by").alias("first"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", "row")))), lambda s: s["row"]).alias("shown")).filter(F.col("rows") >= least_places)
    larger = got.select(F.col("set").alias("outer"), F.col("places").alias("p")).withColumn("triple", F.explode(F.expr(triples.replace("set[", "outer[").replace("size(set)", "size(outer)"))))
    under = got.withColumn("triple", first3).join(larger, "triple").filter((F.col("places") == F.col("p")) & (F.size("outer") > F.size("set")) & (F.size(F.array_except("set", "outer")) == 0)).select("set").distinct()
    return got.join(under, "set", "left_anti").drop("rows")
