"""Relational operators that the checks are composed of.

They take frames and column names, so that a check on code and a report on any
other table run the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def together(df: DataFrame, group: str, item: str, least_pairs: int, least_ratio: float, below: int | None = None) -> DataFrame:
    """(a, b, together, least, ratio): items a < b that share groups, against the rarer one's number of groups.

    Groups of `below` items or more are left out. The pair join is an equi join
    on the group, bounded by the square of that limit.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g is not null and i is not null").distinct()
    if below is not None:
        rows = rows.withColumn("size", F.count("*").over(W.partitionBy("g"))).filter(F.col("size") < below).drop("size")
    counts = rows.groupBy("i").agg(F.count("*").alias("n"))
    pairs = rows.withColumnRenamed("i", "a").join(rows.withColumnRenamed("i", "b"), "g").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).filter(F.col("together") >= least_pairs)
    both = pairs.join(counts.select(F.col("i").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "together", F.least("na", "nb").alias("least"), (F.col("together") / F.least("na", "nb")).alias("ratio")).filter(F.col("ratio") >= least_ratio)


def share(df: DataFrame, key: str, flag: Column, least_rows: int, least_share: float, least_hits: int = 0) -> DataFrame:
    """(key, n, hits, share): keys in which enough rows have the flag."""
    got = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"))
    return got.withColumn("share", F.col("hits") / F.col("n")).filter((F.col("n") >= least_rows) & (F.col("share") >= least_share) & (F.col("hits") >= least_hits))


def dominance(df: DataFrame, key: str, member: str, order: str, least_rows: int, least_share: float) -> DataFrame:
    """(key, member, hits, n, share): the member with most rows of a key, of equal ones that with the least order."""
    got = df.filter(F.col(member).isNotNull()).groupBy(key, member).agg(F.count("*").alias("hits"), F.min(order).alias("o"))
    top = got.groupBy(key).agg(F.max_by(F.struct(member, "hits"), F.struct(F.col("hits"), -F.col("o"))).alias("t"), F.sum("hits").alias("n"))
    return top.select(key, f"t.{member}", "t.hits", "n", (F.col("t.hits") / F.col("n")).alias("share")).filter((F.col("n") >= least_rows) & (F.col("share") >= least_share))


def bursts(active: DataFrame, key: str, slot: str, length: int, least: int) -> DataFrame:
    """(key, bursts): keys with enough maximal runs of `length` or more consecutive slots. Gaps and islands."""
    rows = active.select(key, slot).distinct()
    isles = rows.withColumn("isle", F.col(slot) - F.row_number().over(W.partitionBy(key).orderBy(slot))).groupBy(key, "isle").agg(F.count("*").alias("n"))
    return isles.filter(F.col("n") >= length).groupBy(key).agg(F.count("*").alias("bursts")).filter(F.col("bursts") >= least)


def follows(rows: DataFrame, key: str, slot: str, cause: str, effect: str, within: int, least: int) -> DataFrame:
    """(key, pairs): slots with the cause that the effect follows in one of the next `within` slots. A range frame over slot numbers, so that empty slots need no rows."""
    per = rows.groupBy(key, slot).agg(F.max(F.col(cause).cast("int")).alias("c"), F.max(F.col(effect).cast("int")).alias("e"))
    ahead = W.partitionBy(key).orderBy(F.col(slot).cast("long")).rangeBetween(1, within)
    return per.withColumn("next", F.max("e").over(ahead)).filter("c = 1 and next = 1").groupBy(key).agg(F.count("*").alias("pairs")).filter(F.col("pairs") >= least)


def scattered(df: DataFrame, value: list[str], container: str, least: int) -> DataFrame:
    """(value..., containers): values in enough different containers."""
    return df.groupBy(*value).agg(F.count_distinct(container).alias("containers")).filter(F.col("containers") >= least)


def unreferenced(defined: DataFrame, *uses: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows of defined that none of the frames refer to: a chain of left-anti joins."""
    for used, on in uses:
        defined = defined.join(used.select(*on).distinct(), on, "left_anti")
    return defined


def referenced_once(defined: DataFrame, uses: DataFrame, on: list[str]) -> DataFrame:
    """Rows of defined with exactly one use."""
    return defined.join(uses.groupBy(*on).agg(F.count("*").alias("n")).filter("n = 1").select(*on), on, "left_semi")


def constant(df: DataFrame, key: list[str], value: str, least_rows: int) -> DataFrame:
    """(key..., value, n): keys whose every row has one and the same value, nulls being a value of their own."""
    got = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(value).alias("kinds"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias(value))
    return got.filter((F.col("n") >= least_rows) & (((F.col("kinds") == 1) & (F.col("nulls") == 0)) | (F.col("nulls") == F.col("n")))).select(*key, value, "n")


def same_rows(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """(digest, keys): groups of keys whose value is equal; grouped by a digest, as values may be long."""
    got = df.filter(F.col(value).isNotNull()).groupBy(F.sha2(F.col(value).cast("binary"), 256).alias("digest")).agg(F.array_sort(F.collect_set(key)).alias("keys"))
    return got.filter(F.size("keys") >= least)


def clumps(df: DataFrame, group: str, item: str, least_items: int, least_groups: int) -> DataFrame:
    """(items, groups): sets of items that are the whole set of enough groups."""
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("items")).filter(F.size("items") >= least_items)
    return sets.groupBy("items").agg(F.count("*").alias("groups")).filter(F.col("groups") >= least_groups)


def inactive_peers(members: DataFrame, group: str, member: str, active: DataFrame, least: int, share_active: float) -> DataFrame:
    """(group, member, peers, active): members without activity in groups where enough of the others have it."""
    seen = members.select(group, member).distinct().join(active.select(member, F.lit(1).alias("hit")).distinct(), member, "left")
    w = W.partitionBy(group)
    seen = seen.withColumn("peers", F.count("*").over(w)).withColumn("active", F.count("hit").over(w))
    return seen.filter(F.col("hit").isNull() & (F.col("peers") >= least) & (F.col("active") > 0) & (F.col("active") * 1.0 >= F.col("peers") * share_active)).select(group, member, "peers", "active")


def co_size(df: DataFrame, group: str, item: str, least_groups: int, below: int, least: float) -> DataFrame:
    """(item, groups, median_others): items whose groups have, in the median, so many other items; groups with `below` or more others don't count."""
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item")).distinct().withColumn("others", F.count("*").over(W.partitionBy("g")) - 1)
    return rows.filter(F.col("others") < below).groupBy("item").agg(F.count("*").alias("groups"), F.median("others").alias("median_others")).filter((F.col("groups") >= least_groups) & (F.col("median_others") >= least))


def halves(rows: DataFrame, key: str, slot: str, slots: int) -> DataFrame:
    """(key, first, second, total): medians of rows per slot in the first and second half of `slots` slots, empty ones included, and the second half's rows."""
    mid = slots // 2
    per = rows.groupBy(key, slot).agg(F.count("*").alias("n"))

    def median(side: Column, n: int) -> Column:
        # Zeros stand for the slots without rows: pad the sorted counts on the left.
        got = F.array_sort(F.collect_list(F.when(side, F.col("n"))))
        at = lambda i: F.coalesce(F.get(got, F.lit(i) - (F.lit(n) - F.size(got))), F.lit(0))
        return (at((n - 1) // 2) + at(n // 2)) / 2 if n else F.lit(0.0)

    left = F.col(slot) < mid
    return per.groupBy(key).agg(median(left, mid).alias("first"), median(~left, slots - mid).alias("second"), F.coalesce(F.sum(F.when(~left, F.col("n"))), F.lit(0)).alias("total"))


def prefixed(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows with each of a small table's prefixes that their column begins with."""
    return rows.join(F.broadcast(prefixes), F.col(column).startswith(F.col(prefix)))
