"""The seventeen checks over version history."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.messages import LABELS, has, is_good, number, scope, text
from ..operators import core

FINDING = "file string, line int, check string, message string, severity string, check_ord int, seq long"
BULK = 30
PAIR_LIMIT = 20
STRUCTURAL = tuple("benchmarks bin dev docs docs_src documentation examples samples scripts test testing tests tools".split())


def window_days(window: str) -> int:
    m = re.fullmatch(r"(\d+)([dmy])", window)
    return int(m[1]) * {"d": 1, "m": 30, "y": 365}[m[2]] if m else 180


@dataclass
class History:
    """files (file_ord, path, n_lines_ast), commits (hash, seq, ts, ts_raw, author, subject), commit_files (hash, path), numstat (hash, path, ins, del), reviews (path, ts), imports (path, module, level, from_import)."""

    files: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    numstat: DataFrame | None = None
    reviews: DataFrame | None = None
    imports: DataFrame | None = None
    marks: DataFrame | None = None  # reviews that count as modifications even where reviews are ignored
    window: str = "6m"
    messages: str = "auto"
    expected: list[list[str]] = field(default_factory=list)

    @cached_property
    def analysed(self) -> DataFrame:
        return self.files.select("file_ord", "path", "n_lines_ast")

    @cached_property
    def reviewed(self) -> DataFrame:
        if self.reviews is None:
            return self.commits.sparkSession.createDataFrame([], "path string, reviewed timestamp")
        return self.reviews.groupBy("path").agg(F.max("ts").alias("reviewed"))

    @cached_property
    def labelled(self) -> DataFrame:
        """Commits with label flags and the number of their source files."""
        sizes = self.commit_files.filter(F.col("path").endswith(".py")).distinct().groupBy("hash").agg(F.count("*").alias("size"))
        rows = self.commits.join(sizes, "hash", "left").withColumn("size", F.coalesce("size", F.lit(0)))
        return rows.select("*", *(has(x, F.col("subject")).alias(x) for x in LABELS))

    @cached_property
    def touched(self) -> DataFrame:
        return self.commit_files.select("hash", "path").distinct().join(self.labelled, "hash")

    @cached_property
    def since(self) -> DataFrame:
        """Commits of analysed files after the file's review."""
        rows = self.touched.join(self.analysed, "path").join(self.reviewed, "path", "left")
        return rows.filter(F.col("reviewed").isNull() | (F.col("ts") > F.col("reviewed")))

    @cached_property
    def calm(self) -> DataFrame:
        """The same without bulk commits."""
        return self.since.filter(F.col("size") < BULK)

    @cached_property
    def churn(self) -> DataFrame:
        """(path, ins, dels, n): lines added and deleted, and commits, after the review."""
        if self.numstat is None:
            return self.commits.sparkSession.createDataFrame([], "path string, ins long, dels long, n long")
        rows = self.numstat.join(self.commits.select("hash", "ts"), "hash").join(self.reviewed, "path", "left").filter(F.col("reviewed").isNull() | (F.col("ts") > F.col("reviewed")))
        return rows.groupBy("path").agg(F.sum("ins").alias("ins"), F.sum("del").alias("dels"), F.count_distinct("hash").alias("n"))

    def gated(self, df: DataFrame) -> DataFrame:
        """Nothing where too few of the latest fifty subjects say something."""
        if self.messages == "structured":
            return df
        if self.messages == "unstructured":
            return df.limit(0)
        sample = self.commits.orderBy("seq").limit(50)
        gate = sample.agg(F.avg(is_good(F.col("subject")).cast("int")).alias("q")).filter("q >= 0.5").select(F.lit(1).alias("gate"))
        return df.crossJoin(F.broadcast(gate)).drop("gate")

    @cached_property
    def period(self) -> int:
        """Seconds of a slice: whole weeks, about a 26th of the window."""
        return max(7, max(7, window_days(self.window) // 26) // 7 * 7) * 86_400

    @cached_property
    def span(self) -> DataFrame:
        """One row (t0, slices, per_slice): the first commit, the number of slices, the median of commits in those that have any."""
        ends = self.commits.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).filter("t0 is not null")
        grid = ends.select("t0", (self._slot(F.col("t1")) + 1).alias("slices"))
        per = self.commits.crossJoin(F.broadcast(ends)).groupBy(self._slot(F.col("ts")).alias("slot")).agg(F.count("*").alias("n")).agg(F.median("n").alias("per_slice"))
        return grid.crossJoin(per)

    def _slot(self, ts: Column) -> Column:
        return F.floor((F.unix_micros(ts) - F.unix_micros("t0")) / (self.period * 1_000_000)).cast("long")

    def sliced(self, least: int) -> DataFrame:
        """Commits of analysed files with slot, and the file's first slot after its review; nothing where there are fewer slices than `least`."""
        rows = self.touched.join(self.analysed, "path").join(self.reviewed, "path", "left").crossJoin(F.broadcast(self.span.filter(F.col("slices") >= least)))
        # A slice that ends after the review counts whole.
        first = F.when(F.col("reviewed").isNull(), 0).otherwise(F.greatest(F.lit(0), self._slot(F.col("reviewed")))).cast("long")
        return rows.withColumn("slot", self._slot(F.col("ts"))).withColumn("first_slot", first).filter("slot >= first_slot")


Check = Callable[[History], DataFrame]
CHECKS: dict[str, tuple[Check, str]] = {}


def check(name: str, severity: str) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        CHECKS[name] = (f, severity)
        return f

    return add


def say(h: History, df: DataFrame, name: str, message: Column, order: list[str | Column] | None = None) -> DataFrame:
    """Findings at line 1 of path, in the order of the files."""
    ord_ = list(CHECKS).index(name)
    rows = df if "file_ord" in df.columns else df.join(h.analysed.select("path", "file_ord"), "path")
    rows = rows.withColumn("message", message)
    seq = F.row_number().over(W.orderBy(*(order or ["file_ord"]))).cast("long")
    return rows.select(F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(name).alias("check"), "message", F.lit(CHECKS[name][1]).alias("severity"), F.lit(ord_).alias("check_ord"), seq.alias("seq"))


def percent(c: str) -> Column:
    return (F.col(c) * 100).cast("int").cast("string")


def source(df: DataFrame) -> DataFrame:
    return df.filter(~P.is_test_history(F.col("path")))


@check("bug-magnet", "medium")
def bug_magnet(h: History) -> DataFrame:
    got = core.share(source(h.calm), "path", F.col("fix"), 5, 0.5)
    return say(h, h.gated(got), "bug-magnet", text(F.col("path"), " — ", number("hits"), " of ", number("n"), " commits (", percent("share"), "%) are fixes — redesign what keeps breaking"))


def _pairs(h: History, rows: DataFrame, least: int, ratio: float) -> DataFrame:
    rows = rows.filter(F.col("path").endswith(".py")).join(h.analysed, "path", "left_semi").filter((P.name(F.col("path")) != "__init__.py") & ~P.is_migration(F.col("path")))
    got = core.together(rows, "hash", "path", least, ratio, PAIR_LIMIT)
    got = got.filter(P.is_test_history(F.col("a")) == P.is_test_history(F.col("b")))
    for x, y in h.expected:
        x, y = P.glob_regex(x), P.glob_regex(y)
        got = got.filter(~((F.col("a").rlike(x) & F.col("b").rlike(y)) | (F.col("a").rlike(y) & F.col("b").rlike(x))))
    # In the order the first common commit, then the names, would list them.
    return got.withColumn("path", F.col("a"))


@check("fix-propagation", "medium")
def fix_propagation(h: History) -> DataFrame:
    got = _pairs(h, h.touched.filter("fix"), 3, 0.6)
    return say(h, h.gated(got), "fix-propagation", text(F.col("a"), " and ", F.col("b"), " — ", number("together"), " of ", number("least"), " fix commits touch both files"), ["file_ord", "b"])


@check("fix-follows-feature", "medium")
def fix_follows_feature(h: History) -> DataFrame:
    rows = source(h.sliced(4).filter("per_slice >= 2"))
    got = core.follows(rows, "path", "slot", "feature", "fix", 2, 3)
    return say(h, h.gated(got), "fix-follows-feature", text(F.col("path"), " — ", number("pairs"), f" feature→fix sequences in last {h.window} — test or review new features more"))


@check("stabilization-failure", "low")
def stabilization_failure(h: History) -> DataFrame:
    busy = h.since.groupBy("path").agg(F.count("*").alias("n")).filter("n >= 8")
    got = core.bursts(h.sliced(6).join(busy, "path", "left_semi"), "path", "slot", 2, 3)
    return say(h, got, "stabilization-failure", text(F.col("path"), " — ", number("bursts"), f" activity bursts in last {h.window} — it never settles"))


@check("blast-radius", "medium")
def blast_radius(h: History) -> DataFrame:
    from ..operators.ranking import collapsed

    size = h.labelled.agg(F.coalesce(F.median("size"), F.lit(1.0)).alias("size_median"))
    rows = source(h.since).filter(P.name(F.col("path")) != "__init__.py").withColumn("others", F.col("size") - F.col("path").endswith(".py").cast("int")).filter(F.col("others") < PAIR_LIMIT)
    got = rows.groupBy("path").agg(F.count("*").alias("n"), F.median("others").alias("m")).filter("n >= 5").crossJoin(F.broadcast(size))
    got = got.filter(F.col("m") >= F.greatest(F.lit(8), (F.col("size_median") * 2.5).cast("int")))
    found = say(h, got, "blast-radius", text(F.col("path"), " — changes touch a median of ", number(F.col("m").cast("int")), " other files per commit (", number("n"), f" commits in last {h.window})"))
    return collapsed(found)


@check("change-coupling", "medium")
def change_coupling(h: History) -> DataFrame:
    got = _pairs(h, h.touched, 5, 0.7)
    if h.imports is not None:
        linked = import_links(h, got)
        got = got.join(linked, ["a", "b"], "left_anti")
    got = got.join(h.analysed.select(F.col("path").alias("a"), "file_ord"), "a").withColumn("dir", P.parent(F.col("a"))).withColumn("inside", F.col("dir") == P.parent(F.col("b")))
    got = got.withColumn("pairs", F.count("*").over(W.partitionBy("inside", "dir")))
    many = got.filter("inside and pairs >= 3")
    alone = got.filter("not inside or pairs < 3")
    told = text(F.col("a"), " and ", F.col("b"), " changed together in ", number("together"), "/", number("least"), f" commits (last {h.window}), neither imports the other")
    alone = alone.select("path", "file_ord", "b", "inside", told.alias("said"))
    both = many.groupBy("dir").agg(F.min("file_ord").alias("file_ord"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("all"))
    whole = both.select(F.col("dir").alias("path"), "file_ord", F.lit("").alias("b"), F.lit(True).alias("inside"), text(F.col("dir"), "/ — ", number(F.size("all")), " files with ", number("n"), " coupling pairs (", F.array_join(F.transform("all", P.name), ", "), ") — tightly-coupled subsystem").alias("said"))
    return say(h, alone.unionByName(whole), "change-coupling", F.col("said"), ["inside", "file_ord", "b"])


def import_links(h: History, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of which one imports the other, or a package around it, or something in it."""
    i = h.imports
    pkg = F.regexp_replace(F.when(F.col("path").contains("/"), P.parent(F.col("path"))).otherwise(F.lit("")), "/", ".")
    parts = F.split(pkg, r"\.")
    up = F.when(F.col("level") > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - F.col("level") + 1)), ".")).otherwise(pkg)
    base = F.when((F.col("level") == 0) | (pkg == ""), F.coalesce("module", F.lit(""))).otherwise(F.when(F.col("module").isNull(), up).otherwise(F.when(up == "", F.col("module")).otherwise(F.concat(up, F.lit("."), F.col("module")))))
    seen = i.filter("from_import and (level > 0 or module is not null) or not from_import and module is not null").select("path", F.when(F.col("from_import"), base).otherwise(F.col("module")).alias("to"), "from_import").distinct()
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mod = P.module(F.col("b"))
    hit = (F.col("to") == mod) | F.col("to").startswith(F.concat(mod, F.lit("."))) | (F.col("from_import") & mod.startswith(F.concat(F.col("to"), F.lit("."))))
    found = both.join(seen, F.col("a") == F.col("path")).filter(hit)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _churned(h: History, lines: int, commits: int) -> DataFrame:
    return source(h.analysed).filter(F.col("n_lines_ast") >= lines).join(h.churn, "path").filter(F.col("n") >= commits)


@check("yo-yo-code", "medium")
def yo_yo_code(h: History) -> DataFrame:
    got = _churned(h, 100, 5).withColumn("gross", F.col("ins") + F.col("dels")).withColumn("ratio", F.col("gross") / F.col("n_lines_ast")).filter("ratio >= 3.0")
    return say(h, got, "yo-yo-code", text(F.col("path"), " — ", number("gross"), " lines churned across ", number("n_lines_ast"), " lines of code (", number("ratio", ".1f"), f"x turnover) in last {h.window}"))


@check("conscious-debt", "low")
def conscious_debt(h: History) -> DataFrame:
    rows = h.touched.filter("debt").join(h.analysed, "path")
    got = rows.groupBy("path", "file_ord").agg(F.count("*").alias("n"), F.min_by(F.struct("hash", "subject", "ts_raw", "seq"), "seq").alias("c"))
    latest = text(F.substring("c.hash", 1, 7), ' "', F.col("c.subject"), '" (', F.substring("c.ts_raw", 1, 10), ")")
    head = F.when(F.col("n") == 1, F.lit("commit ")).otherwise(text(number("n"), " debt commits, most recent: "))
    return say(h, h.gated(got), "conscious-debt", text(F.col("path"), " — ", head, latest, " — acknowledged debt, still needed?"), [F.col("c.seq"), "path"])


@check("emergency-hotspots", "low")
def emergency_hotspots(h: History) -> DataFrame:
    rate = h.labelled.filter(F.col("size") < BULK).agg(F.avg(F.col("emergency").cast("int")).alias("rate")).filter("rate <= 0.3")
    got = core.share(h.calm, "path", F.col("emergency"), 1, 0.3, 3).crossJoin(F.broadcast(rate))
    return say(h, got, "emergency-hotspots", text(F.col("path"), " — ", number("hits"), " of ", number("n"), " commits (", percent("share"), "%) are emergency/hotfix changes"))


@check("no-refactoring", "low")
def no_refactoring(h: History) -> DataFrame:
    got = source(h.calm).filter("n_lines_ast >= 50").groupBy("path").agg(F.count("*").alias("n"), *(F.count_if(x).alias(x) for x in ("fix", "feature", "refactor"))).filter("n >= 8 and refactor = 0 and fix + feature >= 6")
    return say(h, h.gated(got), "no-refactoring", text(F.col("path"), " — ", number("n"), " commits (", number("fix"), " fixes, ", number("feature"), " features) but zero refactoring"))


@check("test-erosion", "low")
def test_erosion(h: History) -> DataFrame:
    path = F.col("path")
    counts = h.calm.groupBy("path").agg(F.count("*").alias("n"))
    rows = source(h.analysed).filter(~P.is_stable(path) & ~P.is_migration(path) & (F.col("n_lines_ast") >= 50)).join(counts, "path").filter("n >= 5")
    s, up = P.stem(path), F.when(path.contains("/"), F.concat(P.parent(path), F.lit("/"))).otherwise(F.lit(""))
    places = F.array(*(F.concat(d, *n) for d in (up, F.concat(up, F.lit("tests/")), F.lit("tests/")) for n in ((F.lit("test_"), s, F.lit(".py")), (s, F.lit("_test.py")))))
    tests = rows.select("path", F.posexplode(places).alias("at", "test")).join(h.analysed.select(F.col("path").alias("test")), "test").groupBy("path").agg(F.min_by("test", "at").alias("test"))
    got = rows.join(tests, "path").join(counts.select(F.col("path").alias("test"), F.col("n").alias("t")), "test", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    got = got.withColumn("ratio", F.col("n") / F.greatest("t", F.lit(1))).filter("ratio >= 3.0")
    return say(h, got, "test-erosion", text(path, " — ", number("n"), " source commits but only ", number("t"), f" test commits in last {h.window} (", number("ratio", ".1f"), "x ratio)"))


@check("growth-trajectory", "low")
def growth_trajectory(h: History) -> DataFrame:
    got = h.analysed.filter("n_lines_ast >= 100").join(h.churn, "path").withColumn("start", F.col("n_lines_ast") - (F.col("ins") - F.col("dels"))).filter(F.col("start") > 0)
    got = got.withColumn("ratio", F.col("n_lines_ast") / F.col("start")).filter("n_lines_ast - start >= 200 and ratio >= 2.0")
    return say(h, got, "growth-trajectory", text(F.col("path"), " grew from ~", number("start"), " to ", number("n_lines_ast"), " lines (+", number(((F.col("ratio") - 1) * 100).cast("int")), f"%) in last {h.window}"))


@check("churn-without-growth", "low")
def churn_without_growth(h: History) -> DataFrame:
    got = _churned(h, 50, 10).withColumn("net", F.col("ins") - F.col("dels")).filter(F.col("net") <= F.col("n_lines_ast") * F.lit(0.1))
    return say(h, got, "churn-without-growth", text(F.col("path"), " — ", number("n"), " commits but only +", number("net"), " net lines (", number("n_lines_ast"), f" lines total) in last {h.window}"))


@check("hotspot-acceleration", "medium")
def hotspot_acceleration(h: History) -> DataFrame:
    busy = source(h.since).groupBy("path").agg(F.count("*").alias("commits")).filter("commits >= 5")
    rows = h.sliced(4).join(busy, "path", "left_semi").filter("slices - first_slot >= 4")
    per = rows.groupBy("path", "slot", "slices", "first_slot").agg(F.count_if(F.col("size") < BULK).alias("n"))
    mid = F.col("first_slot") + F.floor((F.col("slices") - F.col("first_slot")) / 2)
    per = per.withColumn("late", F.col("slot") >= mid).withColumn("width", F.when(F.col("late"), F.col("slices") - mid).otherwise(mid - F.col("first_slot")))
    # Slices without commits are zeros: pad the sorted counts on the left.
    got = per.groupBy("path", "late", "width").agg(F.array_sort(F.collect_list("n")).alias("c"), F.sum("n").alias("total"))
    at = lambda i: F.coalesce(F.get("c", (i - (F.col("width") - F.size("c"))).cast("int")), F.lit(0))
    got = got.withColumn("m", (at(F.floor((F.col("width") - 1) / 2)) + at(F.floor(F.col("width") / 2))) / 2)
    got = got.groupBy("path").agg(F.coalesce(F.max(F.when(~F.col("late"), F.col("m"))), F.lit(0.0)).alias("first"), F.max(F.when(F.col("late"), F.col("m"))).alias("second"), F.sum(F.when(F.col("late"), F.col("total"))).alias("total"))
    got = got.filter("total >= 3").filter(F.when(F.col("first") == 0, F.col("second") >= 2).otherwise(F.col("second") >= 2 * F.col("first")))
    return say(h, got, "hotspot-acceleration", text(F.col("path"), " — change frequency accelerating: median ", number("first", ".0f"), "→", number("second", ".0f"), f" commits per period in last {h.window}"))


@check("abandoned-code", "low")
def abandoned_code(h: History) -> DataFrame:
    # A review counts as a modification here.
    marks = h.marks.select("path") if h.marks is not None else h.reviewed.select("path")
    active = h.commit_files.select("path").unionByName(marks).distinct()
    members = h.analysed.withColumn("dir", P.parent(F.col("path")))
    got = core.inactive_peers(members, "dir", "path", active, 3, 2 / 3).join(h.analysed, "path")
    got = got.filter(F.col("active") * 3 >= F.col("peers") * 2)
    got = source(got).filter(~P.is_stable(F.col("path")) & (F.col("n_lines_ast") >= 20))
    w = F.min("file_ord").over(W.partitionBy("dir"))
    return say(h, got.withColumn("dir_ord", w), "abandoned-code", text(F.col("path"), f" has no commits in the last {h.window}, but ", number("active"), " of ", number("peers"), " peers in ", F.col("dir"), "/ have"), ["dir_ord", "file_ord"])


@check("knowledge-silo", "medium")
def knowledge_silo(h: History) -> DataFrame:
    team = h.commits.filter("author <> ''").agg(F.count_distinct("author").alias("authors")).filter("authors >= 3")
    got = core.dominance(source(h.since).filter("author <> ''"), "path", "author", "seq", 5, 0.8).crossJoin(F.broadcast(team))
    return say(h, got, "knowledge-silo", text(F.col("path"), " — ", F.col("author"), " authored ", number("hits"), " of ", number("n"), " commits (", percent("share"), "%) — bus-factor risk"))


@check("divergent-change", "medium")
def divergent_change(h: History) -> DataFrame:
    rows = source(h.since).filter(~P.is_stable(F.col("path")) & (F.col("n_lines_ast") >= 50)).select("hash", "path", "file_ord", "subject")
    scopes = rows.withColumn("concern", scope(F.col("subject"))).filter("concern is not null").groupBy("path", "file_ord", "concern").agg(F.count("*").alias("n"))
    top = lambda p: F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(F.lit(""))
    other = h.commit_files.filter(F.col("path").endswith(".py")).select("hash", F.col("path").alias("other"), top(F.col("path")).alias("concern")).filter((F.col("concern") != "") & ~F.col("concern").isin(*STRUCTURAL))
    dirs = rows.join(other, "hash").filter((F.col("other") != F.col("path")) & (F.col("concern") != top(F.col("path")))).groupBy("path", "file_ord", "concern").agg(F.count_distinct("hash").alias("n"))
    both = scopes.withColumn("kind", F.lit(0)).unionByName(dirs.withColumn("kind", F.lit(1))).filter("n >= 2")
    sets = both.groupBy("path", "file_ord", "kind").agg(F.array_sort(F.collect_set("concern")).alias("all")).filter(F.size("all") >= 4)
    got = sets.groupBy("path", "file_ord").agg(F.min_by("all", "kind").alias("all"))
    return say(h, h.gated(got), "divergent-change", text(F.col("path"), " appears in commits for ", number(F.size("all")), " different concerns (", F.array_join("all", ", "), ")"))


def run(h: History, only: list[str] | None = None) -> DataFrame:
    """All findings of the history checks, or of some."""
    found = [f(h) for name, (f, _) in CHECKS.items() if only is None or name in only]
    out = found[0] if found else h.commits.sparkSession.createDataFrame([], FINDING)
    for x in found[1:]:
        out = out.unionByName(x)
    return out
