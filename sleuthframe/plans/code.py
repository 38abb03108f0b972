"""The fifty-four checks over source code, as plans over its facts."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..cluster import Scratch
from ..functions import paths as P
from ..functions.messages import number, text
from ..operators import code as ops
from ..sources.catalog import PATTERNS
from ..sources.python_code import extract

FINDING = "file string, line int, check string, message string, severity string, check_ord int, seq long"


#: Paths that the driver sees to find where ranges of paths end, and how many of them make a range.
SEEN, RANGE = 8192, 32


def in_order(files: DataFrame) -> DataFrame:
    """Files with file_ord, their number in the order of paths. Ranges of paths are numbered apart, each from the number of paths before it, so that no task holds them all."""
    parts = F.split("path", "/")
    files = files.filter("path is not null")
    seen = sorted(r[0].split("/") for r in files.select("path").orderBy(F.xxhash64("path"), "path").limit(SEEN).collect())
    bounds = seen[RANGE::RANGE]
    if not bounds:
        return files.withColumn("file_ord", F.row_number().over(W.orderBy(parts)).cast("long"))
    ends = F.array(*(F.array(*map(F.lit, b)) for b in bounds))
    files = files.withColumn("range", F.size(F.filter(ends, lambda b: b <= parts)))
    counts = dict(files.groupBy("range").count().collect())
    before = [0, *itertools.accumulate(counts.get(i, 0) for i in range(len(bounds)))]
    at = F.row_number().over(W.partitionBy("range").orderBy(parts)) + F.get(F.array(*map(F.lit, before)), F.col("range"))
    return files.repartition(len(bounds) + 1, "range").withColumn("file_ord", at.cast("long")).drop("range")


@dataclass
class Code:
    """The facts of a code base. They are cached, or, where `at` names a folder that all executors share, written there by kind, so that each check reads its own kinds only."""

    facts: DataFrame
    at: str | None = None

    @classmethod
    def read(cls, files: DataFrame, at: str | None = None, kinds: tuple[str, ...] | None = None) -> Code:
        """files: path, src, and file_ord where the order isn't that of the paths. kinds: those of the facts that will be read, if not all."""
        if "file_ord" not in files.columns:
            files = in_order(files)
        facts = extract(files, kinds)
        if at is None:
            return cls(facts.cache())
        facts.write.partitionBy("kind").parquet(at)
        return cls(facts.sparkSession.read.schema(facts.schema).parquet(at), at)

    def __getitem__(self, kind: str) -> DataFrame:
        return self.facts.filter(F.col("kind") == kind)

    def __call__(self, kind: str, *columns: str | Column) -> DataFrame:
        return self[kind].select(*columns)

    def names(self, *kinds: str) -> DataFrame:
        return self.facts.filter(F.col("kind").isin(*kinds)).select("name").distinct()

    @cached_property
    def files(self) -> DataFrame:
        return self("file", "file_ord", "path", F.col("n").alias("n_lines_ast"))

    @cached_property
    def index(self) -> DataFrame:
        """Public functions of modules, but for those that a main guard calls."""
        return self["func"].join(self.names("entry"), "name", "left_anti")

    @cached_property
    def unique(self) -> DataFrame:
        return ops.only(self.index, "name")

    def elsewhere(self, df: DataFrame) -> DataFrame:
        """Without those whose name another file imports."""
        used = self("imported", "name", F.col("path").alias("user"))
        return df.join(used, (df["name"] == used["name"]) & (df["path"] != used["user"]), "left_anti")

    def unexported(self, df: DataFrame, name: str = "name") -> DataFrame:
        return df.join(self("exported", F.col("name").alias(name), "path").distinct(), [name, "path"], "left_anti")

    def without(self, df: DataFrame, *kinds: str) -> DataFrame:
        return df.join(self.names(*kinds), "name", "left_anti")

    @cached_property
    def call_counts(self) -> DataFrame:
        return self["call"].groupBy("name").agg(F.count("*").alias("calls"))


Check = Callable[[Code], DataFrame]
CHECKS: dict[str, tuple[Check, str]] = {}
#: The kinds of facts that a check reads, where they are few; all others read what they like.
KINDS: dict[str, tuple[str, ...]] = {"duplicate-blocks": ("block",), "duplicate-except-blocks": ("handler",), "param-clumps": ("signature",)}


def check(name: str, severity: str = "medium") -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        CHECKS[name] = (f, severity)
        return f

    return add


def local(name: str, severity: str = "medium") -> None:
    """A check that the facts of one file decide."""

    def run(c: Code) -> DataFrame:
        rows = c["found"].filter(F.col("name") == name)
        return rows.select(F.col("path").alias("file"), "line", F.col("name").alias("check"), F.col("x").alias("message"), F.col("y").alias("severity"), F.lit(list(CHECKS).index(name)).alias("check_ord"), _place())

    CHECKS[name] = (run, severity)
    KINDS[name] = ("found",)


def _place() -> Column:
    return (F.shiftleft(F.coalesce("file_ord", F.lit(0)), 24) + F.col("ord")).alias("seq")


def say(df: DataFrame, name: str, message: Column, by: list[str | Column] | None = None, severity: Column | None = None) -> DataFrame:
    """Findings at path and line, in the order of the facts or of the columns in `by`."""
    seq = F.row_number().over(W.orderBy(*by)).cast("long").alias("seq") if by else _place()
    return df.select(F.col("path").alias("file"), F.col("line"), F.lit(name).alias("check"), message.alias("message"), (F.lit(CHECKS[name][1]) if severity is None else severity).alias("severity"), F.lit(list(CHECKS).index(name)).alias("check_ord"), seq)


def at(struct: str) -> Column:
    """Places path:line as text, of an array of structs."""
    return F.array_join(F.transform(struct, lambda s: F.concat(s["path"], F.lit(":"), s["line"].cast("string"))), ", ")


# -- architecture


@check("shared-mutable-module-state")
def shared_state(c: Code) -> DataFrame:
    mutable = c("mutable", "name", F.col("path").alias("home"), F.col("line").alias("home_line"), F.struct("file_ord", "ord").alias("o"))
    first = mutable.groupBy("name").agg(F.min_by(F.struct("home", "home_line"), "o").alias("d"), F.collect_set("home").alias("homes"))
    taken = c("accessible", "path", F.col("name").alias("as"), F.col("x").alias("name")).join(mutable.select("name", "home"), "name").filter("home <> path").select("path", F.col("as").alias("name"))
    # The first file, in order, whose path ends with the imported one; they meet by the ends of file names.
    last = lambda col: F.substring_index(col, "/", -1)
    ends = c.files.select("file_ord", F.col("path").alias("source"), last("path").alias("base")).select("file_ord", "source", F.explode(F.expr("transform(sequence(1, length(base)), i -> substring(base, i))")).alias("end"))
    stars = c("star", "path", F.col("name").alias("tail")).distinct().withColumn("end", last("tail")).join(ends, "end").filter(F.col("source").endswith(F.col("tail"))).groupBy("path", "tail").agg(F.min_by("source", "file_ord").alias("source"))
    starred = stars.join(c("top_name", F.col("path").alias("source"), "name"), "source").join(first.select("name"), "name", "left_semi").select("path", "name")
    reach = taken.unionByName(starred).distinct()
    got = c("mutated", "path", "name", "line", "ord", "flag")
    got = got.filter("flag").select("path", "name", "line", "ord").unionByName(got.filter("not flag").join(reach, ["path", "name"], "left_semi").select("path", "name", "line", "ord"))
    got = got.join(first, "name").filter(~F.array_contains("homes", F.col("path")))
    got = got.groupBy("name", "d").agg(F.count_distinct("path").alias("n"), F.array_sort(F.collect_list(F.struct("path", "ord", "line"))).alias("where"))
    got = got.withColumn("path", F.col("d.home")).withColumn("line", F.col("d.home_line"))
    return say(got, "shared-mutable-module-state", text(F.col("name"), " (defined in ", F.col("path"), ":", number("line"), ") is mutated at module scope from ", number("n"), " other file(s) (", at("where"), ")"), ["name"])


@check("write-only-attributes")
def write_only(c: Code) -> DataFrame:
    exported = c("exported", F.col("name").alias("x")).distinct()
    got = c.without(c["field"], "attr_load").join(exported, "x", "left_anti")
    return say(got, "write-only-attributes", text(F.col("x"), ".", F.col("name"), " is never read anywhere"))


for _name in ("temporal-coupling", "feature-envy"):
    local(_name)


@check("anemic-domain")
def anemic(c: Code) -> DataFrame:
    bags = c["data_bag"].select("file_ord", "ord", "path", "line", "name", "items", "more")
    based = bags.select("path", "ord", F.explode("more").alias("base")).join(c.names("class_with_methods").withColumnRenamed("name", "base"), "base", "left_semi").select("path", "ord")
    bags = bags.join(based.distinct(), ["path", "ord"], "left_anti")
    reads = c("attr_load", F.col("name").alias("attr"), F.col("path").alias("reader"), "test").filter("not test")
    users = bags.select("path", "ord", F.explode("items").alias("attr")).join(reads, "attr").filter("reader <> path").groupBy("path", "ord", "reader").agg(F.count_distinct("attr").alias("n")).filter("n >= 3").groupBy("path", "ord").agg(F.count("*").alias("readers"))
    got = bags.join(users, ["path", "ord"], "left")
    tail = F.when(F.col("readers").isNotNull(), text("; functions in ", number("readers"), " other file(s) access 3+ of them")).otherwise(F.lit(""))
    return say(got, "anemic-domain", text(F.col("name"), " has ", number(F.size("items")), " attributes but no behavior", tail))


# -- callers


@check("unused-defaults", "high")
def unused_defaults(c: Code) -> DataFrame:
    optional = c("none_default", "file_ord", "ord", "path", "line", "name", F.col("x").alias("param"))
    index = c("first_def", "name", "file_ord", F.posexplode("items").alias("pos", "param")).groupBy("name", "param", "file_ord").agg(F.min("pos").alias("pos")).groupBy("name", "param").agg(F.min_by("pos", "file_ord").alias("pos"))
    calls = c("call", "name", "n", "more")
    passes = (F.col("n") > F.col("pos")) | F.array_contains("more", F.col("param")) | F.array_contains("more", "**")
    got = optional.join(index, ["name", "param"]).join(calls, "name").groupBy("file_ord", "ord", "path", "line", "name", "param").agg(F.bool_and(passes).alias("all"), F.count("*").alias("calls")).filter("all")
    return say(got, "unused-defaults", text(F.col("name"), "() param '", F.col("param"), "' defaults to None but all ", number("calls"), " caller(s) pass it"))


@check("dead-code", "high")
def dead_code(c: Code) -> DataFrame:
    got = c.without(c.unique, "call", "value_ref", "dotted", "decorator")
    got = c.unexported(c.elsewhere(got).filter(F.col("x").isNull()))
    return say(got, "dead-code", text(F.col("name"), "() has no callers (dead code?)"))


@check("single-call-site", "low")
def single_call(c: Code) -> DataFrame:
    calls = ops.only(c["call"].select("name", F.col("path").alias("user"), F.col("line").alias("at"), F.col("x").alias("one")), "name")
    got = c.elsewhere(c.unique.filter("m <= 4 and n <= 10")).join(calls, "name").filter(P.parent(F.col("path")) == P.parent(F.col("user")))
    params = F.size(F.array_except("items", F.array(F.lit("self"), F.lit("cls"))))
    said = text(F.col("name"), "() ", F.when(params > 0, text("has ", number(params), " params and ")).otherwise(""), "exactly 1 call site (", P.name(F.col("user")), ":", number("at"), ")", F.when(F.col("one").isNotNull(), text(", all args from '", F.col("one"), "'")).otherwise(""))
    return say(got, "single-call-site", said, severity=F.when((params >= 4) | F.col("one").isNotNull(), "medium").otherwise("low"))


@check("internal-only", "low")
def internal_only(c: Code) -> DataFrame:
    calls = c("call", "name", F.col("path").alias("user"))
    got = c.unexported(c.elsewhere(ops.kept_home(c.unique, calls, "name", "path", "user", 2)))
    return say(got, "internal-only", text(F.col("name"), "() is public but only called within same file (", number("uses"), " internal call(s))"))


@check("constant-args")
def constant_args(c: Code) -> DataFrame:
    params = c.unique.select("file_ord", "ord", "path", "line", "name", F.posexplode(F.array_except("items", F.array(F.lit("self"), F.lit("cls")))).alias("pos", "param"))
    calls = c("call", "name", "items", "more", "vals")
    at_kw = F.array_position("more", F.col("param"))
    value = F.when(F.col("pos") < F.size("items"), F.get("items", F.col("pos"))).when(at_kw > 0, F.get("vals", (at_kw - 1).cast("int")))
    rows = params.join(calls, "name").withColumn("value", value)
    got = ops.one_value(rows, ["file_ord", "ord", "path", "line", "name", "pos", "param"], "value", 2)
    return say(got, "constant-args", text(F.col("name"), "() param '", F.col("param"), "' always receives ", F.col("value"), " from all ", number("n"), " caller(s)"))


@check("return-none-instead-of-raise")
def none_returns(c: Code) -> DataFrame:
    calls = c["assigned_call"].groupBy("name").agg(F.count_if("flag").alias("guarded"), F.count("*").alias("total")).filter("guarded >= 2")
    got = c.unique.filter("y = 'mixed'").join(calls, "name")
    return say(got, "return-none-instead-of-raise", text(F.col("name"), "() returns None in some branches and ", number("guarded"), " of ", number("total"), " caller(s) guard against None"))


@check("pass-through-params")
def pass_through(c: Code) -> DataFrame:
    rows = c("forwarded", "path", F.col("ord").alias("use"), "name", "x", F.explode("items").alias("to")).join(c.unique.select("file_ord", "ord", "path", "line", "name"), ["path", "name"]).join(c.call_counts, "name", "left_semi")
    known = c.index.select(F.col("name").alias("to"), F.lit(True).alias("known")).distinct()
    got = rows.join(known, "to", "left").groupBy("file_ord", "ord", "path", "line", "name", "x").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("ok"), F.array_sort(F.collect_set("to")).alias("to")).filter("ok")
    return say(got, "pass-through-params", text(F.col("name"), "() receives '", F.col("x"), "' but only forwards it to ", F.array_join(F.transform("to", lambda t: F.concat(t, F.lit("()"))), ", ")))


@check("inconsistent-error-handling")
def error_handling(c: Code) -> DataFrame:
    calls = c("call_errors", "name", F.col("x").alias("caller"), F.col("y").alias("how"), "items", "test").filter("not test").drop("test")
    per = calls.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("how") == "specific").alias("specific"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("how") == "specific", F.col("items")))))).alias("errors")).filter("n >= 3 and specific > 0 and n > specific")
    defs = c.unique.join(per, "name").select("file_ord", "ord", "path", "line", "name", "errors")
    # Callers reached from an unhandled call through calls that don't handle errors either.
    lone = calls.filter("how = 'unhandled'")
    start = defs.select("name").join(lone, "name").filter("caller is not null").select(F.col("caller").alias("start")).distinct()
    with Scratch(c.facts.sparkSession) as s:
        reach = ops.closure(start, lone.filter("caller is not null").select(F.col("name").alias("from"), F.col("caller").alias("to")), s)
        caught = reach.join(calls.filter("how <> 'unhandled'").select(F.col("name").alias("end"), "how", "items"), "end").groupBy("start").agg(F.bool_or(F.col("how") == "broad").alias("broad"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("caught"))
        rows = defs.join(calls.select("name", "caller", "how"), "name").join(caught.withColumnRenamed("start", "caller"), "caller", "left")
        saved = F.coalesce(F.col("broad") | F.arrays_overlap("caught", "errors"), F.lit(False))
        rows = rows.withColumn("how", F.when((F.col("how") == "unhandled") & saved, "specific").otherwise(F.col("how")))
        got = rows.groupBy("file_ord", "ord", "path", "line", "name", "errors").agg(*(F.count_if(F.col("how") == h).alias(h) for h in ("specific", "broad", "unhandled"))).filter("broad + unhandled > 0")
        some = F.array_compact(F.array(text(number("specific"), " catch specific (", F.array_join("errors", ", "), ")"), F.when(F.col("broad") > 0, text(number("broad"), " catch broad Exception")), F.when(F.col("unhandled") > 0, text(number("unhandled"), " unhandled"))))
        return s.result(say(got, "inconsistent-error-handling", text(F.col("name"), "() has ", number(F.expr("specific + broad + unhandled")), " callers with inconsistent error handling: ", F.array_join(some, ", "))))


@check("vestigial-params")
def vestigial(c: Code) -> DataFrame:
    got = c["unused_param"].join(c.call_counts, "name", "left")
    tail = F.when(F.col("calls") > 0, text("; ", number("calls"), " caller(s) still pass it")).otherwise("")
    return say(got, "vestigial-params", text(F.col("x"), " is declared but never used in ", F.col("name"), "()", tail))


@check("dict-as-dataclass")
def dict_results(c: Code) -> DataFrame:
    defs = c["dict_return"]
    reads = c("key_read", F.col("name").alias("key"), F.col("path").alias("reader"))
    used = defs.select("path", "ord", F.explode("items").alias("key")).join(reads, "key").groupBy("path", "ord").agg(F.count_distinct("reader").alias("readers"))
    got = defs.join(used, ["path", "ord"], "left")
    shown = text(F.array_join(F.slice("items", 1, 6), ", "), F.when(F.size("items") > 6, ", ...").otherwise(""))
    tail = F.when(F.col("readers").isNotNull(), text(" accessed from ", number("readers"), " file(s)")).otherwise("")
    return say(got, "dict-as-dataclass", text(F.col("name"), "() returns a dict with ", number(F.size("items")), " string keys (", shown, ")", tail, "; a dataclass names them"))


# -- dead


@check("dead-exceptions", "high")
def dead_exceptions(c: Code) -> DataFrame:
    got = c.without(ops.only(c["exception"], "name"), "raised", "caught", "subclassed", "checked_type", "value_ref", "dotted")
    return say(c.unexported(c.elsewhere(got)), "dead-exceptions", text(F.col("name"), " (exception class) has no raise/except references"))


@check("dead-dispatch-entries")
def dead_dispatch(c: Code) -> DataFrame:
    keys = c("dispatch_key", "file_ord", "ord", "path", "line", F.col("name").alias("var"), F.col("x").alias("name"), "items")
    used = c("string", "name", F.col("path").alias("user"), F.col("line").cast("string").alias("at"))
    got = keys.join(used, (keys["name"] == used["name"]) & ~((used["user"] == keys["path"]) & F.array_contains("items", F.col("at"))), "left_anti")
    return say(got, "dead-dispatch-entries", text(F.col("var"), '["', F.col("name"), '"] key never appears as a string elsewhere'))


@check("orphaned-test-helpers")
def orphaned_helpers(c: Code) -> DataFrame:
    helpers = c["test_helper"]
    any_test = F.broadcast(c("has_test", F.lit(1).alias("one")).limit(1))
    fixtures = c.without(helpers.filter("flag"), "test_param").join(any_test, F.lit(True), "left_semi")
    plain = c.elsewhere(c.without(helpers.filter("not flag"), "call", "value_ref"))
    said = F.when(F.col("flag"), text(F.col("name"), " fixture in ", P.name(F.col("path")), " is never requested")).otherwise(text(F.col("name"), "() in ", P.name(F.col("path")), " has no callers"))
    return say(fixtures.select(*helpers.columns).unionByName(plain.select(*helpers.columns)), "orphaned-test-helpers", said)


@check("dead-abstraction")
def dead_abstraction(c: Code) -> DataFrame:
    got = c.elsewhere(c.unexported(c.without(c["abstract"], "subclassed", "value_ref")))
    many = F.when(F.col("n") > 0, text(" with ", number("n"), " abstract method(s)")).otherwise("")
    return say(got, "dead-abstraction", text(F.col("name"), " (ABC", many, ") has no concrete implementations"))


local("broken-backends")
local("compat-shims", "high")
for _name, _severity in (("suspicious-fallbacks", "high"), ("exception-flow-control", "medium"), ("unreachable-after-return", "high"), ("foo-equals-foo", "medium"), ("constant-dispatch-dicts", "medium")):
    local(_name, _severity)


# -- patterns


@check("trivial-wrappers", "low")
def trivial_wrappers(c: Code) -> DataFrame:
    got = c["trivial"].join(c.call_counts.filter("calls >= 3"), "name", "left_anti")
    return say(got, "trivial-wrappers", text(F.col("name"), "() just returns ", F.col("x")))


@check("dead-constants")
def dead_constants(c: Code) -> DataFrame:
    got = c.unexported(c.without(c["constant"], "name_load", "attr_load", "imported"))
    return say(got, "dead-constants", text(F.col("name"), " = ", F.col("x"), " is never referenced anywhere"))


for _name in ("temp-accumulators", "env-fallbacks", "runtime-monkey-patch"):
    local(_name)


@check("fossilized-toggles")
def fossilized(c: Code) -> DataFrame:
    defs = c("toggle", "file_ord", "ord", "path", "line", "name", F.col("x").alias("key"), F.col("y").alias("value"), "flag").withColumn("defs", F.count("*").over(W.partitionBy("name")))
    uses = c("condition", F.col("path").alias("user"), F.col("file_ord").alias("uo"), F.col("ord").alias("uord"), F.col("line").alias("at"), F.col("name"), F.col("x").alias("form"), F.col("y").alias("other"), F.get("items", F.lit(0)).alias("word"))
    near = uses.join(defs.select("name", F.col("path").alias("user"), F.lit(True).alias("near")), ["name", "user"], "left")
    both = near.join(defs, "name").filter(F.when(F.col("near"), F.col("user") == F.col("path")).otherwise(F.col("defs") == 1))
    true = F.when(F.col("form") == "true", F.col("flag")).when(F.col("form") == "false", ~F.col("flag")).when(F.col("form") == "eq", F.col("key") == F.col("other")).otherwise(F.col("key") != F.col("other"))
    got = both.withColumn("result", true).groupBy("file_ord", "ord", "path", "line", "name", "value").agg(F.count("*").alias("n"), F.min("result").alias("least"), F.max("result").alias("most"), F.min_by(F.struct("word", "at"), F.struct("uo", "uord")).alias("u"))
    yes = lambda x: F.when(x, "True").otherwise("False")
    one = text("`", F.col("u.word"), "` at line ", number("u.at"), " is always ", yes(F.col("most")), F.when(F.col("most"), "").otherwise(" (dead branch)"))
    many = text("controls ", number("n"), " conditionals (", F.when(F.col("least") == F.col("most"), text("always ", yes(F.col("most")))).otherwise("statically determinable"), ")")
    return say(got, "fossilized-toggles", text(F.col("name"), " = ", F.col("value"), " is never reassigned: ", F.when(F.col("n") == 1, one).otherwise(many)))


for _name, _severity in (("isinstance-chain", "medium"), ("boolean-param-explosion", "medium"), ("arrow-code", "low"), ("inconsistent-returns", "medium"), ("law-of-demeter", "low"), ("hungarian-notation", "low"), ("plaintext-passwords", "high")):
    local(_name, _severity)


@check("getattr-strings")
def getattr_strings(c: Code) -> DataFrame:
    rows = c["found"].filter("name = 'getattr-strings'")
    own = say(rows, "getattr-strings", F.col("x"))
    got = ops.places(c["named_attr"], ["name"]).filter("n >= 3 and containers >= 3")
    far = say(got, "getattr-strings", text("'", F.col("name"), "' used in getattr/hasattr across ", number("n"), " locations in ", number("containers"), " files (", at("shown"), ")"))
    return own.unionByName(far)


local("late-binding-closures", "high")


# -- whole catalogue


@check("stdlib-alternatives", "low")
def alternatives(c: Code) -> DataFrame:
    spark = c.facts.sparkSession
    catalog = spark.createDataFrame([(i, p["imports"], p.get("exclude", []), p.get("also"), p.get("complex", False), p["suggest"]) for i, p in enumerate(PATTERNS)], "pattern int, imports array<string>, exclude array<string>, also string, complex boolean, suggest string")
    seen = c("import", "file_ord", "ord", "path", "line", "name")
    # A module and each package above it: prefix matching as an equi join.
    parts = F.split("name", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    seen = seen.withColumn("prefixes", above)
    wanted = F.broadcast(catalog.select("pattern", F.explode("imports").alias("prefix"), "exclude"))
    hits = seen.select("file_ord", "ord", "path", "line", "prefixes", F.explode("prefixes").alias("prefix")).join(wanted, "prefix").filter(~F.arrays_overlap("prefixes", "exclude"))
    first = hits.groupBy("pattern", "path", "file_ord").agg(F.min_by("line", "ord").alias("line"))
    needed = F.broadcast(catalog.filter("also is not null").select("pattern", F.col("also").alias("prefix")))
    met = seen.select(F.explode("prefixes").alias("prefix")).join(needed, "prefix").select("pattern").distinct()
    arg = c["call"].filter("flag and name in ('add_subparsers', 'add_mutually_exclusive_group', 'add_argument')").groupBy("path").agg(F.count_if(F.col("name") == "add_argument").alias("n"), F.count_if(F.col("name") != "add_argument").alias("m")).filter("n >= 5 or m > 0")
    busy = first.join(arg, "path", "left_semi").select("pattern").distinct()
    got = first.groupBy("pattern").agg(F.count("*").alias("files"), F.slice(F.array_sort(F.collect_list(F.struct("file_ord", "path", "line"))), 1, 3).alias("shown"))
    got = got.join(F.broadcast(catalog), "pattern").join(met.withColumn("met", F.lit(True)), "pattern", "left").join(busy.withColumn("busy", F.lit(True)), "pattern", "left").filter("(also is null or met) and (not complex or busy)")
    got = got.withColumn("path", F.col("shown")[0]["path"]).withColumn("line", F.col("shown")[0]["line"])
    where = text(" (", at("shown"), F.when(F.col("files") > 3, ", ...").otherwise(""), "): consider ", F.col("suggest"))
    return say(got, "stdlib-alternatives", text(F.col("imports")[0], F.when(F.col("files") == 1, " imported").otherwise(text(" used in ", number("files"), " files")), where), ["pattern"])


# -- repetition


@check("scattered-constants", "low")
def scattered_constants(c: Code) -> DataFrame:
    got = ops.places(c["literal"], ["x", "y"], shown=10_000).filter("containers >= 3")
    value = F.when(F.length("y") > 40, F.concat(F.substring("y", 1, 37), F.lit("..."))).otherwise(F.col("y"))
    return say(got, "scattered-constants", text("Literal ", value, " appears in ", number("containers"), " files (", at("shown"), ")"), ["x", "y"])


@check("scattered-isinstance")
def scattered_isinstance(c: Code) -> DataFrame:
    defs = ops.only(c["class"].select("file_ord", "ord", "path", "line", "name"), "name")
    uses = ops.places(c["checked_class"], ["name"], shown=10_000).filter("containers >= 3").select("name", "containers", "shown")
    got = defs.join(uses, "name")
    return say(got, "scattered-isinstance", text("isinstance(x, ", F.col("name"), ") checks appear in ", number("containers"), " files (", at("shown"), ")"), ["name"])


@check("shotgun-surgery")
def shotgun(c: Code) -> DataFrame:
    own = c.names("project_attr").withColumnRenamed("name", "y")
    got = ops.places(c["access"].join(own, "y", "left_semi"), ["x", "y"]).filter("containers >= 4")
    more = F.when(F.col("containers") > 5, ", ...").otherwise("")
    return say(got, "shotgun-surgery", text(F.col("x"), ".", F.col("y"), " accessed in ", number("containers"), " files (", at("shown"), more, ")"), ["x", "y"])


@check("repeated-string-parsing")
def string_parsing(c: Code) -> DataFrame:
    rows = c("split", "file_ord", "ord", "path", "line", "x", F.col("n").alias("index"))
    same = ops.places(rows, ["x", "index"]).filter("n >= 3")
    more = F.when(F.col("n") > 5, ", ...").otherwise("")
    said = same.select("path", "line", F.lit(0).alias("way"), "x", "index", text('.split("', F.col("x"), '")[', number("index"), "] appears in ", number("n"), " locations (", at("shown"), more, ")").alias("said"))
    per = rows.join(same.select("x").distinct(), "x", "left_anti").groupBy("x").agg(F.array_sort(F.collect_set("index")).alias("all"), F.count_distinct("path").alias("files"), F.min("path").alias("path"), F.min_by("line", F.struct("file_ord", "ord")).alias("line")).filter(F.size("all") >= 3)
    told = per.select("path", "line", F.lit(1).alias("way"), "x", F.lit(0).alias("index"), text('.split("', F.col("x"), '") with ', number(F.size("all")), " different indices (", F.array_join(F.transform("all", lambda i: i.cast("string")), ", "), ") across ", number("files"), " file(s)").alias("said"))
    return say(said.unionByName(told), "repeated-string-parsing", F.col("said"), ["way", "x", "index"])


# -- structure


def _named(struct: str, total: str, most: int, ends: bool = False) -> Column:
    one = lambda s: F.concat(P.name(s["path"]), F.lit(":"), s["name"], F.lit("():"), s["line"].cast("string"), *([F.lit("-"), s["m"].cast("string")] if ends else []))
    return F.concat(F.array_join(F.transform(struct, one), ", "), F.when(F.col(total) > most, F.concat(F.lit(" (+"), (F.col(total) - most).cast("string"), F.lit(" more)"))).otherwise(""))


@check("duplicate-blocks")
def duplicate_blocks(c: Code) -> DataFrame:
    got = ops.twins(c("block", "file_ord", "ord", "path", "line", "name", "x", "n", "m"), ["path", "name"], 4).filter("places >= 2")
    best = F.row_number().over(W.partitionBy("among").orderBy(F.desc("size"), "first"))
    got = got.withColumn("since", F.min("first").over(W.partitionBy("among"))).withColumn("r", best).filter("r = 1")
    got = got.withColumn("path", F.col("shown")[0]["path"]).withColumn("line", F.col("shown")[0]["line"])
    return say(got, "duplicate-blocks", text(number("size"), " duplicate statements (lines ", number("line"), "-", number(F.col("shown")[0]["m"]), ") repeated in: ", _named("shown", "places", 4, True)), [F.desc("size"), "since"])


@check("duplicate-except-blocks")
def duplicate_handlers(c: Code) -> DataFrame:
    rows = c("handler", "file_ord", "ord", "path", "line", "name", "x", "y", "n", "m")
    got = ops.twins(rows, ["path", "name"], 4, ["path", "name", "line"]).filter("files >= 2")
    got = got.withColumn("r", F.row_number().over(W.partitionBy("among").orderBy("first"))).filter("r = 1")
    got = got.withColumn("path", F.col("shown")[0]["path"]).withColumn("line", F.col("shown")[0]["line"])
    return say(got, "duplicate-except-blocks", text("except ", F.col("shown")[0]["y"], ": ", number(F.col("shown")[0]["n"]), " duplicate handler statements with the same strings in: ", _named("shown", "places", 4)), ["first"])


@check("param-clumps")
def param_clumps(c: Code) -> DataFrame:
    got = ops.clumps_within(c("signature", "file_ord", "ord", "path", "line", "name", "items"), "items", ["path", "name"], 3, 3, 6)
    got = got.withColumn("path", F.col("shown")[0]["path"]).withColumn("line", F.col("shown")[0]["line"])
    return say(got, "param-clumps", text("Parameters (", F.array_join("set", ", "), ") appear together in ", number("places"), " functions: ", _named("shown", "places", 6)), [~F.col("whole"), "first", "set"])


local("middle-man")


@check("shadowed-method")
def shadowed(c: Code) -> DataFrame:
    defs = c["class_def"]
    methods = defs.select(F.col("name").alias("base"), F.explode("items").alias("method")).distinct()
    rows = defs.filter(F.size("more") >= 2).select("file_ord", "ord", "path", "line", "name", "items", F.posexplode("more").alias("pos", "base")).join(methods, "base")
    rows = rows.filter(~F.array_contains("items", F.col("method")) & ~(F.col("method").startswith("__") & F.col("method").endswith("__")))
    got = rows.groupBy("file_ord", "ord", "path", "line", "name", "method").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("all"))
    got = got.withColumn("base", F.col("all")[0]["base"]).withColumn("others", F.filter(F.transform("all", lambda s: s["base"]), lambda b: b != F.col("base"))).filter(F.size("others") > 0)
    got = got.join(c("super_call", F.col("name").alias("base"), F.col("x").alias("method")).distinct(), ["base", "method"], "left_anti")
    return say(got, "shadowed-method", text(F.col("name"), " inherits ", F.col("method"), "() from both ", F.col("base"), " and ", F.array_join("others", ", "), "; only the first is ever used"))


for _name in ("large-class", "long-function", "long-elif-chain"):
    local(_name, "low")


def run(c: Code, only: list[str] | None = None) -> DataFrame:
    """All findings of the checks, or of some."""
    out = None
    for name, (f, _) in CHECKS.items():
        if only is None or name in only:
            got = f(c)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else c.facts.sparkSession.createDataFrame([], FINDING)


def check_list(spark: SparkSession) -> DataFrame:
    """(check, severity) of every registered check."""
    from .history import CHECKS as HISTORY

    return spark.createDataFrame([(n, s, "code") for n, (_, s) in CHECKS.items()] + [(n, s, "history") for n, (_, s) in HISTORY.items()], "check string, severity string, category string")
