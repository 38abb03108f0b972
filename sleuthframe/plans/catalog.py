"""The registered queries over the test tables, each with its SQL.

Three groups: every check over a code base or a history made of the suppliers;
the operators that checks are composed of, over commits made of orders and
events; what happens to findings afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import Scratch
from ..functions import messages, paths
from ..operators import code as more
from ..operators import core, ranking
from . import code, history, history_samples, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["co_change_pairs"](spark, sf_dir)


# -- checks


def _code(check: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        base = code.Code(s.table(code.extract(samples.code_base(table(spark, sf_dir, "supplier"), check).withColumn("file_ord", F.lit(0)), code.KINDS.get(check))))
        return s.result(code.run(base, [check]).select("file", "line", "check", "severity"))


def _code_in_order(check: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        base = code.Code.read(samples.code_base(table(spark, sf_dir, "supplier"), check), f"{s.at}/facts", code.KINDS.get(check))
        return s.result(code.run(base, [check]).select("file", "line", "check", "severity"))


def _history(check: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.run(history_samples.history(table(spark, sf_dir, "supplier"), check), [check]).select("file", "line", "check", "severity")


#: Checks whose result depends on the order of files; the others need none.
ORDERED = {"stdlib-alternatives", "duplicate-blocks", "duplicate-except-blocks", "param-clumps", "scattered-constants", "scattered-isinstance", "shotgun-surgery", "repeated-string-parsing", "shared-mutable-module-state", "getattr-strings", "unused-defaults", "fossilized-toggles"}
for _name in code.CHECKS:
    _key = "check_" + _name.replace("-", "_")
    QUERIES[_key] = partial(_code_in_order if _name in ORDERED else _code, _name)
    SQL[_key] = samples.expected_sql(_name)
for _name in history.CHECKS:
    _key = "check_" + _name.replace("-", "_")
    QUERIES[_key] = partial(_history, _name)
    SQL[_key] = history_samples.expected_sql(_name)

# -- operators

TOUCHED = "select distinct l_orderkey as hash, 'pkg' || s_nationkey || '/mod' || l_suppkey || '.py' as path from lineitem join supplier on l_suppkey = s_suppkey"
COMMITS = "select o_orderkey as hash, o_orderdate as ts, o_custkey % 7 as author, o_orderpriority in ('1-URGENT', '2-HIGH') as fix from orders"
DAYS = "select user_id as path, event_id, event_type, floor(epoch_us(ts) / 86400000000)::bigint as slot from events"


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, path): orders as commits, their suppliers as files."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    path = F.concat(F.lit("pkg"), F.col("s_nationkey").cast("string"), F.lit("/mod"), F.col("l_suppkey").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), "l_suppkey").join(suppliers, "l_suppkey").select("hash", path.alias("path")).distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 7).alias("author"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("fix"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, event_id, event_type, slot): users as files, days as slots."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "event_id", "event_type", slot.alias("slot"))


@query(
    f"""with t as ({TOUCHED}), c as (select path, count(*) as n from t group by path),
p as (select a.path as a, b.path as b, count(*) as together from t a join t b on a.hash = b.hash and a.path < b.path group by 1, 2)
select a, b, together, least(x.n, y.n) as least, together::double / least(x.n, y.n) as ratio from p join c x on x.path = a join c y on y.path = b where together::double / least(x.n, y.n) >= 0.02"""
)
def co_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.together(touched(spark, sf_dir), "hash", "path", 1, 0.02)


@query(
    f"""with t as ({TOUCHED}), s as (select hash from t group by hash having count(*) < 4), k as (select * from t where hash in (select hash from s)), c as (select path, count(*) as n from k group by path),
p as (select a.path as a, b.path as b, count(*) as together from k a join k b on a.hash = b.hash and a.path < b.path group by 1, 2)
select a, b, together, least(x.n, y.n) as least, together::double / least(x.n, y.n) as ratio from p join c x on x.path = a join c y on y.path = b where together >= 2"""
)
def co_change_small_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.together(touched(spark, sf_dir), "hash", "path", 2, 0.0, 4)


@query(f"with r as (select path, fix from ({TOUCHED}) join ({COMMITS}) using (hash)) select path, count(*) as n, count(*) filter (where fix) as hits, (count(*) filter (where fix))::double / count(*) as share from r group by path having count(*) >= 5 and (count(*) filter (where fix))::double / count(*) >= 0.4")
def fix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.share(touched(spark, sf_dir).join(commits(spark, sf_dir), "hash"), "path", F.col("fix"), 5, 0.4)


@query(f"with r as (select path, author, count(*) as hits, min(hash) as o from ({TOUCHED}) join ({COMMITS}) using (hash) group by 1, 2), t as (select *, sum(hits) over (partition by path)::bigint as n, row_number() over (partition by path order by hits desc, o) as r from r) select path, author::bigint as author, hits, n, hits::double / n as share from t where r = 1 and hits::double / n >= 0.16 and n >= 5")
def top_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = core.dominance(touched(spark, sf_dir).join(commits(spark, sf_dir), "hash"), "path", "author", "hash", 5, 0.16)
    return got.withColumn("author", F.col("author").cast("long"))


@query(f"with d as (select distinct path, slot from ({DAYS})), i as (select path, slot - row_number() over (partition by path order by slot) as isle from d), r as (select path, isle, count(*) as n from i group by 1, 2) select path, count(*) as bursts from r where n >= 2 group by path having count(*) >= 3")
def activity_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.bursts(days(spark, sf_dir), "path", "slot", 2, 3)


@query(f"with p as (select path, slot, max((event_type = 'signup')::int) as c, max((event_type = 'error')::int) as e from ({DAYS}) group by 1, 2), n as (select *, max(e) over (partition by path order by slot range between 1 following and 2 following) as next from p) select path, count(*) as pairs from n where c = 1 and next = 1 group by path having count(*) >= 3")
def error_after_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = days(spark, sf_dir).withColumn("c", F.col("event_type") == "signup").withColumn("e", F.col("event_type") == "error")
    return core.follows(rows, "path", "slot", "c", "e", 2, 3)


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select line, count(distinct doc_id) as containers from l where length(line) > 2 group by line having count(distinct doc_id) >= 3")
def scattered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 2)
    return core.scattered(lines, ["line"], "doc_id", 3)


@query("select sha256(text) as digest, list_sort(list(distinct doc_id)) as keys from documents where text is not null group by text having count(distinct doc_id) >= 2")
def same_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.same_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("select l_orderkey, min(l_returnflag) as l_returnflag, count(*) as n from lineitem group by l_orderkey having count(*) >= 2 and count(distinct l_returnflag) = 1")
def constant_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.constant(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", 2)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return core.unreferenced(table(spark, sf_dir, "customer").select("c_custkey"), (urgent, ["c_custkey"]))


@query("select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' group by l_partkey having count(*) = 1)")
def parts_returned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    return core.referenced_once(table(spark, sf_dir, "part").select("p_partkey"), uses, ["p_partkey"])


@query("with u as (select l_partkey, count(*) as uses, bool_and(l_linenumber <= 4) as near from lineitem where l_returnflag = 'R' group by 1) select p_partkey, 1::int as home, uses from part join u on l_partkey = p_partkey where uses >= 2 and near")
def used_at_home_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") <= 4).cast("int").alias("user"))
    return more.kept_home(table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("home")), uses, "p_partkey", "home", "user", 2)


@query(f"with t as ({TOUCHED}), s as (select path, hash, count(*) over (partition by hash) - 1 as others from t) select path as item, count(*) as groups, median(others)::double as median_others from s where others < 20 group by path having count(*) >= 5 and median(others) >= 3")
def median_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.co_size(touched(spark, sf_dir), "hash", "path", 5, 20, 3)


@query("with b as (select l_orderkey, list_sort(list(distinct p_brand)) as items from lineitem join part on l_partkey = p_partkey group by 1) select items, count(*) as groups from b where len(items) >= 3 group by items having count(*) >= 3")
def brand_clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return core.clumps(rows, "l_orderkey", "p_brand", 3, 3)


@query("with a as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT'), m as (select c_nationkey, c_custkey, count(*) over (partition by c_nationkey) as peers, count(o_custkey) over (partition by c_nationkey) as active, o_custkey from customer left join a on c_custkey = o_custkey) select c_nationkey, c_custkey, peers, active from m where o_custkey is null and peers >= 3 and active > 0 and active >= peers * 0.5")
def idle_among_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order in nations where most have one."""
    active = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return core.inactive_peers(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", active, 3, 0.5)


@query(
    f"""with b as (select min(slot) as lo, 1 + max(slot) - min(slot) as n from ({DAYS})), p as (select path, slot - (select lo from b) as slot, count(*) as n from ({DAYS}) group by 1, 2),
r as (select unnest(range((select n from b))) as s), k as (select distinct path from p),
g as (select k.path, r.s as slot, coalesce(p.n, 0) as n from k cross join r left join p on p.path = k.path and p.slot = r.s)
select path, median(n) filter (where slot < (select n from b) // 2)::double as first, median(n) filter (where slot >= (select n from b) // 2)::double as second, sum(n) filter (where slot >= (select n from b) // 2)::bigint as total from g group by path"""
)
def half_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all days between the first and the last event."""
    rows = days(spark, sf_dir)
    low, high = rows.agg(F.min("slot"), F.max("slot")).first()
    return core.halves(rows.withColumn("slot", F.col("slot") - F.lit(low or 0)), "path", "slot", 1 + (high or 0) - (low or 0))


@query("select page_id, prefix from pages join (values ('http://blog.'), ('https://www.'), ('http://m.'), ('https://')) p(prefix) on starts_with(url, prefix)")
def url_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.createDataFrame([("http://blog.",), ("https://www.",), ("http://m.",), ("https://",)], "prefix string")
    return core.prefixed(table(spark, sf_dir, "pages").filter("url is not null"), "url", prefixes, "prefix").select("page_id", "prefix")


@query("select n_nationkey::bigint as start, unnest([n_nationkey]) as \"end\" from nation where false union select a.n_nationkey::bigint, b.n_nationkey::bigint from nation a join nation b on a.n_nationkey % 5 = b.n_nationkey % 5 and b.n_nationkey >= a.n_nationkey")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations reached from each by steps of five."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = n.join(n.select(F.col("k").alias("to")), F.col("to") == F.col("k") + 5).select(F.col("k").alias("from"), "to")
    with Scratch(spark) as s:
        return s.result(more.closure(n.select(F.col("k").alias("start")), edges, s))


@query("select p_partkey, p_name from part where p_name in (select p_name from part group by p_name having count(*) = 1)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return more.only(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")


@query("select l_orderkey, min(l_returnflag) as flag, count(*) as n from lineitem group by l_orderkey having count(*) >= 3 and count(distinct l_returnflag) = 1")
def always_same_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return more.one_value(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag")), ["l_orderkey"], "flag", 3)


# -- labels, paths, words

SUBJECTS = "select o_orderkey as hash, case o_orderkey % 6 when 0 then 'fix: order ' || o_custkey when 1 then 'feat(c' || o_custkey % 3 || '): add total' when 2 then 'refactor the ' || lower(o_orderstatus) || ' path' when 3 then 'hotfix for ' || o_orderkey when 4 then 'wip' else 'temporary workaround ' || o_orderkey end as subject from orders"


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    s = F.when(k % 6 == 0, messages.text("fix: order ", c.cast("string"))).when(k % 6 == 1, messages.text("feat(c", (c % 3).cast("string"), "): add total")).when(k % 6 == 2, messages.text("refactor the ", F.lower("o_orderstatus"), " path")).when(k % 6 == 3, messages.text("hotfix for ", k.cast("string"))).when(k % 6 == 4, F.lit("wip")).otherwise(messages.text("temporary workaround ", k.cast("string")))
    return table(spark, sf_dir, "orders").select(k.alias("hash"), s.alias("subject"))


@query(f"with s as ({SUBJECTS}), l as (select hash, subject, unnest(case hash % 6 when 0 then ['fix'] when 1 then ['feature'] when 2 then ['refactor'] when 3 then ['fix', 'emergency'] when 4 then []::varchar[] else ['debt'] end) as label from s) select label, count(*) as n from l group by label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(spark, sf_dir).select(F.explode(messages.labels(F.col("subject"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"select case when subject like 'feat(%' then substr(subject, 6, 2) end as scope, count(*) as n, count(*) filter (where length(subject) > 10)::bigint as good from ({SUBJECTS}) group by 1")
def subject_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("subject")
    return subjects(spark, sf_dir).groupBy(messages.scope(s).alias("scope")).agg(F.count("*").alias("n"), F.count_if(messages.is_good(s)).alias("good"))


@query("select p_partkey, 'd' || p_size as parent, 'test_p' || p_partkey || '.py' as name, 'd' || p_size || '.test_p' || p_partkey as module, true as is_test, p_size % 2 = 0 as is_match from part")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("d"), F.col("p_size").cast("string"), F.lit("/test_p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    even = paths.glob_regex("d*[02468]/test_p*.p?")
    return table(spark, sf_dir, "part").select("p_partkey", paths.parent(p).alias("parent"), paths.name(p).alias("name"), paths.module(p).alias("module"), paths.is_test(p).alias("is_test"), p.rlike(even).alias("is_match"))


# -- after the checks

FOUND = "select 'f' || l_suppkey as file, l_linenumber as line, 'check-' || l_linenumber as \"check\", case when l_returnflag = 'R' then 'high' when l_returnflag = 'A' then 'medium' else 'low' end as severity, l_orderkey * 10 + l_linenumber as seq, l_linenumber as check_ord from lineitem"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as findings."""
    n = F.col("l_linenumber")
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"), n.alias("line"), F.concat(F.lit("check-"), n.cast("string")).alias("check"), severity.alias("severity"), (F.col("l_orderkey") * 10 + n).alias("seq"), n.alias("check_ord"))


@query(f"with f as (select *, count(*) over (partition by \"check\") as hits from ({FOUND})) select file, line, \"check\", severity, seq, hits from f order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, hits, check_ord, seq limit 10")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten that a report shows."""
    return ranking.ranked(found(spark, sf_dir)).select("file", "line", "check", "severity", "seq", "hits")


@query(f"select \"check\", severity, count(*) as findings from ({FOUND}) group by 1, 2")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.summary(found(spark, sf_dir))


@query(f"select file, count(distinct \"check\")::int as checks, list_sort(list(distinct \"check\")) as names from ({FOUND}) group by file having count(distinct \"check\") >= 3")
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hotspots(found(spark, sf_dir))


@query(f"select file, line, \"check\", severity, seq from ({FOUND}) where severity <> 'low' and (file, line) in (select 'f' || ps, 1 + ps % 3 from (select s_suppkey as ps from supplier))")
def changed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of some severity on changed lines: one line of each supplier's file."""
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), (1 + k % 3).cast("int").alias("line"))
    return ranking.in_diff(ranking.at_least(found(spark, sf_dir), "medium"), lines).select("file", "line", "check", "severity", "seq")


@query(f"with f as ({FOUND}) select file, line, \"check\", severity, seq from f where not (line in (2, 3) and \"check\" = 'check-2') and line not in (4, 5)")
def unsuppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's file has a marker for one check in line 2, for all in line 4, and one without its end in line 6."""
    m = ranking.MARKER
    src = f"a = 1\nb = 2  # {m}[check-2, other]\nc = 3\nd = 4  # {m}\ne = 5\nf = 6  # {m}[check-6"
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.lit(src).alias("src"))
    return ranking.unsuppressed(found(spark, sf_dir), files).select("file", "line", "check", "severity", "seq")


@query("with f as (select 'd' || s_nationkey || '/m' || s_suppkey || '.py' as file, 'd' || s_nationkey as dir, count(*) over (partition by s_nationkey) as n from supplier) select distinct case when n >= 3 then dir else file end as file, case when n >= 3 then n else 1 end as members from f")
def by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), g, F.lit("/m"), k, F.lit(".py")).alias("file"), F.lit(1).alias("line"), F.lit("c").alias("check"), F.lit("m").alias("message"), F.lit("low").alias("severity"), F.lit(0).alias("check_ord"), F.col("s_suppkey").alias("seq"))
    n = F.regexp_extract("message", r" ([0-9]+) files in this package", 1)
    return ranking.collapsed(rows).select("file", F.when(n != "", n.try_cast("long")).otherwise(F.lit(1).cast("long")).alias("members"))
