"""URL filters with rules indexed by their rarest literal token.

A rule is a regular expression. From its parse tree come the tokens (runs of
letters and digits in lower case) that every matching URL must contain whole;
of these the one found in the fewest URLs becomes its key. A URL's own tokens
fetch the rules with those keys, and only they are run. Rules without such a
token are run on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from re import _constants as C
from re import _parser as P

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, picked, table

#: (rule id, action, pattern); the syntax common to Java and RE2.
RULES: list[tuple[int, str, str]] = [
    (1, "block", r"://([a-z0-9-]+\.)*spam-farm\.example\.org/"),
    (2, "block", r"://(www\.)?cheap-pills\.example\.com/"),
    (3, "block", r"\.casino-[a-z]+\.example\."),
    (4, "strip", r"[?&]utm_source=feed(&|#|$)"),
    (5, "strip", r"[?&]ref=x(&|#|$)"),
    (6, "strip", r"#top$"),
    (7, "review", r"/en/[0-9]+\.html$"),
    (8, "review", r"/(fr|de)/[0-9]+/?$"),
    (9, "review", r"://m\.[a-z]+\.example\.net/es/"),
    (10, "review", r"[?&]page=[0-9]+"),
    (11, "review", r"^http://blog\.[a-z]+\.example\.com/"),
    (12, "review", r"/[0-9]{3}[/.?#]"),
    (13, "block", r"(?i)://adult-[a-z]+\."),
    (14, "allow", r"^https://www\.[a-z.]+/en/"),
]


def _parts(tree: Iterable) -> list[str | None]:
    """The pattern as characters that must follow each other, None where anything may be, '' at an edge of the URL or of a word."""
    out: list[str | None] = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append(chr(arg).lower())
        elif op is C.AT:
            out.append("" if arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING, C.AT_BOUNDARY) else None)
        elif op is C.SUBPATTERN:
            out += _parts(arg[3])
        elif op is C.MAX_REPEAT and arg[0] == arg[1] == 1:
            out += _parts(arg[2])
        elif op is C.IN and all(o is C.LITERAL and not chr(a).isalnum() for o, a in arg):
            out.append("\0")  # one separator or another
        elif op is C.BRANCH and all(_starts_apart(x) for x in arg[1]):
            out += ["\0", None]
        else:
            out.append(None)
    return out


def _starts_apart(tree: Iterable) -> bool:
    first = _parts(tree)[:1]
    return bool(first) and (first[0] == "" or first[0] is not None and not first[0].isalnum())


def literal_tokens(pattern: str) -> list[str]:
    """The tokens that every match lies around, whole; only ASCII ones, as URLs have them."""
    parts = _parts(P.parse(pattern))
    found, run, open_left = set(), "", True
    for p in [*parts, None]:
        if p is not None and len(p) == 1 and p.isascii() and p.isalnum():
            run += p
            continue
        if run and p is not None and open_left is False:
            found.add(run)
        run, open_left = "", p is None
    return sorted(found)


def _hint(rules: list[tuple[int, str, str]], need: list[tuple[int, str]]) -> Callable[[DataFrame], DataFrame]:
    """Broadcast where the rules and their tokens, which the driver holds, are of at most BROADCAST_BYTES."""
    total = sum(len(p) + len(a) + 16 for _, a, p in rules) + sum(len(t) + 16 for _, t in need)
    return F.broadcast if total <= BROADCAST_BYTES else (lambda x: x)


def tokens(url: str = "url") -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def filter_urls(pages: DataFrame, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """Rows (page_id, rule_id, action): every rule that matches somewhere in a page's URL.

    A null URL matches nothing; an empty one only what matches the empty text.
    Repeated rows give repeated results; other columns are ignored; no rules or
    no pages give an empty result. Token frequencies count over all pages; ties
    go to the alphabetically first token.
    """
    spark = pages.sparkSession
    rows = picked(pages, page_id="long", url="string").filter("url is not null")
    schema = "rule_id int, action string, pattern string"
    all_rules = spark.createDataFrame(rules, schema)
    need = [(r, t) for r, _, p in rules for t in literal_tokens(p)]
    wanted = spark.createDataFrame(need, "rule_id int, token string")
    used = rows.select(F.explode(tokens()).alias("token"))
    names = wanted.select("token").distinct()
    hint = _hint(rules, need)
    seen = used.join(hint(names), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    keys = wanted.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    indexed = hint(keys.join(all_rules, "rule_id"))
    candidates = rows.select("page_id", "url", F.explode(tokens()).alias("token")).join(indexed, "token").select("page_id", "url", "rule_id", "action", "pattern")
    loose = [x for x in rules if x[0] not in {r for r, _ in need}]
    if loose:
        # Every URL runs these, so they go to it as one array: a column of each row, and no join.
        each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(a).alias("action"), F.lit(p).alias("pattern")) for r, a, p in loose)))
        candidates = candidates.unionByName(rows.select("page_id", "url", each.alias("r")).select("page_id", "url", "r.*"))
    return candidates.filter(F.expr("regexp_like(url, pattern)")).select("page_id", "rule_id", "action")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9_url_filter}
SQL = {"op9_url_filter": "select page_id, rule_id::int as rule_id, action from pages join (values " + ", ".join(f"({r}, '{a}', '{p}')" for r, a, p in RULES) + ") r(rule_id, action, pattern) on regexp_matches(url, pattern)"}
for _, _, _p in RULES:
    re.compile(_p)
