"""Command line: ``python -m sleuthframe analyze [TARGETS]``, ``git-history [TARGET]`` and ``git-history reviewed PATH...``."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, config
from .cluster import ship
from .operators import ranking
from .plans import code, history
from .plans.about import ABOUT
from .sources import repository as repo


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sleuthframe")
    p.add_argument("--version", action="version", version=f"sleuthframe {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "git-history"):
        s = sub.add_parser(name)
        s.add_argument("targets", nargs="*", default=["."])
        s.add_argument("--check")
        s.add_argument("--skip", action="append", default=[])
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("--min-severity", choices=config.CHOICES["min-severity"], default="low")
        s.add_argument("--summary", action="store_true")
        s.add_argument("--list-checks", action="store_true")
        s.add_argument("--more-please", "--all", dest="all", action="store_true")
        s.add_argument("--verbose", action="store_true")
        s.add_argument("--no-context", action="store_true", help="leave out the notes on how to read the findings")
        if name == "analyze":
            s.add_argument("--diff")
        else:
            s.add_argument("--window", default="6m")
            s.add_argument("--commit-messages", choices=config.CHOICES["commit-messages"], default="auto")
            s.add_argument("--ignore-reviewed", action="store_true")
    return p


def choose(names: list[str], check: str | None, skip: list[str]) -> list[str]:
    """One check, else all but the skipped; unknown names to skip don't matter."""
    return [n for n in names if n == check] if check else [n for n in names if n not in skip]


def merged(a: argparse.Namespace, settings: dict[str, Any]) -> argparse.Namespace:
    """Lists add up; a setting counts where the option has its default."""
    a.exclude, a.skip = [*settings.get("exclude", []), *a.exclude], [*settings.get("skip", []), *a.skip]
    if a.min_severity == "low":
        a.min_severity = settings.get("min-severity", "low")
    if a.command == "analyze":
        a.check = a.check or settings.get("check")
    else:
        a.window = settings.get("git-window", "6m") if a.window == "6m" else a.window
        a.commit_messages = settings.get("commit-messages", "auto") if a.commit_messages == "auto" else a.commit_messages
        a.expected = settings.get("expected-coupling", [])
    return a


#: Shown above the findings, unless --no-context is given.
NOTES = {
    "analyze": "Messages name what other files hold: callers, readers, places. Follow those before changing a signature, and look for names used as text before deleting one.",
    "git-history": "History shows where to look, not what is wrong. Once a file has been looked at, `git-history reviewed PATH` starts its count anew.",
}


def report(found: DataFrame, files: int, summary: bool, top: int, note: str = "") -> tuple[str, int]:
    """The text of a report and its number of findings; hotspots are those of the findings shown."""
    found = found.cache()
    total = found.count()
    shown = ranking.ranked(found, top) if top and total > top else found.orderBy("check_ord", "seq")
    rows = shown.collect()
    lines = [f"Parsed {files} Python files", "", *([note, ""] if note and total else [])]
    by: dict[str, set[str]] = {}
    for r in rows:
        by.setdefault(r.file, set()).add(r.check)
    hot = sorted(((f, c) for f, c in by.items() if len(c) >= 3), key=lambda pair: len(pair[1]), reverse=True)
    if hot:
        lines += ["=== convergence hotspots ===", *(f"  {f}: flagged by {len(c)} checks ({', '.join(sorted(c))})" for f, c in hot), ""]
    if summary:
        lines += [*(f"  {r.check:<30} [{r.severity:<6}]  {r.findings}" for r in ranking.summary(found).collect()), ""]
    else:
        groups: dict[str, list] = {}
        for r in rows:
            groups.setdefault(r.check, []).append(r)
        for name, some in groups.items():
            lines += [f"=== {name} ({len(some)} finding(s)) ===", *(f"  {r.file}:{r.line}: {r.message}" for r in some), ""]
    lines.append(f"Total: {total} finding(s)" if total else "All checks passed.")
    if top and total > top:
        lines.append(f"The top {top} are shown; --all shows all {total}.")
    found.unpersist()
    return "\n".join(lines), total


def _fail(why: str) -> int:
    print("Error:", why, file=sys.stderr)
    return 1


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    every = [*code.CHECKS, *history.CHECKS]
    mine = code.CHECKS if a.command == "analyze" else history.CHECKS
    if a.list_checks:
        tag = "code" if a.command == "analyze" else "history"
        print("\n".join(f"{n:<30} [{s:<6}] [{tag}] {ABOUT[n]}" for n, (_, s) in mine.items()))
        return 0
    if a.command == "git-history" and a.targets[0] == "reviewed":
        return reviewed(a.targets[1:])
    roots = [Path(t) for t in a.targets]
    if odd := [r for r in roots if not r.exists()]:
        return _fail(f"{odd[0]} doesn't exist")
    try:
        settings = config.load(roots[0], every)
        if not settings and (up := config.above(roots[0])):
            print(f"Warning: settings in {up} aren't used for {roots[0]}", file=sys.stderr)
    except config.ConfigError as problem:
        return _fail(str(problem))
    a = merged(a, settings)
    if a.check and a.check not in mine:
        return _fail(f"unknown check '{a.check}'")
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    src = repo.files(spark, roots, a.exclude).cache()
    base = code.Code.read(src)
    only = choose(list(mine), a.check, a.skip)
    if a.command == "analyze":
        found = code.run(base, only)
    else:
        try:
            log = repo.log(spark, roots[0], history.window_days(a.window))
        except repo.NotARepository as problem:
            return _fail(str(problem))
        imports = base("import_link", "path", F.col("name").alias("module"), F.col("n").alias("level"), F.col("flag").alias("from_import"))
        log["marks"] = log["reviews"]
        if a.ignore_reviewed:
            log["reviews"] = log["reviews"].limit(0)
        found = history.run(history.History(base.files, **log, imports=imports, window=a.window, messages=a.commit_messages, expected=a.expected), only)
    found = ranking.at_least(found, a.min_severity)
    if getattr(a, "diff", None) and (lines := repo.changed(spark, roots[0], a.diff)) is not None:
        found = ranking.in_diff(found, lines)
    found = ranking.unsuppressed(found, src)
    text, n = report(found, base.files.count(), a.summary, 0 if a.all else 10, "" if a.no_context else NOTES[a.command])
    print(text)
    return int(n > 0)


def reviewed(targets: list[str]) -> int:
    """An empty commit whose body marks the files, those under folders too, as reviewed."""
    if not targets:
        return _fail("reviewed needs a file or folder")
    paths: list[str] = []
    for t in targets:
        if not Path(t).exists():
            return _fail(f"{t} doesn't exist")
        own = sorted(map(str, Path(t).rglob("*.py"))) if Path(t).is_dir() else [t]
        if not own:
            print(f"Warning: no Python file in {t}", file=sys.stderr)
        paths += own
    if not paths:
        return _fail("no file to mark")
    try:
        repo.commit_reviewed(Path.cwd(), paths)
    except repo.NotARepository as problem:
        return _fail(str(problem))
    print(f"Marked {len(paths)} file(s) as reviewed")
    return 0


def reviewed_now(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Marks for files, to append to a table of reviews."""
    return repo.mark_reviewed(spark.createDataFrame([], "path string, ts timestamp"), paths, datetime.now(UTC))


if __name__ == "__main__":
    sys.exit(main())
