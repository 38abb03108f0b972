"""Source files, commits and changed lines of a git repository as frames.

Listings and logs come from git on the driver, as it has the repository; file
contents are read by the executors where the folder is shared, and by the
driver otherwise.
"""

from __future__ import annotations

import os
import re
import subprocess
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = {".git", ".mypy_cache", ".tox", ".venv", "__pycache__", "node_modules", "venv"}
REVIEW = "sleuthframe: reviewed"
FILES = "file_ord long, path string, src string"
COMMITS = "hash string, seq long, ts timestamp, ts_raw string, author string, subject string"
_SEP = "\x1f"


class NotARepository(Exception):
    """The folder is in no git repository, or git is missing."""


def _git(root: Path, *args: str) -> str | None:
    try:
        got = subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return got.stdout.decode(errors="replace")


def top(root: Path) -> Path:
    said = _git(root, "rev-parse", "--show-toplevel")
    if said is None:
        raise NotARepository(f"{root} isn't in a git repository")
    return Path(said.strip())


def listing(root: Path) -> list[Path]:
    """Python files in order: those git knows of or would add; all but tool folders where there is no git."""
    said = _git(root, *"ls-files -z --cached --exclude-standard --others *.py".split())
    if said is not None:
        found = [root / x for x in said.split("\0") if x]
        return sorted(p for p in set(found) if p.is_file())
    return sorted(p for p in root.rglob("*.py") if not SKIPPED & set(p.relative_to(root).parts))


def excluded(path: str, patterns: list[str]) -> bool:
    """A pattern without a slash is for names, with one for whole paths, and with one at its end for folders."""
    from fnmatch import fnmatch

    parts = path.split("/")
    for p in patterns:
        if p.endswith("/"):
            if any(fnmatch("/".join(parts[:i]), p.rstrip("/")) for i in range(1, len(parts))):
                return True
        elif fnmatch(path if "/" in p else parts[-1], p):
            return True
    return False


def files(spark: SparkSession, roots: list[Path], exclude: list[str] | None = None) -> DataFrame:
    """FILES under the roots, with paths relative to the one root or to what all have in common; of equal paths the last root's counts."""
    base = roots[0] if not roots[1:] else Path(os.path.commonpath([str(r.resolve()) for r in roots]))
    found: dict[str, Path] = {}
    for r in roots:
        r = r.resolve()
        for p in [r] if r.is_file() else listing(r):
            rel = os.path.relpath(p, base.resolve() if base.is_dir() else base.resolve().parent)
            if not excluded(rel, exclude or []):
                found[rel] = p
    order = sorted(found, key=lambda x: x.split("/"))
    return spark.createDataFrame([(i, p, found[p].read_text("utf-8")) for i, p in enumerate(order)], FILES)


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """FILES under a folder that all executors share, listed and read by Spark."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(folder)
    inside = F.array_contains
    parts = F.split("path", "/")
    for name in sorted(SKIPPED):
        raw = raw.filter(~inside(parts, name))
    at = folder.rstrip("/").split("://")[-1]
    rel = F.expr(f"substring(path, locate('{at}/', path) + {len(at) + 1})")
    return raw.select(F.lit(None).cast("long").alias("file_ord"), rel.alias("path"), F.decode("content", "UTF-8").alias("src")).drop("file_ord")


def parse_log(text: str) -> tuple[list[tuple], list[tuple]]:
    """(commits, touched files) of a log with one header line per commit, newest first."""
    commits, touched = [], []
    for line in text.split("\n"):
        if line.count(_SEP) >= 3:
            h, at, author, subject = line.split(_SEP, 3)
            commits.append((h, len(commits), datetime.fromisoformat(at), at, author, subject))
        elif line and commits:
            touched.append((commits[-1][0], line))
    return commits, touched


def parse_numstat(text: str) -> list[tuple]:
    """(hash, path, ins, del); binary files have no numbers and are left out."""
    out, at = [], None
    for line in text.split("\n"):
        cells = line.split("\t")
        if len(cells) == 3:
            if at is not None and cells[0].isdigit() and cells[1].isdigit():
                out.append((at, cells[2], int(cells[0]), int(cells[1])))
        elif line.strip():
            at = line.strip()
    return out


def parse_reviews(text: str) -> list[tuple]:
    """(path, ts) of the marks in commit bodies."""
    out = []
    for entry in text.split("\0"):
        at, _, body = entry.strip("\n").partition(_SEP)
        if at:
            out += [(m[1].strip(), datetime.fromisoformat(at)) for m in re.finditer(rf"^{REVIEW}\s+(.+)$", body, re.M)]
    return out


def parse_diff(text: str) -> list[tuple[str, int]]:
    """(path, line) of all lines that a diff without context adds or changes."""
    out, path = [], None
    for line in text.split("\n"):
        if line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else None
        elif path and (m := re.match(r"@@ -\S+ \+([0-9]+),?([0-9]*) @@", line)):
            start, n = int(m[1]), int(m[2] or "1")
            out += [(path, i) for i in range(start, start + n)]
    return out


def changed(spark: SparkSession, root: Path, since: str) -> DataFrame | None:
    """(path, line) changed since a revision; None outside a repository, no rows where git can't tell."""
    try:
        at = top(root)
    except NotARepository:
        return None
    return spark.createDataFrame(parse_diff(_git(at, "diff", "--unified=0", since, "--") or ""), "path string, line int")


def log(spark: SparkSession, root: Path, days: int) -> dict[str, DataFrame]:
    """commits, commit_files, numstat and reviews of the last days, merges left out; numbers of lines are read only where there are commits."""
    at = top(root)
    since = f"--since={days} days ago"
    commits, touched = parse_log(_git(at, "log", f"--format=%H{_SEP}%aI{_SEP}%an{_SEP}%s", *"--no-merges --name-only".split(), since, "--", "*.py") or "")
    stats = parse_numstat(_git(at, *"log --numstat --no-merges --format=%H".split(), since, "--", "*.py") or "") if commits else []
    marks = parse_reviews(_git(at, "log", "-z", f"--grep={REVIEW}", since, f"--format=%aI{_SEP}%B") or "") if commits else []
    return {
        "commits": spark.createDataFrame(commits, COMMITS),
        "commit_files": spark.createDataFrame(touched, "hash string, path string"),
        "numstat": spark.createDataFrame(stats, "hash string, path string, ins int, del int"),
        "reviews": spark.createDataFrame(marks, "path string, ts timestamp"),
    }


def mark_reviewed(reviews: DataFrame, paths: list[str], ts: datetime) -> DataFrame:
    """The reviews with these files marked, as a table."""
    return reviews.unionByName(reviews.sparkSession.createDataFrame([(p, ts) for p in paths], "path string, ts timestamp"))


def commit_reviewed(root: Path, paths: list[str]) -> None:
    """An empty commit that marks files, by their paths from the top of the repository."""
    at = top(root)
    named = [os.path.relpath(Path(p).resolve(), at.resolve()) for p in paths]
    subject = f"Mark {named[0] if len(named) == 1 else f'{len(named)} files'} as reviewed"
    if _git(at, "commit", "--allow-empty", "-m", subject, "-m", "\n".join(f"{REVIEW} {n}" for n in named)) is None:
        raise NotARepository(f"git can't commit in {at}")
