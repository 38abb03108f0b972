"""A version history made of table rows, as samples makes source code of them.

Each supplier becomes a directory with one module and what else the check needs;
its commits follow the pattern that the check reports for suppliers with a
balance of BALANCE or more, and one just short of it for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import spread
from .history import CHECKS, History
from .samples import BALANCE

MAIN = ".py"
START = datetime(2024, 1, 1, tzinfo=UTC)


@dataclass
class Commit:
    day: int
    subject: str
    files: tuple[str, ...] = (MAIN,)
    author: str = "ann"
    ins: int = 1
    dels: int = 0
    outside: int = 0  # files beside them that aren't analysed


@dataclass
class Pattern:
    commits: list[Commit]
    files: tuple[str, ...] = (MAIN,)
    lines: int = 100
    quiet: list[Commit] = field(default_factory=list)


def _each(days: list[int], *subjects: str, **more: object) -> list[Commit]:
    return [Commit(d, subjects[i % len(subjects)], **more) for i, d in enumerate(days)]


#: Commits elsewhere in a supplier's directory: they set the project's rates, medians and span.
NOISE = [Commit(d, "docs: describe the interface", ("_noise.py",), a) for d in range(0, 70, 7) for a in ("bob", "cid")]
FIX, FEATURE, DOCS = "fix: handle the empty input", "feat: read a second format", "docs: describe the interface"


def pattern(check: str, bad: bool) -> Pattern:
    both = (MAIN, "_b.py")
    week = [0, 7, 14, 21, 28, 35]
    if check == "bug-magnet":
        return Pattern(_each(week, *[FIX] * (3 if bad else 2), *[DOCS] * (3 if bad else 4)))
    if check == "fix-propagation":
        return Pattern(_each([1, 2, 3] if bad else [1, 2], FIX, files=both), both)
    if check == "fix-follows-feature":
        return Pattern(_each([1, 29, 57], FEATURE) + _each([8, 36, 64] if bad else [8, 36], FIX))
    if check == "stabilization-failure":
        return Pattern(_each([1, 8, 29, 36, 57, 64, 1, 8] if bad else [1, 8, 29, 36, 1, 8, 29, 36], DOCS))
    if check == "blast-radius":
        return Pattern(_each([1, 2, 3, 4, 5], DOCS, outside=8 if bad else 7))
    if check == "change-coupling":
        return Pattern(_each([1, 2, 3, 4, 5] if bad else [1, 2, 3, 4], DOCS, files=both), both)
    if check == "yo-yo-code":
        return Pattern(_each([1, 2, 3, 4, 5], DOCS, ins=40, dels=20 if bad else 19))
    if check == "conscious-debt":
        return Pattern(_each([1], "add a workaround for the parser" if bad else DOCS))
    if check == "emergency-hotspots":
        return Pattern(_each([1, 2, 3, 4, 5], *["revert the parser change"] * (3 if bad else 2), *[DOCS] * (2 if bad else 3)))
    if check == "no-refactoring":
        return Pattern(_each(list(range(1, 9)), *[FIX] * 4, *[FEATURE] * 3, DOCS if bad else "refactor: split the parser"))
    if check == "test-erosion":
        return Pattern(_each(week, DOCS) + _each([1] if bad else [1, 2, 3], DOCS, files=("test",)), (MAIN, "test"))
    if check == "growth-trajectory":
        return Pattern(_each([1], DOCS, ins=300, dels=50 if bad else 150), lines=400)
    if check == "churn-without-growth":
        return Pattern(_each(list(range(1, 11)), DOCS, ins=5, dels=4 if bad else 3))
    if check == "hotspot-acceleration":
        return Pattern(_each([36, 36, 43, 43, 50, 50, 57, 57, 64, 64] if bad else [1, 8, 15, 22, 29, 36, 43, 50, 57, 64], DOCS))
    if check == "abandoned-code":
        return Pattern(_each([1], DOCS, files=("_b.py", "_c.py") if bad else ("_b.py", "_c.py", MAIN)), (MAIN, "_b.py", "_c.py"))
    if check == "knowledge-silo":
        return Pattern(_each([1, 2, 3, 4], DOCS) + _each([5], DOCS, author="ann" if bad else "bob"), quiet=_each([6], DOCS, author="cid") if not bad else [])
    if check == "divergent-change":
        return Pattern(_each(list(range(1, 9)), *(f"feat({s}): read a second format" for s in (("auth", "api", "db", "web") if bad else ("auth", "api", "db")))))
    raise KeyError(check)


#: Suppliers whose rows leave a worker together.
SUPPLIERS = 32
ROWS = "kind string, path string, file_ord long, lines int, hash string, seq long, ts timestamp, ts_raw string, author string, subject string, ins int, dels int"
_NAMES = [f.split()[0] for f in ROWS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]


def rows(check: str, k: int, bad: bool) -> list[tuple]:
    p = pattern(check, bad)
    at = lambda f: f"pkg{k}/test_mod{k}.py" if f == "test" else f"pkg{k}/mod{k}{f}"
    out: list[tuple] = [("file", at(f), k * 100 + i, p.lines, *[None] * 8) for i, f in enumerate(p.files)]
    for i, c in enumerate([*p.commits, *p.quiet, *NOISE]):
        h, ts = f"{k}-{i}", START + timedelta(days=c.day, seconds=i)
        out.append(("commit", None, None, None, h, (10_000 - c.day) * 10_000_000 + k * 100 + i, ts, ts.isoformat(), c.author, c.subject, None, None))
        for f in [*map(at, c.files), *(f"pkg{k}/out{j}.py" for j in range(c.outside))]:
            out.append(("touch", f, None, None, h, None, None, None, None, None, c.ins, c.dels))
    return out


def history(suppliers: DataFrame, check: str) -> History:
    """The history of all suppliers (s_suppkey, s_acctbal) for a check."""

    def of(kind: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # A worker holds the rows of a few suppliers, however many come in a batch.
                for part in (b.slice(i, SUPPLIERS) for i in range(0, b.num_rows, SUPPLIERS)):
                    got = [r for k, a in zip(part["s_suppkey"].to_pylist(), part["s_acctbal"].to_pylist()) for r in rows(check, k, a is not None and a >= BALANCE) if r[0] == kind]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), _TYPES)], _NAMES)

        return spread_.mapInArrow(run, ROWS)

    spread_ = spread(suppliers.select("s_suppkey", "s_acctbal"))
    touched = of("touch")
    return History(
        of("file").select("file_ord", "path", F.col("lines").alias("n_lines_ast")),
        of("commit").select("hash", "seq", "ts", "ts_raw", "author", "subject"),
        touched.select("hash", "path"),
        touched.select("hash", "path", "ins", F.col("dels").alias("del")),
    )


def expected_sql(check: str) -> str:
    severity = CHECKS[check][1]
    return f"select 'pkg' || s_suppkey || '/mod' || s_suppkey || '.py' as file, 1::int as line, '{check}' as \"check\", '{severity}' as severity from supplier where s_acctbal >= {BALANCE}"
