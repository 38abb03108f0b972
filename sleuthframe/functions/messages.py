"""Classification of commit subjects, and number formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LABELS = ("fix", "feature", "refactor", "debt", "emergency")
_WORDS = {
    "fix": r"fix|bug|bugfix|patch|correct|repair|resolve|hotfix",
    "feature": r"add|implement|introduce|support|create|new",
    "refactor": r"clean\s*up|extract|inline|move|refactor|rename|reorganize|restructure|simplify",
    "debt": r"fixme|hack|kludge|quick\s*fix|stopgap|temporary|todo|workaround",
    "emergency": r"hotfix|urgent|emergency|revert|rollback|cherry.?pick",
}
_SIGNS = {"fix": "\U0001f41b \U0001f6a8 ✅ \U0001f527", "feature": "✨ \U0001f680 \U0001f389", "refactor": "♻️ \U0001f3a8 \U0001f4a1", "emergency": "\U0001f525 ⏪"}
_PREFIX = dict(zip("feat fix refactor".split(), "feature fix refactor".split()))
#: Types of conventional commits that make a subject a good one.
KINDS = tuple("build chore ci docs feat fix perf refactor revert style test tests".split())
POOR = tuple("asdf changes fix stuff temp tmp update wip".split())


def kind(subject: Column) -> Column:
    """What precedes the first colon, in lower case without a scope; null without a colon."""
    return F.when(subject.contains(":"), F.substring_index(F.lower(F.trim(F.substring_index(subject, ":", 1))), "(", 1))


def scope(subject: Column) -> Column:
    """auth of "fix(auth): ..."; null where there is none."""
    found = F.regexp_extract(F.substring_index(subject, ":", 1), r"^[^()]*\(([^()]*(?:\([^()]*)*)\)", 1)
    return F.when(subject.contains(":"), F.nullif(F.lower(F.trim(found)), F.lit("")))


def has(label: str, subject: Column) -> Column:
    ok = subject.rlike(rf"(?iU)\b({_WORDS[label]})\b")
    for sign in _SIGNS.get(label, "").split():
        ok = ok | subject.startswith(sign)
    for k, v in _PREFIX.items():
        if v == label:
            ok = ok | F.coalesce(kind(subject) == k, F.lit(False))
    return ok


def labels(subject: Column) -> Column:
    return F.array_compact(F.array(*(F.when(has(x, subject), x) for x in LABELS)))


def is_good(subject: Column) -> Column:
    signs = F.lit(False)
    for some in _SIGNS.values():
        for sign in some.split():
            signs = signs | subject.startswith(sign)
    typed = F.coalesce(kind(subject).isin(*KINDS), F.lit(False))
    return (F.length(subject) > 10) & (signs | typed | ~F.lower(F.trim(subject)).isin(*POOR))


@F.pandas_udf(StringType())
def py_format(value: pd.Series, spec: pd.Series) -> pd.Series:
    """Python's number format, which rounds the exact binary value half to even; built-in formats don't."""
    return pd.Series([None if pd.isna(v) else format(v, s) for v, s in zip(value, spec)])


def text(*parts: object) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def number(c: str | Column, spec: str = "") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return py_format(c.cast("double"), F.lit(spec)) if spec else c.cast("string")
