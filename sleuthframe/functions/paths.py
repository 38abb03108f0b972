"""Expressions over file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STABLE_NAMES = tuple("apps.py conftest.py __init__.py".split())
STABLE_ENDINGS = tuple("config.py settings.py _config.py _settings.py".split())


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory, '.' for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def is_test_history(path: Column) -> Column:
    return name(path).startswith("test_") | name(path).endswith("_test.py")


def is_test(path: Column) -> Column:
    n = name(path)
    return n.startswith("test_") | n.endswith("_test.py") | (n == "conftest.py") | F.arrays_overlap(F.split(path, "/"), F.array(F.lit("tests"), F.lit("test")))


def is_migration(path: Column) -> Column:
    """The first directory called migrations is followed by a part that begins with a digit."""
    return path.rlike(r"^(?:(?!migrations/)[^/]+/)*migrations/[0-9]")


def is_settings(path: Column) -> Column:
    return (name(path) == "settings.py") | F.array_contains(F.split(path, "/"), "settings")


def is_stable(path: Column) -> Column:
    n = name(path)
    ok = n.isin(*STABLE_NAMES)
    for e in STABLE_ENDINGS:
        ok = ok | n.endswith(e)
    return ok


def module(path: Column) -> Column:
    """a/b.py is a.b, and a/__init__.py is a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/?__init__\.py$", ""), r"\.[^./]*$", ""), "/", ".")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for whole strings; * also matches slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "^"))
            j = pattern.find("]", j + (pattern[j : j + 1] == "]"))
            if j < 0:
                out += r"\["
            else:
                inner = pattern[i:j].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
                out += "[" + ("^" + inner[1:] if inner[:1] == "!" else "\\" + inner if inner[:1] == "^" else inner) + "]"
                i = j + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"
