"""Settings from .sleuthframe.toml or the [tool.sleuthframe] table of pyproject.toml."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from pathlib import Path
from typing import Any

LISTS = ("exclude", "skip")
CHOICES = {"min-severity": ("low", "medium", "high"), "commit-messages": ("auto", "structured", "unstructured")}
TEXTS = ("check", "git-window", *CHOICES)
PAIRS = "expected-coupling"
WINDOW = re.compile(r"\d+[dmy]")


class ConfigError(Exception):
    """A setting that doesn't exist or can't be."""


def find(folder: Path) -> tuple[Path, dict[str, Any]] | None:
    """The first of the two files that has settings."""
    own = folder / ".sleuthframe.toml"
    try:
        if own.is_file():
            return own, tomllib.loads(own.read_text())
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{own}: {e}") from e
    project = folder / "pyproject.toml"
    try:
        tools = tomllib.loads(project.read_text()).get("tool", {}) if project.is_file() else {}
    except tomllib.TOMLDecodeError:
        return None
    return (project, tools["sleuthframe"]) if "sleuthframe" in tools else None


def validate(config: dict[str, Any], source: str, checks: Iterable[str]) -> dict[str, Any]:
    known = {*LISTS, *TEXTS, PAIRS}
    if odd := sorted(set(config) - known):
        raise ConfigError(f"{source}: no such key(s): {', '.join(odd)}; there are {', '.join(sorted(known))}")
    checks = set(checks)
    for k, v in config.items():
        kind = type(v).__name__
        if k in LISTS:
            if not isinstance(v, list):
                raise ConfigError(f"{source}: '{k}' must be a list, got {kind}")
            if bad := [x for x in v if not isinstance(x, str)]:
                raise ConfigError(f"{source}: '{k}' items must be strings, got {type(bad[0]).__name__}")
        elif k == PAIRS:
            if not isinstance(v, list):
                raise ConfigError(f"{source}: '{k}' must be a list of pairs, got {kind}")
            for i, x in enumerate(v):
                if not isinstance(x, list) or len(x) != 2:
                    raise ConfigError(f"{source}: item {i} of '{k}' is {x!r}, not one of the 2-element lists")
                if {type(s) for s in x} != {str}:
                    raise ConfigError(f"{source}: item {i} of '{k}' must contain strings")
        elif not isinstance(v, str):
            raise ConfigError(f"{source}: '{k}' must be a string, got {kind}")
        elif k in CHOICES and v not in CHOICES[k]:
            raise ConfigError(f"{source}: invalid {k} '{v}'; valid are {', '.join(CHOICES[k])}")
        elif k == "check" and v not in checks:
            raise ConfigError(f"{source}: unknown check '{v}'")
        elif k == "git-window" and not WINDOW.fullmatch(v):
            raise ConfigError(f"{source}: '{v}' is no git-window; that is a number and d, m or y, as 6m")
    if bad := [s for s in config.get("skip", []) if s not in checks]:
        raise ConfigError(f"{source}: skip names no check: {' '.join(bad)}")
    return config


def load(folder: Path, checks: Iterable[str]) -> dict[str, Any]:
    """The folder's settings, empty where it has none."""
    found = find(folder)
    return validate(found[1], str(found[0]), checks) if found else {}


def above(folder: Path) -> Path | None:
    """The nearest folder above with settings, which don't count for this one."""
    return next((p for p in folder.resolve().parents if find(p)), None)
