"""Scalar functions as column expressions: they stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest score of A, B, C and D for each engine.
CUTS = {
    "complexity": (90, 75, 50, 25),
    "security": (90, 75, 60, 40),
    "imports": (90, 80, 70, 60),
    "clones": (90, 80, 70, 60),
    "tests": (90, 80, 70, 50),
    "hotspots": (90, 80, 65, 50),
    "dependencies": (90, 80, 70, 50),
    "types": (90, 80, 70, 60),
    "environment": (90, 80, 70, 60),
    "naming": (90, 75, 60, 40),
    "debt": (90, 75, 60, 40),
    "bugs": (90, 75, 60, 40),
    "dead_code": (90, 75, 60, 40),
    "docstrings": (90, 80, 70, 60),
}
#: Weight of a finding's severity in each engine's score.
WEIGHTS = {
    "security": {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 1},
    "bugs": {"error": 5.0, "warning": 2.0, "info": 0.5},
    "dead_code": {"high": 4.0, "medium": 2.0, "low": 1.0, "info": 0.5},
    "tests": {"high": 5, "medium": 3, "low": 1},
    "debt": {"high": 3, "medium": 2, "low": 1},
    "environment": {"HIGH": 10, "MODERATE": 5, "LOW": 2, "INFO": 1},
    "commits": {"critical": 20, "high": 10, "medium": 3, "low": 1, "info": 0},
}
#: Order of severities, the gravest last.
RANKS = {
    "bugs": ("info", "warning", "error"),
    "dead_code": ("info", "low", "medium", "high"),
    "security": ("info", "low", "medium", "high", "critical"),
    "dependencies": ("NONE", "LOW", "MODERATE", "HIGH", "CRITICAL"),
    "environment": ("INFO", "LOW", "MODERATE", "HIGH"),
}
COMMIT_GRADES = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (70, "C"), (60, "D"))


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """The table's value for ``key``, as a literal map in the plan."""
    found = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(found, key), F.lit(default))


def steps(value: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first band whose lower bound the value reaches."""
    out = F.lit(rest)
    for bound, label in reversed(bands):
        out = F.when(value >= bound, label).otherwise(out)
    return out


def grade(score: Column, engine: str) -> Column:
    return steps(score, list(zip(CUTS[engine], "ABCD")), "F")


def cyclomatic_grade(value: Column) -> Column:
    return steps(-value, [(-5, "A"), (-10, "B"), (-20, "C"), (-50, "D")], "F")


def rank(severity: Column, engine: str) -> Column:
    """0 for the mildest severity and for unknown ones."""
    return lookup(severity, {s: i for i, s in enumerate(RANKS[engine])}, 0)


def half_even(value: Column) -> Column:
    """Rounds to a whole number, halves to the even one."""
    return F.bround(value, 0).cast("int")


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


# names


def bare(name: Column) -> Column:
    return F.regexp_replace(name, "^_+", "")


def is_dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def is_snake(name: Column) -> Column:
    return (F.length(bare(name)) <= 1) | is_dunder(name) | name.rlike("^_*[a-z][a-z0-9_]*$")


def is_camel(name: Column) -> Column:
    return (F.length(bare(name)) <= 1) | name.rlike("^_*[A-Z][a-zA-Z0-9]*$")


def is_upper(name: Column) -> Column:
    return (F.length(bare(name)) <= 1) | name.rlike("^_*[A-Z][A-Z0-9_]*$")


def to_snake(name: Column) -> Column:
    """Word breaks before a capital after a small letter, and before the last capital of a run; runs stay together."""
    start = F.regexp_extract(name, "^_*", 0)
    broken = F.regexp_replace(bare(name), r"(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.concat(start, F.lower(broken))


def to_camel(name: Column) -> Column:
    parts = F.filter(F.split(bare(name), "_"), lambda p: p != "")
    words = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
    return F.concat(F.regexp_extract(name, "^_*", 0), F.array_join(words, ""))


# versions


def package_name(name: Column) -> Column:
    """The normal form under which package names are compared."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def version_parts(version: Column) -> Column:
    """Leading digits of each dotted part; parts without any are skipped, and nothing at all is [0]."""
    digits = F.transform(F.split(version, r"\."), lambda p: F.regexp_extract(p, r"^\d+", 0))
    numbers = F.transform(F.filter(digits, lambda p: p != ""), lambda p: p.cast("int"))
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(0)))


def update_kind(current: Column, latest: Column) -> Column:
    """up-to-date, major, minor or patch."""
    a, b = version_parts(current), version_parts(latest)
    part = lambda v, i: F.coalesce(F.get(v, F.lit(i)), F.lit(0))
    return F.when(a >= b, "up-to-date").when(part(a, 0) != part(b, 0), "major").when(part(a, 1) != part(b, 1), "minor").otherwise("patch")


# environment and debt

SECRET_NAME = r"(?i)secret|passw(or)?d|pwd|token|auth|cred|(api|priv|private|access|aws).?key|(database|db).?url|connection.?string"
PLACEHOLDER_VALUE = r"(?i)^(xxx|todo|replace|placeholder|change[-_]?me|your[-_])|^<.*>$|^[.]{3}$"
DEBT_TAGS = {"FIXME": "high", "HACK": "high", "BUG": "high", "XXX": "medium", "TODO": "medium", "NOQA": "low", "NOTE": "low", "CHANGED": "low", "OPTIMIZE": "medium", "REFACTOR": "medium"}
DEBT = rf"(?i)(?:#|//|/\*|\*|--|;)\s*({'|'.join(DEBT_TAGS)})(?:\(([^)]+)\))?\s*:?\s*(.+?)?\s*$"


def module_of(path: Column, src_is_package: Column | None = None) -> Column:
    """Dotted module of a path; a package's own file is the package, and a ``src`` folder counts only where it is one."""
    kept = F.lit(False) if src_is_package is None else src_is_package
    inner = F.when(kept, path).otherwise(F.regexp_replace(path, "^src/", ""))
    dotted = F.regexp_replace(F.regexp_replace(inner, r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"\.?__init__$", "")


def is_test_path(path: Column) -> Column:
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    return slashes.rlike(r"(^|/)(test_[^/]*|[^/]*_test\.py|conftest\.py)$|/tests?/")


def prefixes(module: Column) -> Column:
    """A module and its packages, the longest first."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
