"""Filters as boolean columns or semi-joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(predicates: Iterable[Column | None]) -> Column:
    """AND of all that are given; true for none."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def in_files(df: DataFrame, files: DataFrame, on: str | list[str] = "path_key") -> DataFrame:
    """Rows whose path is in the list, without regard to case."""
    return df.join(files, on, "left_semi")


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    return any_of(F.lower(path).endswith(e.lower()) for e in extensions)


def includes(path: Column, parts: Iterable[str]) -> Column:
    return any_of(F.lower(path).contains(p.lower()) for p in parts)


def excludes(path: Column, parts: Iterable[str]) -> Column:
    return ~includes(path, parts)


def within(path: Column, root: str) -> Column:
    return F.lower(path).startswith(root.lower())


def is_unit_test(path: Column) -> Column:
    """Regards case."""
    return path.contains("UnitTest") & path.contains("_") & path.endswith(".cs")


def project_filter(path: Column, extensions: Iterable[str] = (), exclude: Iterable[str] = (), include: Iterable[str] = (), root: str | None = None) -> Column:
    """Extension, not excluded, included, below the root; empty parts are skipped."""
    extensions, exclude, include = list(extensions), list(exclude), list(include)
    return all_of([
        has_extension(path, extensions) if extensions else None,
        excludes(path, exclude) if exclude else None,
        includes(path, include) if include else None,
        within(path, root) if root else None,
    ])


def is_kind(kind: Column, bit: int) -> Column:
    return kind.bitwiseAND(F.lit(bit)) == bit


def has_bug(work_items: Column) -> Column:
    """Whether one of the work items (structs with a type) is a bug."""
    return F.exists(work_items, lambda w: F.upper(w["type"]) == "BUG")


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    """Inclusive on both ends."""
    return all_of([value >= low if low is not None else None, value <= high if high is not None else None])


def matches(term: str, *columns: Column) -> Column:
    return any_of(F.lower(c).contains(term.lower()) for c in columns)
