"""Scalar functions on columns; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ADD, COPY, DELETE, EDIT, NONE, RENAME, TYPE_CHANGED

# File extensions whose lines are counted, and their languages.
LANGUAGES = {
    ".cs": "C#", ".xml": "XML", ".xaml": "XAML", ".cpp": "C++", ".h": "C/C++ Header", ".c": "C",
    ".java": "Java", ".py": "Python", ".css": "CSS", ".js": "JavaScript", ".html": "HTML",
}


def path_key(path: Column) -> Column:
    """The key under which metrics and contributions of a file are found."""
    return F.lower(path)


def local_path(server_path: Column, root: str, strip: str = "", separator: str = "\\") -> Column:
    """A server path below the local root; ``strip`` is the checkout's own path on the server."""
    inner = F.regexp_replace(server_path, "^" + _literal(strip), "")
    return F.concat(F.lit(root.rstrip("\\/") + separator), F.translate(F.ltrim(inner, F.lit("/")), "/", separator))


def _literal(text: str) -> str:
    """A regular expression for exactly this text."""
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def decode_octal_path(path: Column) -> Column:
    """Replaces runs of octal escapes by the UTF-8 text they stand for and drops surrounding quotes; undecodable paths stay."""
    plain = F.regexp_replace(path, '^"|"$', "")
    tokens = F.regexp_extract_all(plain, F.lit(r"\\[0-3][0-7]{2}|[\s\S]"), F.lit(0))
    as_hex = F.transform(tokens, lambda t: F.when(F.length(t) == 4, F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 2, "0")).otherwise(F.hex(t)))
    raw = F.unhex(F.array_join(as_hex, ""))
    return F.when(~plain.contains("\\"), plain).otherwise(F.coalesce(F.try_validate_utf8(raw.cast("string")), plain))


def kind_of_git_status(status: Column) -> Column:
    return (
        F.when(status.startswith("R"), RENAME)
        .when(status.startswith("C"), COPY)
        .when(status == "A", ADD)
        .when(status.isin("D", "DD"), DELETE)
        .when(status == "M", EDIT)
        .when(status == "T", TYPE_CHANGED)
        .otherwise(NONE)
    )


def kind_of_svn_action(action: Column) -> Column:
    return F.when(action == "M", EDIT).when(action == "A", ADD).when(action == "D", DELETE).when(action == "R", RENAME).otherwise(NONE)


def kind_of_tree_diff(status: Column) -> Column:
    names = {"Added": ADD, "Modified": EDIT, "Deleted": DELETE, "Renamed": RENAME, "Copied": COPY, "TypeChanged": TYPE_CHANGED}
    out = F.when(F.lit(False), NONE)
    for name, kind in names.items():
        out = out.when(status == name, kind)
    return out.otherwise(NONE)


def change_fields(line: Column) -> tuple[Column, Column, Column]:
    """(kind, path, from_path) of a line ``status<tab>path`` or ``status<tab>old<tab>new``."""
    part = F.split(line, "\t")
    kind = kind_of_git_status(F.get(part, F.lit(0)))
    moved = kind.isin(RENAME, COPY)
    path = F.when(moved, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1)))
    return kind, decode_octal_path(path), F.when(moved, decode_octal_path(F.get(part, F.lit(1))))


def work_items(comment: Column, pattern: str) -> Column:
    """All matches in upper case, duplicates kept; none for an empty pattern."""
    if not pattern:
        return F.expr("cast(array() as array<string>)")
    found = F.regexp_extract_all(F.coalesce(comment, F.lit("")), F.lit("(?m)" + pattern), F.lit(0))
    return F.transform(found, F.upper)


def normalise_extensions(text: Column) -> Column:
    """``"Xml, .cs; CS"`` to [".xml", ".cs"]: what follows the last dot, lower case, each once."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.concat(F.lit("."), F.substring_index(x, ".", -1))))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def whole_days(date: Column, as_of: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.timestamp_diff("DAY", date, as_of)


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def min_max_normal(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); NaN for a range of zero."""
    return F.when(high == low, F.lit(float("nan"))).otherwise((value - low) / (high - low))


def coupling_degree(together: Column, first: Column, second: Column) -> Column:
    """100 n / (c1 + c2 - n), to two places, halves to even."""
    return F.bround(F.try_divide(100.0 * together, first + second - together), 2)


def indentation(line: Column, tab_size: int = 4) -> Column:
    """Logical indentation: leading tabs plus leading spaces in units of ``tab_size``."""
    lead = F.regexp_extract(line, r"^[ \t]*", 0)
    spaces = F.length(F.translate(lead, "\t", ""))
    return (F.length(lead) - spaces + F.floor(spaces / tab_size)).cast("int")


def is_blank(line: Column) -> Column:
    return line.rlike(r"^\s*$")


def language(path: Column, languages: Mapping[str, str] = LANGUAGES) -> Column:
    names = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0)))


def color_key(main_developer: Column, lost: Column | None = None) -> Column:
    """The main developer; when a developer is given as lost, only their files keep a key."""
    return main_developer if lost is None else F.when(main_developer == lost, main_developer).otherwise(F.lit(""))
