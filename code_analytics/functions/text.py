"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parts(path: Column) -> Column:
    return F.split(path, "/")


def parent(path: Column) -> Column:
    """The directory of a path; the empty string at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All directories above a path, the top first."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.transform(F.sequence(F.lit(0), slashes), lambda i: F.call_function("substring_index", path, F.lit("/"), i))


def below(path: Column, directory: Column) -> Column:
    """A path as seen from one of its directories."""
    return F.when(directory == "", path).otherwise(F.substring(path, F.length(directory) + 2, F.length(path)))


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """`df` with a broadcast hint while it has at most `rows` rows; beyond them Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def language(path: Column) -> Column:
    """By the last suffix, case-sensitive; a dot file has none."""
    # fixed values: suffixes of the languages
    by_suffix = {".py": "python", ".ts": "typescript", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript"}
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in by_suffix.items() for x in kv]), suffix)


def line_count(content: Column) -> Column:
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (breaks + F.when(content.endswith("\n"), 0).otherwise(1)).cast("int")


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def first_reason(*pairs: tuple[Column, Column | str]) -> Column:
    """The reason of the first condition that holds, else null."""
    out = None
    for condition, reason in pairs:
        value = reason if isinstance(reason, Column) else F.lit(reason)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out
