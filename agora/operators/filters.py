"""Row filters as column expressions: optional arguments, patterns, arrays, JSON, roles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def optional(**wanted) -> Column:
    """Equality for each named column whose argument isn't None; all rows if none is left."""
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def one_of(column: Column, values: Sequence | None) -> Column:
    """Any of ``values``; None lets every row pass, an empty list none."""
    return F.lit(True) if values is None else column.isin(*values) if values else F.lit(False)


def slug_of(slug: Column, base: Column) -> Column:
    """Whether a slug is a base or the base with a number."""
    return slug.eqNullSafe(base) | (slug.startswith(base) & F.substring(slug, F.length(base) + 1, F.length(slug)).rlike("^-[0-9]+$"))


def none_like(column: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, p: a & ~column.like(p), patterns, F.lit(True))


def has_any(array: Column, values: Sequence) -> Column:
    return F.arrays_overlap(array, F.array(*map(F.lit, values)))


def has_all(array: Column, values: Sequence) -> Column:
    wanted = F.array(*map(F.lit, values))
    return F.size(F.array_intersect(array, wanted)) == F.size(F.array_distinct(wanted))


def json_has(column: Column, field: str, value: Column) -> Column:
    """Whether a JSON array of objects holds one whose ``field`` is ``value``."""
    return F.exists(F.from_json(column, f"array<struct<`{field}`: string>>"), lambda e: e[field] == value.cast("string"))


def json_flag(column: Column, path: str) -> Column:
    """A JSON object's flag; false where it is null, absent or no flag."""
    return F.coalesce(F.get_json_object(column, path).try_cast("boolean"), F.lit(False))


def role_at_least(role: Column, least: str, ladder: Sequence[str]) -> Column:
    """Whether a role stands at ``least`` or above on a ladder (lowest first); unknown roles don't."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ladder)), role) > ladder.index(least), F.lit(False))
