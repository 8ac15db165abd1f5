"""Ordered rule tables as one conditional expression: what a text holds, what rules it out, what is taken from it."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``value`` holds where every entry of ``has`` is in the text (a tuple within: any of it), none of ``bars`` is, and
    ``pattern`` matches. ``{}`` in the value is the pattern's first group. Phrases are in small letters and meet the text
    in small letters; patterns meet it as it is."""

    value: str | Column | None
    has: tuple[str | tuple[str, ...], ...] = ()
    bars: tuple[str, ...] = ()
    pattern: str | None = None


def holds(text: Column, phrases: str | Iterable[str]) -> Column:
    """Whether a text, in small letters, holds one of the phrases."""
    test = None
    for p in (phrases,) if isinstance(phrases, str) else phrases:
        test = text.contains(p) if test is None else test | text.contains(p)
    return F.lit(False) if test is None else test


def captured(text: Column, pattern: str) -> Column:
    """The pattern's first group, null where it doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def first_match(rules: Iterable[Rule], text: Column, low: Column | None = None, otherwise: Column | None = None) -> Column:
    """The value of the first rule that takes a text; ``low``: what phrases are looked for in (the text in small letters)."""
    low = F.lower(text) if low is None else low
    out = None
    for rule in rules:
        test = F.lit(True)
        for one in rule.has:
            test = test & holds(low, one)
        for one in rule.bars:
            test = test & ~low.contains(one)
        if rule.pattern is not None:
            test = test & text.rlike(rule.pattern)
        said = rule.value if isinstance(rule.value, Column) else F.lit(rule.value)
        if isinstance(rule.value, str) and "{}" in rule.value:
            before, after = rule.value.split("{}")
            parts = [F.lit(before)] * bool(before) + [F.regexp_extract(text, rule.pattern, 1)] + [F.lit(after)] * bool(after)
            said = F.concat(*parts)
        out = F.when(test, said) if out is None else out.when(test, said)
    if out is None:
        return otherwise if otherwise is not None else F.lit(None).cast("string")
    return out if otherwise is None else out.otherwise(otherwise)
