"""Tag maps: selection by patterns, narrowest integer types, text form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(patterns: list[str]) -> str:
    """Two-character patterns of letters, digits, classes and ``.``, as one anchored expression."""
    for p in patterns:
        if not re.fullmatch(r"(\[\^?[A-Za-z0-9-]+\]|[A-Za-z0-9.]){2}", p):
            raise ValueError(f"{p!r} is no pattern of a tag's two characters")
    return "^(" + "|".join(patterns) + ")$"


def keep(tags: Column, patterns: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: k.rlike(_pattern(patterns)))


def drop(tags: Column, patterns: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.rlike(_pattern(patterns)))


def integer_type(v: Column) -> Column:
    """Narrowest stored type: C, S, I when not negative, else c, s, i."""
    return (
        F.when(v >= 0, F.when(v < 256, "C").when(v < 65536, "S").otherwise("I"))
        .otherwise(F.when(v >= -128, "c").when(v >= -32768, "s").otherwise("i"))
    )


def parse(tags: Column) -> Column:
    """``array<string>`` of TG:T:value to ``map<tag, struct<type, value>>``."""
    return F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, F.lit(6), F.length(t)).alias("value")))))


def render(tags: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
