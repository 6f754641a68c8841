"""Names and lists in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?[0-9]+)"


def safe_name(value: Column) -> Column:
    """The text with characters other than ASCII letters, digits, _ and - replaced by _."""
    return F.regexp_replace(value, "[^a-zA-Z0-9_-]", "_")


def int_list(value: Column) -> Column:
    """The integers at the head of a comma-separated text's parts; parts without one, or with one that is no int, are left out."""
    numbers = F.transform(F.split(value, ","), lambda part: F.regexp_extract(part, _NUMBER, 1).try_cast("int"))
    return F.filter(numbers, lambda n: n.isNotNull())


def periods_of(text: str, allowed: tuple[int, ...] = (3, 6, 12)) -> tuple[int, ...]:
    """The allowed numbers of months in a comma-separated option."""
    found = (re.match(_NUMBER, part) for part in text.split(","))
    return tuple(n for m in found if m and (n := int(m[1])) in allowed)
