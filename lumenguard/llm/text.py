"""Column expressions shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII white space, and the words between them.
SPACES, SPACED = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Runs of all ASCII but digits and lower-case letters: what parts words of ASCII letters and digits and of everything beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_az(text: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` does that for ASCII texts, and much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, breaks: str = SPACES) -> Column:
    """What stands between matches of ``breaks``, in order; none for null. Splitting is twice as fast as extracting."""
    parts = F.split(F.coalesce(text, F.lit("")), breaks, -1)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once a row; inside a lambda it would be for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that ``taken`` lacks, whatever its case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
