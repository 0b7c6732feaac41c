"""Patterns that the regular expression engine cannot run: found before a job starts, left out of it, and reported by each result.

In a job an engine's error would end the task and with it every other pattern's search. So each pattern is compiled and tried on the
driver, on long runs of each kind of character, where an error is only an answer. Patterns of the library's own pack have passed.
"""

from __future__ import annotations

from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import pack
from ..functions.spans import none_of
from .scan import VIOLATION

NOT_EVALUATED = "PATTERN_NOT_EVALUATED"
#: What patterns are tried on, each this many times over.
TRIALS, TIMES = ("a", "A", "0", " ", "-", "=", "a1", "0 ", "é"), 20_000


def runs(spark: SparkSession, source: str) -> bool:
    """Whether the engine compiles ``source`` and searches all of ``TRIALS`` to their ends."""
    try:
        compiled = spark._jvm.java.util.regex.Pattern.compile(source)
        for trial in TRIALS:
            compiled.matcher(trial * TIMES).find()
    except Py4JError:
        return False
    return True


@lru_cache(maxsize=64)
def _unevaluated(patterns: tuple[pack.Pattern, ...]) -> tuple[str, ...]:
    spark = SparkSession.active()
    return tuple(p.id for p in patterns if p not in pack.PATTERNS and not runs(spark, pack.java(p)))


def unevaluated(patterns: tuple[pack.Pattern, ...]) -> tuple[str, ...]:
    """Ids of the patterns that cannot run, in the pack's order."""
    return () if patterns == pack.PATTERNS else _unevaluated(patterns)


def whole(patterns: tuple[pack.Pattern, ...]) -> tuple[pack.Pattern, ...]:
    """``patterns``, or an error that names those that cannot run, for scans that must not leave any out."""
    if bad := unevaluated(patterns):
        raise pack.PackError(f"pattern{'s' * (len(bad) > 1)} {', '.join(bad)} cannot be evaluated")
    return patterns


def findings(ids: tuple[str, ...]) -> Column:
    """A finding for each pattern that did not run: no match, so without view and place."""
    if not ids:
        return none_of(VIOLATION)
    text, at = F.lit(None).cast("string"), F.lit(None).cast("int")
    one = lambda i: F.struct(F.lit(f"{NOT_EVALUATED}:{i}").alias("type"), F.lit(i).alias("value"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1.0).alias("confidence"), F.lit("regex").alias("classifier"), text.alias("view"), at.alias("original_start"), at.alias("original_end"))
    return F.array(*map(one, ids)).cast(f"array<{VIOLATION}>")
