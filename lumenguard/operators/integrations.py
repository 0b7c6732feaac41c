"""Guards around columns: raise, redact or let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import redact
from .classify import classify, types_of

MODES = ("raise", "redact", "allow")


class ComplianceViolation(Exception):
    """Raised by ``checked``; names the types found, in order."""

    def __init__(self, verdict: str, types: list[str]) -> None:
        self.verdict, self.types = verdict, sorted(set(types))
        super().__init__(f"{verdict}: {', '.join(self.types)}")


def guard_output(df: DataFrame, column: str, on_violation: str = "raise") -> DataFrame:
    """``df`` with the column guarded. ``raise`` fails the query at the first text that isn't clean; other types than strings pass through."""
    if on_violation not in MODES:
        raise ValueError(f"on_violation must be one of {', '.join(MODES)}")
    if on_violation == "allow" or dict(df.dtypes)[column] != "string":
        return df
    done = classify(df, column, "_guarded")
    c, r = F.col(column), F.col("_guarded")
    dirty = F.coalesce(r["verdict"] != "CLEAN", F.lit(False))
    if on_violation == "redact":
        out = F.when(dirty, redact(c, r["violations"])).otherwise(c)
    else:
        out = F.when(dirty, F.raise_error(F.concat(r["verdict"], F.lit(": "), F.array_join(types_of(r["violations"]), ", ")))).otherwise(c)
    return done.withColumn(column, out).drop("_guarded")


def guard_io(df: DataFrame, inputs: list[str], outputs: list[str], on_violation: str = "raise", check_inputs: bool = True) -> DataFrame:
    """Guards outputs, and inputs too; inputs are only ever stopped, never altered."""
    for c in inputs if check_inputs and on_violation == "raise" else []:
        df = guard_output(df, c, "raise")
    for c in outputs:
        df = guard_output(df, c, on_violation)
    return df


def checked(df: DataFrame, column: str) -> DataFrame:
    """``df``, or a ComplianceViolation with all types found; runs a job that returns one row."""
    done = classify(df, column, "_guarded").where("_guarded.verdict <> 'CLEAN'")
    found = done.agg(F.max(F.col("_guarded.verdict")).alias("v"), F.array_distinct(F.flatten(F.collect_set(types_of(F.col("_guarded.violations"))))).alias("t")).first()
    if found["v"]:
        raise ComplianceViolation(found["v"], found["t"])
    return df
