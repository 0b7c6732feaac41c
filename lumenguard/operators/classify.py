"""One result for each text: verdict, findings, views that were looked at, and what was done to get there.

A null text gives a null result; an empty one is not scanned (no layers) but policy and registry still apply to it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dual
from ..functions import normalize as N
from ..functions import pack
from ..functions.spans import none_of, once
from . import isolation
from .scan import VIOLATION, across_views


def severity(verdict: Column) -> Column:
    return F.when(verdict == "DENY", 3).when(verdict == "VIOLATION", 2).when(verdict == "INCOMPLETE", 1).otherwise(0)


def merge_verdicts(*verdicts: Column) -> Column:
    """The worst of them: DENY, then VIOLATION, then CLEAN; null counts as CLEAN."""
    worst = F.greatest(*[severity(v) for v in verdicts], F.lit(0))
    return F.when(worst == 3, "DENY").when(worst == 2, "VIOLATION").when(worst == 1, "INCOMPLETE").otherwise("CLEAN")


def regex_verdict(violations: Column) -> Column:
    return F.when(F.size(violations) > 0, "VIOLATION").otherwise("CLEAN")


def types_of(violations: Column) -> Column:
    """Distinct types in order."""
    return F.array_sort(F.array_distinct(F.transform(violations, lambda v: v.type)))


@lru_cache(maxsize=16)
def expressions(text: str, patterns: tuple[pack.Pattern, ...]) -> tuple[str, str]:
    """SQL of the views of column ``text``, next to ``_folded``, and of the findings in ``_views``; made once for each pack."""
    with dual.as_text():
        return N.views(dual.F.col(text), dual.F.col("_folded")).sql, across_views(dual.F.col("_views.views"), patterns).sql


def classify(df: DataFrame, text: str, out: str = "result", guard: Column | None = None, patterns: tuple[pack.Pattern, ...] = pack.PATTERNS) -> DataFrame:
    """``df`` with a result struct; patterns that cannot run are left out and reported as findings and by id. ``guard`` is a column with a struct (verdict, violations), null where no guard answered."""
    if dict(df.dtypes).get(text) != "string":
        raise TypeError(f"{text}: a string column is needed, not {dict(df.dtypes).get(text)}")
    version, sha = pack.identity(patterns)
    c = F.col(text)
    bad = isolation.unevaluated(tuple(patterns))
    views, findings = expressions(text, tuple(p for p in patterns if p.id not in bad))
    folded = df.withColumn("_folded", N.nfkc(F.when(c != "", c)))
    viewed = folded.withColumn("_views", F.when(c != "", F.expr(views)))
    scanned = viewed.withColumn("_regex", once(F.when(c != "", F.concat(F.expr(findings), isolation.findings(bad)) if bad else F.expr(findings)).when(c == "", none_of(VIOLATION))))
    answer = guard if guard is not None else F.lit(None).cast(f"struct<verdict:string,violations:array<{VIOLATION}>>")
    accepted = answer.isNotNull() & (c != "")
    verdict = merge_verdicts(regex_verdict(F.col("_regex")), F.when(accepted, answer["verdict"]))
    hidden = verdict == "DENY"
    result = F.struct(
        verdict.alias("verdict"),
        F.concat("_regex", F.when(accepted, F.coalesce(answer["violations"], none_of(VIOLATION))).otherwise(none_of(VIOLATION))).alias("violations"),
        F.struct(F.lit("regex").alias("classifier"), regex_verdict(F.col("_regex")).alias("verdict"), F.col("_regex").alias("violations")).alias("regex"),
        F.when(accepted, F.struct(F.lit("guard").alias("classifier"), answer["verdict"].alias("verdict"), answer["violations"].alias("violations"))).alias("guard"),
        F.when(~hidden, c).alias("original_content"),
        F.when(~hidden, F.coalesce(F.col("_views.normalized"), c)).alias("normalized_content"),
        F.coalesce(F.col("_views.steps"), none_of(N.STEP)).alias("normalizations"),
        F.struct(F.lit(version).alias("version"), F.lit(sha).alias("sha256")).alias("pack"),
        F.when(c == "", none_of("string")).otherwise(F.concat(F.array(F.lit("normalize"), F.lit("regex")), F.when(accepted, F.array(F.lit("guard"))).otherwise(none_of("string")))).alias("layers"),
        F.when(c != "", F.array(*map(F.lit, bad)) if bad else F.lit(None)).cast("array<string>").alias("unevaluated_patterns"),
    )
    return scanned.withColumn(out, F.when(c.isNotNull(), result)).drop("_folded", "_views", "_regex")


def input_verdict(result: Column) -> Column:
    """INCOMPLETE if the only findings are of patterns that could not run."""
    own = F.filter(result["violations"], lambda v: ~v.type.startswith("PATTERN_NOT_EVALUATED"))
    return F.when((F.size(result["violations"]) > 0) & (F.size(own) == 0) & (result["verdict"] == "VIOLATION"), "INCOMPLETE").otherwise(result["verdict"])


def worst_verdict(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """One row: the worst verdict of all, and the exit code that goes with it (0 clean, 1 findings, 2 incomplete)."""
    worst = df.agg(F.max(severity(F.col(verdict))).alias("w"))
    name = F.when(F.col("w") == 3, "DENY").when(F.col("w") == 2, "VIOLATION").when(F.col("w") == 1, "INCOMPLETE").otherwise("CLEAN")
    return worst.select(name.alias("verdict"), F.when(F.col("w") >= 2, 1).when(F.col("w") == 1, 2).otherwise(0).alias("exit_code"))

