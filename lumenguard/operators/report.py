"""Reports over scanned inputs: findings by place, counts by type, JSON lines, and a text for people."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import line_column
from ..functions.shown import not_evaluated_lines
from .classify import severity

MASK, MOST_LISTED = "•••", 50


def located(df: DataFrame, text: str, violations: str, keys: list[str]) -> DataFrame:
    """One row for each finding with its line and column in the original text, in the order of the input; unplaced ones come last."""
    rows = df.select(*keys, F.col(text).alias("_t"), F.posexplode(violations).alias("pos", "f"))
    return rows.select(*keys, "pos", F.col("f.type").alias("type"), F.col("f.confidence").alias("confidence"), F.col("f.classifier").alias("classifier"), F.col("f.view").alias("view"), line_column(F.col("_t"), F.col("f.original_start")).alias("p")).select(*keys, "pos", "type", "confidence", "classifier", "view", "p.line", "p.column")


def listing(violations: Column, most: int = MOST_LISTED) -> Column:
    return F.slice(violations, 1, most)


def listed(rows: DataFrame, keys: list[str], order: list[Column | str], most: int = MOST_LISTED) -> DataFrame:
    """``listing`` over a table of findings: the first ``most`` rows of each of ``keys`` in ``order``. Each task leaves out all but its own first ones before rows are put together."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def counts_by_type(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, n, first): most first, equals by first appearance; order by n desc, first."""
    return rows.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def json_rows(df: DataFrame, source: str, size: str, text: str, result: str) -> DataFrame:
    """One JSON text for each input."""
    r = F.col(result)
    finding = lambda v: F.struct(v.type.alias("type"), F.lit(MASK).alias("maskedValue"), v.confidence.alias("confidence"), v.classifier.alias("classifier"), v.view.alias("view"), line_column(F.col(text), v.original_start)["line"].alias("line"), line_column(F.col(text), v.original_start)["column"].alias("column"))
    return df.select(F.to_json(F.struct(F.col(source).alias("source"), F.col(size).alias("bytes"), r["verdict"].alias("verdict"), r["guard"].isNotNull().alias("guardActive"), r["layers"].alias("layers"), r["unevaluated_patterns"].alias("notEvaluated"), F.transform(r["violations"], finding).alias("findings"))).alias("json"))


def wire(result: Column) -> Column:
    """A result as JSON in the camel-case shape of the library's answers."""
    v = lambda x: F.struct(x.type.alias("type"), x.value.alias("value"), x.start.alias("start"), x.end.alias("end"), x.confidence.alias("confidence"), x.classifier.alias("classifier"), x.view.alias("view"), x.original_start.alias("originalStart"), x.original_end.alias("originalEnd"))
    return F.to_json(F.struct(result["verdict"].alias("verdict"), F.transform(result["violations"], v).alias("violations"), result["original_content"].alias("originalContent"), result["normalized_content"].alias("normalizedContent"), result["normalizations"].alias("normalizations"), result["pack"].alias("pack"), result["layers"].alias("layers")))


def totals(df: DataFrame, verdict: str, violations: str) -> DataFrame:
    """One row: inputs, findings without those of patterns that could not run, inputs with such, and the worst rank."""
    own = F.filter(F.col(violations), lambda v: ~v.type.startswith("PATTERN_NOT_EVALUATED"))
    return df.agg(F.count(F.lit(1)).alias("inputs"), F.coalesce(F.sum(F.size(own)), F.lit(0)).cast("long").alias("findings"), F.count_if(F.size(own) < F.size(F.col(violations))).alias("not_evaluated"), F.max(severity(F.col(verdict))).alias("worst"))


def human(rows: list[dict], verdict: str) -> str:
    """Text for a terminal, of inputs (source, verdict, findings)."""
    lines = []
    for r in rows:
        lines.append(f"{r['source']}: {r['verdict']}")
        found = [f for f in r["findings"] if not f["type"].startswith("PATTERN_NOT_EVALUATED")]
        lines += [f"  {f['line']}:{f['column']} {f['type']} {MASK} ({f['confidence']:.2f})" if f.get("line") else f"  - {f['type']} {MASK}" for f in found[:MOST_LISTED]]
        rest: dict[str, int] = {}
        for f in found[MOST_LISTED:]:
            rest[f["type"]] = rest.get(f["type"], 0) + 1
        if rest:
            lines.append("  ... " + ", ".join(f"{n} more {t}" for t, n in sorted(rest.items(), key=lambda x: -x[1])))
        lines += not_evaluated_lines(r.get("notEvaluated") or [])
    return "\n".join([*lines, f"Verdict: {verdict}"])


def human_from_json(texts: list[str], verdict: str) -> str:
    return human([json.loads(t) for t in texts], verdict)
