"""Risk context of an agent: trust, signals and a recommendation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trust_score(level: Column) -> Column:
    return F.coalesce(level, F.lit(0)) * 25


def aggregate_score(level: Column, scores: Column) -> Column:
    """Trust alone without signals, else six tenths of it and four of their mean."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, trust_score(level) * 0.6 + mean * 0.4).otherwise(trust_score(level).cast("double"))


def recommendation(score: Column) -> Column:
    return F.when(score >= 70, "ALLOW").when(score >= 40, "ELEVATED_SCRUTINY").otherwise("DENY")


def sensitivity(level: Column) -> Column:
    """How much an anomaly counts at a level of trust."""
    return F.when(level == 1, 1.35).when(level == 2, 1.15).when(level == 3, 1.0).when(level == 4, 0.8).otherwise(1.0)


def behavioural(agent: Column) -> Column:
    """A behavioural-risk answer for an agent: the service behind it states one score for all. Null without an agent."""
    return F.when(agent.isNotNull(), F.struct(agent.alias("agent_id"), F.lit(50).alias("risk_score")))


def assembled(level: Column, signals: Column) -> Column:
    """(signals, aggregate_score, recommendation) of signals (name, score)."""
    score = aggregate_score(level, F.transform(signals, lambda s: s.score))
    return F.struct(signals.alias("signals"), score.alias("aggregate_score"), recommendation(score).alias("recommendation"))
