"""The library's front door: ``comply`` for tables, with a registry and a policy held by a session."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import policy as P
from .operators import registry as R
from .operators.classify import classify

UNKNOWN_ACTIONS = (None, "violation", "deny")


def comply(
    df: DataFrame,
    text: str,
    *,
    policy: P.Policy | str | None = None,
    registry: R.Registry | None = None,
    package: str | None = None,
    trust_level: Column | None = None,
    on_unknown: str | None = None,
    guard: Column | None = None,
    out: str = "result",
) -> DataFrame:
    """``df`` with a result for each text: classified, then the registry's word on its package, then the policy's.

    A policy applies only if one is given. Content is left out of results that deny.
    """
    if on_unknown not in UNKNOWN_ACTIONS:
        raise TypeError("on_unknown must be 'violation', 'deny' or None")
    done = classify(df, text, out, guard)
    r = F.col(out)
    verdict, violations = r["verdict"], r["violations"]
    signals: Column | None = None
    if package is not None and (registry is not None or on_unknown is not None):
        done = R.lookup(done, package, registry or R.Registry(), "_lookup")
        level = trust_level if trust_level is not None else F.lit(None).cast("int")
        done = done.withColumn("_l2", R.apply(verdict, violations, F.col("_lookup"), F.col(package), level, F.lit(on_unknown).cast("string")))
        known = F.col(package).isNotNull()
        verdict, violations = F.when(known, F.col("_l2.verdict")).otherwise(verdict), F.when(known, F.col("_l2.violations")).otherwise(violations)
        signals = F.col("_l2.signals")
    if policy is not None:
        done = done.withColumn("_policy", P.apply(verdict, violations, P.load(policy) if isinstance(policy, str) else policy))
        verdict, violations = F.col("_policy.verdict"), F.col("_policy.violations")
    hidden = verdict == "DENY"
    after = r.withField("verdict", verdict).withField("violations", violations)
    for c in ("original_content", "normalized_content"):
        after = after.withField(c, F.when(~hidden, r[c]))
    if signals is not None:
        after = after.withField("registry_signals", signals)
    return done.withColumn(out, F.when(r.isNotNull(), after)).drop("_lookup", "_l2", "_policy")


class Session:
    """Holds a registry's tables; they are loaded on first use and again when older than ``ttl_ms``. Threads that ask at once wait for one load."""

    def __init__(self, load: Callable[[], R.Registry], now: Callable[[], int], ttl_ms: int = 300_000) -> None:
        self._load, self._now, self._ttl = load, now, ttl_ms
        self._held: tuple[R.Registry, int] | None = None
        self._loading = threading.Lock()

    def registry(self) -> R.Registry:
        with self._loading:
            if self._held is None or self._now() - self._held[1] > self._ttl:
                self._held = self._load(), self._now()
            return self._held[0]

    def clear(self) -> None:
        self._held = None

    def comply(self, df: DataFrame, text: str, **options: object) -> DataFrame:
        return comply(df, text, registry=options.pop("registry", None) or self.registry(), **options)
