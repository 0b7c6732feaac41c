"""Policy packs: rules that deny or warn by the types of findings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import none_of
from .scan import VIOLATION

ACTIONS = ("DENY", "WARN", "REDACT")
SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    patterns: tuple[str, ...]
    action: str
    severity: str = "high"
    description: str = ""


@dataclass(frozen=True)
class Policy:
    name: str
    version: str
    rules: tuple[Rule, ...]


#: The policy in force where none is named.
DEFAULT = Policy(
    "default",
    "1.0.0",
    (
        Rule("deny-ssn", "Social Security number", ("SSN",), "DENY", "critical"),
        Rule("deny-pan", "Payment card number", ("PAN",), "DENY", "critical"),
        Rule("deny-credential", "Credential", ("CREDENTIAL",), "DENY", "critical"),
        Rule("deny-cui", "Controlled unclassified information", ("CUI",), "DENY", "critical"),
        Rule("deny-iban", "Bank account number", ("IBAN",), "DENY", "high"),
        Rule("deny-mrn", "Medical record number", ("MRN",), "DENY", "high"),
        Rule("warn-npi", "Provider identifier", ("NPI",), "WARN", "medium"),
    ),
)
PACKS = {"default": DEFAULT}


def load(name: str | None = None) -> Policy:
    try:
        return PACKS["default" if name is None else name]
    except (KeyError, TypeError):
        raise TypeError(f"unknown policy pack {name!r}; known: {', '.join(sorted(PACKS))}") from None


def problems(policy: object) -> Iterator[str]:
    if not isinstance(policy, Policy):
        yield f"a policy pack must be a Policy, not {type(policy).__name__}"
        return
    for field in ("name", "version"):
        if not isinstance(getattr(policy, field), str) or not getattr(policy, field):
            yield f"{field} must be a non-empty string"
    seen: set[str] = set()
    for i, r in enumerate(policy.rules):
        at = f"rules[{i}]"
        if not isinstance(r, Rule):
            yield f"{at} must be a Rule"
            continue
        if not isinstance(r.id, str) or not r.id:
            yield f"{at}.id must be a non-empty string"
        elif r.id in seen:
            yield f"{at}.id {r.id!r} occurs twice"
        seen.add(r.id)
        if not isinstance(r.name, str) or not r.name:
            yield f"{at}.name must be a non-empty string"
        if r.action not in ACTIONS:
            yield f"{at}.action must be one of {', '.join(ACTIONS)}"
        if r.severity not in SEVERITIES:
            yield f"{at}.severity must be one of {', '.join(SEVERITIES)}"
        if isinstance(r.patterns, str) or not r.patterns or not all(isinstance(p, str) and p for p in r.patterns):
            yield f"{at}.patterns must be non-empty strings"


def checked(policy: Policy, most: int = 10) -> Policy:
    """The policy, or a TypeError with the first problems and the number of the rest."""
    found = problems(policy)
    if first := list(islice(found, most)):
        more = sum(1 for _ in found)
        raise TypeError("; ".join(first) + (f"; and {more} more" if more else ""))
    return policy


def added(type_: Column, value: Column, confidence: Column | float = 1.0) -> Column:
    """A finding that stands for a decision and has no place in the text."""
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    null = lambda t: F.lit(None).cast(t)
    return F.struct(type_.alias("type"), value.alias("value"), F.lit(0).alias("start"), F.lit(0).alias("end"), c.cast("double").alias("confidence"), F.lit("regex").alias("classifier"), null("string").alias("view"), null("int").alias("original_start"), null("int").alias("original_end"))


def apply(verdict: Column, violations: Column, policy: Policy = DEFAULT) -> Column:
    """(verdict, violations). Rules look at the types found before any of them, so none sets off another; REDACT rules do nothing here."""
    checked(policy)
    types = F.transform(violations, lambda v: v.type)
    extra, denied = [], F.lit(False)
    for r in policy.rules:
        if r.action == "REDACT":
            continue
        hit = F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(p) for p in r.patterns])), F.lit(False))
        extra.append(F.when(hit, F.array(added(F.lit(f"POLICY_{r.action}:{r.id}"), F.lit(r.name)))).otherwise(none_of(VIOLATION)))
        if r.action == "DENY":
            denied |= hit
    all_ = F.concat(violations, *extra) if extra else violations
    return F.struct(F.when(denied, "DENY").otherwise(verdict).alias("verdict"), all_.alias("violations"))
