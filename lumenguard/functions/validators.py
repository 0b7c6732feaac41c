"""Validators of captured values, as columns. A null value is not valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from .dual import F


def _stripped(v: Column) -> Column:
    return F.regexp_replace(v, r"[\s-]", "")


def luhn_check(v: Column) -> Column:
    """Digits with white space and hyphens between, and a right check digit."""
    digits = _stripped(v)
    return F.coalesce(digits.rlike(r"\A[0-9]+\z") & F.call_function("luhn_check", digits), F.lit(False))


def ssn_area(v: Column) -> Column:
    part = lambda i: F.get(F.split(v, "-"), F.lit(i))
    area = part(0).try_cast("int")
    return F.coalesce((F.size(F.split(v, "-")) == 3) & ~area.isin(0, 666) & (area < 900) & (part(1) != "00") & (part(2) != "0000"), F.lit(False))


def luhn(v: Column) -> Column:
    """A card number: 13 to 19 digits, check digit and an issuer's prefix."""
    d = _stripped(v)
    first = lambda n: F.substring(d, 1, n).try_cast("int")
    issuer = d.startswith("4") | first(2).between(51, 55) | first(4).between(2221, 2720) | first(2).isin(34, 37, 65) | (first(4) == 6011) | first(3).between(644, 649)
    return F.coalesce(F.length(d).between(13, 19) & luhn_check(v) & issuer, F.lit(False))


def mod97(v: Column) -> Column:
    plain = F.upper(F.regexp_replace(v, r"\s", ""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int"))
    step = lambda acc, c: F.when(c.rlike("[A-Z]"), acc * 100 + value(c)).otherwise(acc * 10 + value(c)) % 97
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.coalesce(F.length(plain).between(15, 34) & plain.rlike(r"\A[A-Z0-9]+\z") & (rest == 1), F.lit(False))


def npi_luhn(v: Column) -> Column:
    return F.coalesce(v.rlike(r"\A[0-9]{10}\z") & F.call_function("luhn_check", F.concat(F.lit("80840"), v)), F.lit(False))


def not_empty_assignment_target(v: Column) -> Column:
    """False for ``NAME=``: the next line's key, taken for this one's value."""
    return F.coalesce(~v.rlike(r"\A[A-Z][A-Z0-9_]*=\z"), F.lit(False))


def contains_digit(v: Column) -> Column:
    return F.coalesce(v.rlike("[0-9]"), F.lit(False))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "none": lambda v: F.lit(True),
    "ssnArea": ssn_area,
    "luhn": luhn,
    "mod97": mod97,
    "npiLuhn": npi_luhn,
    "notEmptyAssignmentTarget": not_empty_assignment_target,
    "containsDigit": contains_digit,
}
