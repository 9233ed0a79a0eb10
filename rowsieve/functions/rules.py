"""Validation rules: each gives the reason a value fails, or null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowsieve.functions.text import or_empty, utrim
from rowsieve.spec import Validation

# Accepted address pattern and length bounds.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
EMAIL_MIN, EMAIL_MAX = 5, 320
# The reasons.
EMPTY = "'{}' is empty"
EMPTY_EMAIL = "'{}' is empty (expected email)"
BAD_LENGTH = "'{}' length out of range"
BAD_FORMAT = "'{}' is not a valid email format"


def rule_not_empty(value: Column, name: str) -> Column:
    return F.when(value == "", F.lit(EMPTY.format(name)))


def rule_email(value: Column, name: str) -> Column:
    return (
        F.when(value == "", F.lit(EMPTY_EMAIL.format(name)))
        .when(~F.length(value).between(EMAIL_MIN, EMAIL_MAX), F.lit(BAD_LENGTH.format(name)))
        .when(~value.rlike(EMAIL_PATTERN), F.lit(BAD_FORMAT.format(name)))
    )


def reason(value: Column, name: str, validation: Validation, extra=()) -> Column:
    """First failing rule's reason. ``extra`` takes further ``(value, name) -> reason`` rules."""
    trimmed = utrim(or_empty(value))
    rules = []
    if Validation.NOT_EMPTY in validation:
        rules.append(rule_not_empty)
    if Validation.EMAIL in validation:
        rules.append(rule_email)
    reasons = [rule(trimmed, name) for rule in (*rules, *extra)]
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
