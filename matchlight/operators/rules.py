"""Declared validation rules compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and closed lists of the logical types.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "case_number": r"[A-Z0-9\-_]+",
    "url": r"https?://[^ ]+",
}
TRUE_WORDS = ("true", "1", "yes", "on", "si")
FALSE_WORDS = ("false", "0", "no", "off")


@dataclass(frozen=True)
class Rule:
    field: str
    type: str = "string"
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None
    custom: Callable[[Column], Column] | None = None


CASE_RULES = (
    Rule("case_number", "case_number", True, 3, 20, pattern=PATTERNS["case_number"]),
    Rule("investigator", required=True, min_length=2, max_length=50),
    Rule("weapon_type", allowed=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")),
    Rule("date_created", "date", True),
)
IMAGE_RULES = (
    Rule("evidence_type", required=True, min_length=1, max_length=255),
    Rule("status", allowed=("O", "F")),
    Rule("file_size", "float", min_value=1, max_value=300000),
)


def sanitize(c: Column) -> Column:
    """Control characters removed, white space squeezed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"[ \t\n\r]+", " "))


def coerce(c: Column, kind: str) -> Column:
    """The value in the rule's type; null where it cannot be converted."""
    text = F.trim(c.cast("string"))
    if kind == "integer":
        return text.try_cast("bigint")
    if kind == "float":
        return text.try_cast("double")
    if kind == "boolean":
        return F.when(F.lower(text).isin(*TRUE_WORDS), True).when(F.lower(text).isin(*FALSE_WORDS), False)
    if kind in ("date", "datetime"):
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")])
    return text


def errors(rule: Rule) -> Column:
    """Array of ``(field, message, severity)`` of one rule; an empty optional field passes."""
    raw = F.col(rule.field)
    text = sanitize(raw.cast("string"))
    empty = raw.isNull() | (text == "")
    checks: list[tuple[Column, str]] = []
    if rule.type != "string":
        checks.append((coerce(text, rule.type).isNull() if rule.type in ("integer", "float", "boolean", "date", "datetime") else F.lit(False), "wrong type"))
    if rule.min_length is not None:
        checks.append((F.char_length(text) < rule.min_length, "too short"))
    if rule.max_length is not None:
        checks.append((F.char_length(text) > rule.max_length, "too long"))
    number = text.try_cast("double")
    if rule.min_value is not None:
        checks.append((number < rule.min_value, "too small"))
    if rule.max_value is not None:
        checks.append((number > rule.max_value, "too large"))
    if rule.pattern is not None:
        checks.append((~text.rlike(f"(?i)^{rule.pattern}"), "wrong pattern"))
    if rule.allowed is not None:
        checks.append((~raw.cast("string").isin(*rule.allowed), "not allowed"))
    if rule.custom is not None:
        checks.append((~rule.custom(raw), "custom rule"))
    one = lambda message: F.struct(F.lit(rule.field).alias("field"), F.lit(message).alias("message"), F.lit("error").alias("severity"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), one(m)) for bad, m in checks])) if checks else F.array()
    none = F.array().cast("array<struct<field:string,message:string,severity:string>>")
    missing = F.array(one("required")) if rule.required else none
    return F.when(empty, missing).otherwise(found if checks else none)


def validate(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``df`` with ``errors`` and ``is_valid``."""
    return df.withColumn("errors", F.concat(*[errors(r) for r in rules])).withColumn("is_valid", F.size("errors") == 0)


def summary(validated: DataFrame) -> DataFrame:
    """Errors by severity, field and message."""
    return validated.select(F.explode("errors").alias("e")).groupBy("e.severity", "e.field", "e.message").agg(F.count(F.lit(1)).alias("n"))


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and refused rows with their joined messages."""
    bad = validated.where(~F.col("is_valid")).withColumn("reason", F.array_join(F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["message"])), "; "))
    return validated.where("is_valid").drop("errors", "is_valid"), bad.drop("errors", "is_valid")
