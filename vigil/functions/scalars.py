"""Scalar expressions shared by the operators. All are built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def non_blank(value: Column | str) -> Column:
    """NULL for the empty string, so that coalesce() picks the first usable text."""
    return F.nullif(c(value), F.lit(""))


def first_of(*values: Column | str) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[non_blank(v) for v in values])


def clean_key(value: Column | str) -> Column:
    """Field names compare case-folded and without `_`, space and `-`."""
    return F.translate(F.lower(c(value)), "_ -", "")


def clean_name(name: str) -> str:
    return name.lower().replace("_", "").replace(" ", "").replace("-", "")


# Numeric text accepted as a float.
FLOAT_TEXT = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
SPECIAL_FLOAT_TEXT = r"(?i)^[+-]?(inf|infinity|nan)$"


def is_float_text(value: Column | str) -> Column:
    text = F.trim(c(value))
    return text.rlike(FLOAT_TEXT) | text.rlike(SPECIAL_FLOAT_TEXT)


def to_float(value: Column | str) -> Column:
    """Finite number in the text, or NULL."""
    text = F.trim(c(value))
    return F.when(text.rlike(FLOAT_TEXT), F.regexp_replace(text, "_", "").try_cast("double"))


# Severity words and codes.
SEVERITY_WORDS = {
    "CRITICAL": ("5", "p1", "p1_critical", "critical", "crit", "fatal"),
    "HIGH": ("4", "p2", "p2_high", "high", "major"),
    "MEDIUM": ("3", "p3", "p3_medium", "medium", "med", "moderate", "warning", "warn"),
    "LOW": ("2", "p4", "p4_low", "low", "minor"),
    "INFORMATIONAL": ("1", "0", "p5", "info", "informational", "notice", "debug"),
}


def normalize_severity(
    value: Column | str, custom: Column | None = None, default: Column | str = "MEDIUM"
) -> Column:
    """Severity tier of a raw value; `custom` is an optional map<string,string> with lower-case keys."""
    key = F.lower(F.trim(c(value)))
    fallback = F.lit(default) if isinstance(default, str) else default
    standard = reduce(
        lambda acc, item: acc.when(key.isin(*item[1]), F.lit(item[0])),
        SEVERITY_WORDS.items(),
        F.when(F.lit(False), F.lit(None)),
    )
    if custom is None:
        return F.when(c(value).isNotNull(), F.coalesce(standard, fallback))
    chosen = F.upper(custom[key])
    return F.when(
        c(value).isNotNull(),
        F.coalesce(F.when(chosen.isin(*SEVERITY_WORDS), chosen), standard, fallback),
    )


def normalize_status(value: Column | str, default: str = "OPEN") -> Column:
    return F.coalesce(non_blank(F.upper(F.trim(c(value)))), F.lit(default))


# Words read as true.
TRUE_WORDS = ("true", "1", "t", "yes", "y", "enabled")


def cast_boolean(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(c(value).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def severity_of_score(score: Column | str) -> Column:
    s = c(score)
    return (
        F.when(s >= 85, "CRITICAL").when(s >= 70, "HIGH").when(s >= 40, "MEDIUM").otherwise("LOW")
    )


def risk_tier(score: Column | str) -> Column:
    s = c(score)
    return (
        F.when(s <= 25.0, "LOW")
        .when(s <= 50.0, "GUARDED")
        .when(s <= 75.0, "ELEVATED")
        .otherwise("CRITICAL")
    )


def trend(current: Column | str, previous: Column | str) -> Column:
    delta = c(current) - c(previous)
    return (
        F.when(delta > 2.0, "DETERIORATING").when(delta < -2.0, "IMPROVING").otherwise("STABLE")
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return seconds_between(later, earlier) / F.lit(3600.0)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional seconds, microsecond-exact."""
    return (F.unix_micros(c(later)) - F.unix_micros(c(earlier))) / F.lit(1e6)


def one_decimal(value: Column | str) -> Column:
    return F.format_string("%.1f", c(value))


def text_of(value: Column | str, missing: str) -> Column:
    return F.coalesce(non_blank(c(value).cast("string")), F.lit(missing))


def stable_id(*parts: Column | str) -> Column:
    """Deterministic uuid-shaped id of the parts: reruns and retried tasks give the same id."""
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(c(p).cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )
