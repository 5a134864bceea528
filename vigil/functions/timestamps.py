"""Timestamp parsing: epoch numbers, ISO-8601 and the accepted fallback layouts, all to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.scalars import c

EPOCH_MILLIS_ABOVE = 100_000_000_000
LAST_EPOCH_MILLIS = 253_402_300_799_999  # end of year 9999

# Layouts tried after ISO-8601, in this order (day first before month first).
FALLBACK_LAYOUTS = (
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss",
)
ISO_TEXT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
ISO_BASIC_TEXT = r"^\d{8}T\d{6}$"
RFC_TEXT = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC)$"

# Strptime directives and their Java pattern letters.
STRPTIME_TO_JAVA = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh", "%z": "xx", "%Z": "z", "%j": "DDD",
}


def java_layout(strptime_layout: str) -> str:
    """Spark datetime pattern of a strptime layout; letters outside directives are quoted."""
    out, i = "", 0
    while i < len(strptime_layout):
        token = strptime_layout[i : i + 2]
        if token in STRPTIME_TO_JAVA:
            out += STRPTIME_TO_JAVA[token]
            i += 2
        elif token.startswith("%"):
            raise ValueError(f"unsupported directive {token!r}")
        else:
            ch = strptime_layout[i]
            out += f"'{ch}'" if ch.isalpha() else ch
            i += 1
    return out


def parse_iso(value: Column | str) -> Column:
    text = F.trim(c(value))
    zoned = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    extended = F.when(text.rlike(ISO_TEXT), zoned.try_cast("timestamp"))
    basic = F.when(text.rlike(ISO_BASIC_TEXT), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))
    return F.coalesce(extended, basic)


def parse_timestamp(value: Column | str, layouts: Column | dict[str, Column] | None = None) -> Column:
    """UTC timestamp of a raw text value, NULL when no layout fits.

    `layouts` maps a custom strptime layout to the condition under which it applies; it is tried
    after epoch numbers and before ISO-8601.
    """
    text = F.trim(c(value))
    number = F.when(text.rlike(r"^\d{1,17}$"), text.try_cast("bigint"))
    epoch = F.when(
        number.between(EPOCH_MILLIS_ABOVE + 1, LAST_EPOCH_MILLIS), F.timestamp_millis(number)
    ).when(number <= EPOCH_MILLIS_ABOVE, F.timestamp_seconds(number))
    custom = [
        F.when(condition, F.try_to_timestamp(text, F.lit(java_layout(layout))))
        for layout, condition in (layouts or {}).items()
    ]
    fallbacks = [F.try_to_timestamp(text, F.lit(layout)) for layout in FALLBACK_LAYOUTS]
    rfc = F.when(
        text.rlike(RFC_TEXT),
        F.try_to_timestamp(
            F.regexp_replace(text, r"^[A-Z][a-z]{2}, (\d{1,2} [A-Za-z]{3} \d{4} [0-9:]{8}) .*$", "$1"),
            F.lit("d MMM yyyy HH:mm:ss"),
        ),
    )
    digits = text.rlike(r"^\d+$")
    return F.when(digits, epoch).otherwise(F.coalesce(*custom, parse_iso(value), *fallbacks, rfc))


def is_weekend(ts: Column | str) -> Column:
    return F.weekday(c(ts)) >= 5


def is_night(ts: Column | str) -> Column:
    return (F.hour(c(ts)) < 8) | (F.hour(c(ts)) >= 18)


def is_off_hours(ts: Column | str) -> Column:
    return is_weekend(ts) | is_night(ts)
