"""Declarative predicates: condition trees compiled to boolean columns.

A compiled condition is an ordinary Column, so Catalyst folds it, pushes it to the scan and keeps
it inside generated code.  A missing condition is true; NULL operands and unusable comparisons are
false, except for the two null tests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.scalars import FLOAT_TEXT, clean_key, clean_name, to_float
from vigil.functions.timestamps import parse_iso
from vigil.schema import PAYLOAD

OPERATORS = (
    "EQ", "NE", "GT", "GTE", "LT", "LTE", "IN", "NOT_IN", "CONTAINS", "NOT_CONTAINS",
    "STARTS_WITH", "ENDS_WITH", "REGEX_MATCH", "IS_NULL", "IS_NOT_NULL", "LENGTH_LT",
    "LENGTH_GT", "LOWER_IN",
)
LOGICAL = ("AND", "OR", "NOT")


@dataclass(frozen=True)
class Condition:
    """Leaf (field, operator, value) or branch (logical, children)."""

    field: str | None = None
    operator: str | None = None
    value: Any = None
    logical: str | None = None
    children: tuple["Condition", ...] = ()

    def __post_init__(self) -> None:
        if self.operator is not None and self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.logical is not None and self.logical not in LOGICAL:
            raise ValueError(f"unknown logical operator {self.logical!r}")


def where(field_name: str, operator: str, value: Any = None) -> Condition:
    return Condition(field=field_name, operator=operator, value=value)


def all_of(*children: Condition) -> Condition:
    return Condition(logical="AND", children=children)


def any_of(*children: Condition) -> Condition:
    return Condition(logical="OR", children=children)


def none_of(*children: Condition) -> Condition:
    return Condition(logical="NOT", children=children)


def _is_time_name(path: str) -> bool:
    return path.endswith(("_at", "_time")) or "timestamp" in path or path in ("period_start", "period_end")


def payload_value(payload: Column, path: str) -> Column:
    """Entry of a payload map: exact key if present, else the first key equal after cleaning."""
    wanted = clean_name(path)
    loose = F.get(F.map_values(F.map_filter(payload, lambda k, _: clean_key(k) == F.lit(wanted))), F.lit(0))
    return F.when(F.map_contains_key(payload, F.lit(path)), payload[path]).otherwise(loose)


def field_column(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """Column and type of a field path: event column, dotted payload path, or payload key."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if path in fields:
        return F.col(path), fields[path]
    head, _, rest = path.partition(".")
    if PAYLOAD not in fields:
        return F.lit(None).cast("string"), T.StringType()
    payload = F.col(PAYLOAD)
    if rest and head == PAYLOAD:
        key, _, inner = rest.partition(".")
        value = payload[key] if not inner else F.get_json_object(payload[key], f"$.{inner}")
    elif rest:
        value = F.coalesce(F.get_json_object(payload[head], f"$.{rest}"), payload_value(payload, path))
    else:
        value = payload_value(payload, path)
    if _is_time_name(path):
        return parse_iso(value), T.TimestampType()
    return value, T.StringType()


def _folded(value: Any) -> str:
    return str(value).strip().lower()


def _compare(column: Column, dtype: T.DataType, operator: str, target: Any) -> Column:
    apply = {
        "GT": lambda a, b: a > b,
        "GTE": lambda a, b: a >= b,
        "LT": lambda a, b: a < b,
        "LTE": lambda a, b: a <= b,
    }[operator]
    if isinstance(target, datetime):
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return apply(column, F.lit(target))
        return F.lit(False)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(False)
    numeric_target = re.match(FLOAT_TEXT, str(target).strip()) is not None
    as_text = apply(column, F.lit(target)) if isinstance(target, str) else F.lit(False)
    if isinstance(dtype, T.StringType):
        if not numeric_target:
            return as_text
        number = to_float(column)
        return F.when(number.isNotNull(), apply(number, F.lit(float(target)))).otherwise(as_text)
    if isinstance(dtype, T.NumericType) and numeric_target:
        return apply(column.cast("double"), F.lit(float(target)))
    return F.lit(False)


def _leaf(column: Column, dtype: T.DataType, operator: str, target: Any) -> Column:
    is_text = isinstance(dtype, T.StringType)
    is_container = isinstance(dtype, (T.ArrayType, T.MapType))
    text = column.cast("string") if not is_container else column
    folded = F.lower(F.trim(text)) if not is_container else None
    members = isinstance(target, (list, tuple, set, frozenset))

    if operator in ("IS_NULL", "IS_NOT_NULL"):
        empty = column.isNull()
        if is_text:
            empty = empty | (column == "")
        elif is_container:
            empty = empty | (F.size(column) == 0)
        return empty if operator == "IS_NULL" else ~empty
    if operator in ("EQ", "NE"):
        if is_container:
            equal = F.lit(False)
        elif isinstance(target, datetime):
            equal = column == F.lit(target)
        else:
            equal = folded == F.lit(_folded(target))
        return equal if operator == "EQ" else ~equal
    if operator in ("GT", "GTE", "LT", "LTE"):
        return _compare(column, dtype, operator, target)
    if operator in ("IN", "NOT_IN", "LOWER_IN"):
        if not members:
            if operator == "LOWER_IN":
                return folded == F.lit(_folded(target))
            return F.lit(operator == "NOT_IN") & column.isNotNull()
        inside = folded.isin(*[_folded(t) for t in target]) if target else F.lit(False) & column.isNotNull()
        return ~inside if operator == "NOT_IN" else inside
    if operator in ("CONTAINS", "NOT_CONTAINS"):
        if is_text:
            found = F.contains(F.lower(column), F.lit(str(target).lower()))
        elif isinstance(dtype, T.ArrayType):
            found = F.array_contains(column, target)
        else:  # neither text nor a collection: contains is false, its opposite true
            return F.lit(operator == "NOT_CONTAINS") & column.isNotNull()
        return found if operator == "CONTAINS" else ~found
    if operator == "STARTS_WITH":
        return F.startswith(F.lower(text), F.lit(str(target).lower()))
    if operator == "ENDS_WITH":
        return F.endswith(F.lower(text), F.lit(str(target).lower()))
    if operator == "REGEX_MATCH":
        return text.rlike("(?i)" + str(target))
    length = F.length(column) if is_text else F.size(column) if is_container else F.lit(0)
    length = F.when(column.isNotNull(), length)
    return length < int(target) if operator == "LENGTH_LT" else length > int(target)


def compile_condition(condition: Condition | None, df: DataFrame) -> Column:
    """Boolean column of a condition tree against the columns of `df`; never NULL."""
    if condition is None:
        return F.lit(True)
    if condition.logical and condition.children:
        parts = [compile_condition(child, df) for child in condition.children]
        if condition.logical == "AND":
            return reduce(lambda a, b: a & b, parts)
        either = reduce(lambda a, b: a | b, parts)
        return either if condition.logical == "OR" else ~either
    if not condition.field or condition.operator is None:
        return F.lit(True)
    column, dtype = field_column(df, condition.field)
    return F.coalesce(_leaf(column, dtype, condition.operator, condition.value), F.lit(False))


def listing_filter(
    df: DataFrame,
    equals: dict[str, str | None] | None = None,
    upper_equals: dict[str, str | None] | None = None,
    search: tuple[str, tuple[str, ...]] | None = None,
    period: tuple[str, datetime | None, datetime | None] | None = None,
) -> DataFrame:
    """Optional filters of the listing views; absent values filter nothing."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, value in (upper_equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value.upper())
    if search and search[0]:
        needle = F.lit(search[0].lower())
        df = df.where(
            F.contains(F.lower(F.concat_ws("\u0001", *[F.col(n) for n in search[1]])), needle)
        )
    if period:
        name, start, end = period
        if start is not None:
            df = df.where(F.col(name) >= F.lit(start))
        if end is not None:
            df = df.where(F.col(name) <= F.lit(end))
    return df
