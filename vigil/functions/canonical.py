"""Canonical JSON and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.scalars import c

EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of nothing


def sha256(value: Column | str) -> Column:
    return F.sha2(c(value), 256)


def _quote(text: Column) -> Column:
    """JSON string literal; to_json does the escaping."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def ascii_escaped(text: Column) -> Column:
    """Characters beyond ASCII as JSON escapes of their UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), 1)
    shown = F.transform(units, lambda u: F.when(
        u < "0080", F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.array_join(shown, "")).otherwise(text)


def json_text(value: Column | str, ascii: bool = True) -> Column:
    """JSON literal of a text; with `ascii`, which sealed digests use, only ASCII characters are written."""
    quoted = _quote(c(value))
    return F.when(c(value).isNull(), F.lit("null")).otherwise(ascii_escaped(quoted) if ascii else quoted)


def json_number(value: Column | str) -> Column:
    return F.coalesce(c(value).cast("string"), F.lit("null"))


def json_array(value: Column | str, sort: bool = False) -> Column:
    items = F.coalesce(c(value), F.array().cast("array<string>"))
    if sort:
        items = F.array_sort(items)
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(items, json_text)), F.lit("]"))


def json_map(value: Column | str) -> Column:
    """Map with text values, keys sorted, compact separators."""
    entries = F.array_sort(F.map_entries(F.coalesce(c(value), F.create_map().cast("map<string,string>"))))
    body = F.transform(
        entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"]))
    )
    return F.concat(F.lit("{"), F.concat_ws(",", body), F.lit("}"))


def json_object(**members: Column) -> Column:
    """Object of already encoded members, keys sorted."""
    parts = [F.concat(F.lit(f'"{key}":'), members[key]) for key in sorted(members)]
    body = parts[0]
    for part in parts[1:]:
        body = F.concat(body, F.lit(","), part)
    return F.concat(F.lit("{"), body, F.lit("}"))
