"""Scalar extraction from JSON text with SQL ``json_extract_scalar`` semantics.

``get_json_object`` and ``from_json`` return the text of an object or
array; scalar extraction must return NULL for those.  ``json_struct``
parses a column once into a struct of strings (the fast path);
``scalar_field`` sends only values that look like an object or array to
``json_scalar``, which parses into a VARIANT and checks the value's type.
Everything stays a Catalyst expression (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_json_text(text: Column) -> Column:
    """JSON text -> VARIANT; malformed or NULL text gives NULL."""
    return F.try_parse_json(text)


def json_scalar(parsed: Column, path: str) -> Column:
    """Scalar at ``path`` of a parsed VARIANT as a string.

    Object / array values and JSON null give NULL; numbers and booleans give
    their text form; strings are returned without quotes.
    """
    field = F.try_variant_get(parsed, path, "variant")
    kind = F.schema_of_variant(field)
    return (
        F.when(field.isNull(), F.lit(None).cast("string"))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(None).cast("string"))
        .otherwise(F.try_variant_get(parsed, path, "string"))
    )


def json_struct(text: Column, keys: list[str]) -> Column:
    """Parse JSON text once into a struct of string fields (object values keep their text)."""
    schema = "struct<" + ", ".join(f"`{k}`: string" for k in keys) + ">"
    return F.from_json(text, schema)


def scalar_field(parsed: Column, text: Column, key: str) -> Column:
    """Field ``key`` of ``json_struct`` output with scalar semantics.

    ``from_json`` returns object / array values as their JSON text; only
    values that begin with ``{`` or ``[`` take the exact VARIANT path of
    ``json_scalar`` (CASE branches are lazy, ordinary rows never do).
    """
    value = parsed.getField(key)
    suspicious = value.startswith("{") | value.startswith("[")
    return F.when(suspicious, json_scalar(parse_json_text(text), f"$.{key}")).otherwise(value)
