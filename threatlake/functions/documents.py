"""Typed reading of JSON text.

``from_json`` with a typed schema already refuses the wrong kind of value: a quoted ``"80"`` or
``80.0`` is no BIGINT, a boolean is no DOUBLE, a text is no array or map, and each becomes NULL.
Only STRING takes any kind, so plain texts are declared VARIANT and asked for their kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: JSON and nothing else: no single quotes, no bare NaN
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def object_keys(text: Column) -> Column:
    """Names in a JSON object, NULL when ``text`` is not exactly one JSON object.

    The parsers stop after the first value, so the text is read as the only element of an array,
    where anything behind the object breaks the syntax or makes a second element.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string, string>>", _STRICT)
    keys = F.map_keys(F.get(listed, F.lit(0)))
    alone = (F.size(listed) == 1) & text.rlike(r"\}\s*$")
    return F.when(alone & (F.size(keys) == F.size(F.array_distinct(keys))), keys)


def unpack(df: DataFrame, text: Column, schema: str) -> DataFrame:
    """Add ``__keys`` (see ``object_keys``) and ``__doc``."""
    return df.withColumns({"__keys": object_keys(text), "__doc": F.from_json(text, schema)})


def plain_text(value: Column) -> Column:
    """Content of a VARIANT that holds a string; NULL for other kinds."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def document_text(answer: Column) -> Column:
    """JSON object inside an answer text: the whole text, else the last fenced block that parses."""

    def is_object(text: Column) -> Column:
        return object_keys(text).isNotNull()

    fenced = F.regexp_extract_all(answer, F.lit("(?i)```(?:json)?\\s*([\\s\\S]*?)\\s*```"), F.lit(1))
    whole = F.regexp_replace(answer, r"^\s+|\s+$", "")
    return F.when(is_object(whole), whole).otherwise(F.try_element_at(F.filter(fenced, is_object), F.lit(-1)))
