"""Structured values out of model text, as column expressions.

Text is parsed with Spark's variant type: parsing is strict JSON, malformed text
gives null, and the JSON type of a value stays visible (an index sent as the
text "1" is not the number 1).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.text import positive_int, strip


def strip_fences(text: Column) -> Column:
    """Remove a leading and a trailing Markdown fence."""
    body = F.regexp_replace(strip(text), r"(?i)^```(?:json)?\s*", "")
    return F.regexp_replace(body, r"\s*```$", "")


def fenced_body(text: Column) -> Column:
    """What stands between the first two fences, if the text opens with one."""
    body = strip(text)
    inner = F.try_element_at(F.split(body, "```"), F.lit(2))
    return F.when(
        body.startswith("```"), strip(F.regexp_replace(inner, "^json", ""))
    ).otherwise(body)


def json_object(text: Column) -> Column:
    """The outermost ``{...}`` of a model answer as a variant, else null."""
    block = F.regexp_extract(strip_fences(text), r"(?s)\{.*\}", 0)
    return F.when(block != "", F.try_parse_json(block))


def json_field(value: Column, name: str) -> Column:
    """A top-level field as text; null if absent."""
    return F.try_variant_get(value, f"$.{name}", "string")


def json_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def json_items(value: Column, path: str = "$") -> Column:
    """The objects of an array at ``path``; other elements are left out."""
    items = F.coalesce(
        F.try_variant_get(value, path, "array<variant>"),
        F.array().cast("array<variant>"),
    )
    return F.filter(items, lambda item: json_type(item).startswith("OBJECT"))


def _is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")


def json_year(item: Column, name: str) -> Column:
    """A positive year: numbers are truncated, text must be an integer."""
    kind = json_type(_field(item, name))
    number = F.try_variant_get(item, f"$.{name}", "double").try_cast("int")
    text = F.try_variant_get(item, f"$.{name}", "string")
    return (
        F.when(_is_number(kind), F.when(number > 0, number))
        .when(kind == "STRING", positive_int(text))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit(1)))
    )


def json_index(item: Column, name: str) -> Column:
    """An index sent as a whole number, else null."""
    number = F.try_variant_get(item, f"$.{name}", "double")
    return F.when(
        _is_number(json_type(_field(item, name))) & (number == F.floor(number)),
        number.try_cast("int"),
    )


def json_truthy(item: Column, name: str) -> Column:
    """Whether Python would take the field as true."""
    kind = json_type(_field(item, name))
    text = F.try_variant_get(item, f"$.{name}", "string")
    number = F.try_variant_get(item, f"$.{name}", "double")
    return F.coalesce(
        F.when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(_is_number(kind), number != 0)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~text.isin("{}", "[]")),
        F.lit(False),
    )


def json_spells(text: Column) -> Column:
    """A JSON array of spells to ``array<struct<start_year,end_year,position>>``.

    No array, or a malformed one, gives the empty array.
    """
    block = F.regexp_extract(strip_fences(text), r"(?s)\[.*\]", 0)
    items = json_items(F.when(block != "", F.try_parse_json(block)))
    return F.transform(
        items,
        lambda item: F.struct(
            json_year(item, "start_year").alias("start_year"),
            json_year(item, "end_year").alias("end_year"),
            json_field(item, "position").alias("position"),
        ),
    )
