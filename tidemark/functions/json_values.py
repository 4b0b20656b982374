"""JSON text as Spark columns.

Values travel as canonical JSON text (sorted keys, normalised numbers), which
can be compared and grouped; VARIANT cannot. Parsing is forgiving: text that
is not a JSON object has no fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_MAP = "map<string,variant>"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def variant(text: Column | str) -> Column:
    """Parsed JSON, NULL when the text is not JSON."""
    return F.try_parse_json(_col(text))


def object_fields(text: Column | str) -> Column:
    """Top-level fields as MAP<STRING, VARIANT>, empty for anything but an object."""
    return F.coalesce(
        F.try_variant_get(variant(text), "$", FIELD_MAP),
        F.expr(f"cast(map() as {FIELD_MAP})"),
    )


def alike(names: Sequence[str]) -> bool:
    """Whether names differ in case only; Spark does not tell such members of a STRUCT apart."""
    return len({n.lower() for n in names}) < len(names)


def object_parts(text: Column | str, names: Sequence[str]) -> Column:
    """The named top-level fields of a JSON object, taken out in one go, for ``part_json``."""
    if alike(names) or not names:
        return object_fields(text)
    quoted = ",".join(f"`{n.replace('`', '``')}` variant" for n in names)
    return F.try_variant_get(variant(text), "$", f"struct<{quoted}>")


def part_json(parts: str, number: int, names: Sequence[str]) -> Column:
    """Canonical JSON of the field of that number, NULL when absent."""
    if alike(names):
        return field_json(F.col(parts), names[number])
    return F.to_json(F.col(parts).getField(names[number]))


def is_object(text: Column | str) -> Column:
    return F.try_variant_get(variant(text), "$", FIELD_MAP).isNotNull()


def canonical(text: Column | str) -> Column:
    """Canonical JSON text, NULL when the text is not JSON."""
    return F.to_json(variant(text))


def json_string(text: Column | str) -> Column:
    """A string as a JSON literal; NULL becomes ``null``."""
    text = _col(text)
    # names and numbers, the usual case, need no escaping
    return (
        F.when(text.rlike(r"\A[A-Za-z0-9_.:/@ -]*\z"), F.concat(F.lit('"'), text, F.lit('"')))
        .when(text.isNull(), "null")
        .otherwise(F.to_json(text.cast("variant")))
    )


def field_json(fields: Column, key: Column | str) -> Column:
    """Canonical JSON of one field: ``null`` when present and null, NULL when absent."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.when(
        F.map_contains_key(fields, key),
        F.coalesce(F.to_json(F.element_at(fields, key)), F.lit("null")),
    )


def field_of(parsed: Column, name: str) -> Column:
    """Canonical JSON of one field of a parsed document, without building the others.

    ``null`` when present and null, NULL when absent or not in an object.
    """
    path = "$." + name if name.isidentifier() and name.isascii() else "$['" + name + "']"
    return F.to_json(F.try_variant_get(parsed, path, "variant"))


def kind(value_json: Column) -> Column:
    """string, object, array, boolean, null or number, from canonical text."""
    head = F.substring(value_json, 1, 1)
    return (
        F.when(head == '"', "string")
        .when(head == "{", "object")
        .when(head == "[", "array")
        .when(head.isin("t", "f"), "boolean")
        .when(head == "n", "null")
        .when(value_json.isNotNull(), "number")
    )


def is_number(value_json: Column) -> Column:
    return value_json.rlike(r"^-?[0-9]")


def number(value_json: Column) -> Column:
    """The value as DOUBLE when it is a JSON number (a quoted number is text)."""
    return F.when(is_number(value_json), value_json.try_cast("double"))


def text(value_json: Column) -> Column:
    """Plain text of a value: unquoted for strings, JSON text otherwise."""
    return F.when(
        F.substring(value_json, 1, 1) == '"',
        F.try_variant_get(F.try_parse_json(value_json), "$", "string"),
    ).otherwise(value_json)


def object_text(entries: Column) -> Column:
    """JSON object text from ARRAY<STRUCT<key, value_json>>, keys sorted."""
    rendered = F.transform(
        F.array_sort(entries),
        lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(e["value_json"], F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(rendered, ","), F.lit("}"))
