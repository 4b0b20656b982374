"""Conditions such as ``balance < 0`` over state fields, as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_values import is_number, number, text

# Operators by the kind of the field.
NUMBER_OPERATORS = ("<", "<=", ">", ">=", "==", "!=")
TEXT_OPERATORS = ("==", "!=", "contains")

_STRICT = re.compile(r"[A-Za-z0-9_\s<>=!]+\Z")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?\Z")


class ConditionError(ValueError):
    """The text is not a condition."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    literal: str

    def holds(self, value_json: Column) -> Column:
        """Whether a field's canonical JSON satisfies the condition; never NULL."""
        on_number = F.lit(False)
        limit = _double(self.literal)
        if limit is not None and self.operator in NUMBER_OPERATORS:
            value = number(value_json)
            on_number = {
                "<": value < limit,
                "<=": value <= limit,
                ">": value > limit,
                ">=": value >= limit,
                "==": value == limit,
                "!=": value != limit,
            }[self.operator]
        plain = text(value_json)
        on_text = F.lit(False)
        if self.operator in TEXT_OPERATORS:
            on_text = {
                "==": plain == self.literal,
                "!=": plain != self.literal,
                "contains": F.contains(plain, F.lit(self.literal)),
            }[self.operator]
        absent = value_json.isNull() | (value_json == "null")
        result = F.when(absent, F.lit(False)).when(is_number(value_json), on_number).otherwise(on_text)
        return F.coalesce(result, F.lit(False))


def _double(literal: str) -> float | None:
    if literal in ("NaN", "Infinity"):
        # no JSON number is NaN; infinity compares as itself
        return float("inf") if literal == "Infinity" else None
    return float(literal.rstrip("fFdD")) if _NUMBER.match(literal) else None


def compile_condition(expression: str | None, strict: bool = True) -> Condition:
    """``field operator value``; the value may hold spaces.

    ``strict`` allows letters, digits, blanks and ``_ < > = !`` only;
    otherwise signed decimals are accepted too.
    """
    if expression is None or not expression.strip():
        raise ConditionError("condition must not be empty")
    if strict and "." in expression:
        raise ConditionError("nested fields are not supported")
    checked = expression if strict else re.sub(r"[.+-]", "", expression)
    if not _STRICT.match(checked):
        raise ConditionError(f"unexpected characters in {expression!r}")
    parts = expression.strip().split(None, 2)
    if len(parts) != 3:
        raise ConditionError("expected 'field operator value', such as 'balance < 0'")
    field, operator, literal = parts
    if operator not in NUMBER_OPERATORS + TEXT_OPERATORS:
        raise ConditionError(f"unknown operator {operator!r}")
    return Condition(field, operator, literal)
