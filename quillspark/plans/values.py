"""Literals checked against a field's type."""

from __future__ import annotations

from typing import Any

from ..schema import Field

BOUNDS = {"integer": 2**31, "long": 2**63}


class TypeMismatch(ValueError):
    pass


def typed(field: Field, value: Any) -> Any:
    """The value as the field's type; TypeMismatch if it has another."""
    if isinstance(value, bool):
        value = str(value).lower()
    if field.type in ("string", "facet"):
        return str(value)
    try:
        if field.type in BOUNDS:
            if isinstance(value, float) and not value.is_integer():
                raise ValueError
            number = int(str(value).rstrip("lL")) if isinstance(value, str) else int(value)
            if not -BOUNDS[field.type] <= number < BOUNDS[field.type]:
                raise ValueError
            return number
        return float(value)
    except (TypeError, ValueError):
        raise TypeMismatch(f"value {value!r} doesn't fit field {field.name} of type {field.type}") from None
