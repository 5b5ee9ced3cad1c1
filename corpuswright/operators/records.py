"""Whole records as text and back: unknown fields are dropped, missing ones take their default, nested records come back as such."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field of a record: its type in SQL (for a nested record: its fields) and what it is where a record lacks it."""

    name: str
    type: str | tuple[Field, ...]
    default: Any = None


def encode(rows: DataFrame, *names: str) -> Column:
    """A record of the columns named (all, if none is) as one line of JSON; null fields are written too."""
    return F.to_json(F.struct(*(names or rows.columns)), {"ignoreNullFields": "false"})


def _field(record: Column, path: str, field: Field) -> Column:
    here = f"{path}.{field.name}"
    if isinstance(field.type, tuple):
        inner = F.struct(*(_field(record, here, f).alias(f.name) for f in field.type))
        nested = F.try_variant_get(record, here, "variant")
        return F.when(nested.isNotNull() & ~F.is_variant_null(nested), inner)
    found = F.try_variant_get(record, here, field.type)
    if field.default is None:
        return found
    stated = F.try_variant_get(record, here, "variant")  # a stated null stays null
    default = F.lit(field.default) if not isinstance(field.default, list) else F.array(*map(F.lit, field.default))
    return F.when(stated.isNull(), default.cast(field.type)).otherwise(found)


def decode(text: Column, fields: tuple[Field, ...]) -> list[Column]:
    """The fields of a record in JSON text, each of its type: null where the value does not fit it, the default where the field is
    missing. Text that is no object gives all defaults."""
    record = F.try_parse_json(text)
    return [_field(record, "$", f).alias(f.name) for f in fields]
