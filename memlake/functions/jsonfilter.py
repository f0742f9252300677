"""Mongo-style filters over JSON metadata, compiled to columns.

A filter is a conjunction over top-level keys. Equality is strict about types (text isn't a
number, an integer isn't a fraction), order exists among numbers and among strings, and
nothing is ever null: a comparison that doesn't apply is false.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import InvalidInput


class _Field:
    """One top-level key of the metadata."""

    def __init__(self, metadata: Column, key: str):
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        self.value = F.try_variant_get(F.try_parse_json(metadata), f"$['{quoted}']", "variant")
        kind = F.schema_of_variant(self.value)
        self.null = F.coalesce(F.is_variant_null(self.value), F.lit(False))
        self.exists = self.value.isNotNull()
        wide = kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
        self.integer = (kind == "BIGINT") | wide
        self.fraction = (kind.rlike("^(DECIMAL|DOUBLE|FLOAT)")) & ~wide
        self.string = kind == "STRING"
        self.boolean = kind == "BOOLEAN"
        self.nested = kind.rlike("^(OBJECT|ARRAY)")

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def equals(self, x: Any) -> Column:
        if x is None:
            c = self.null
        elif isinstance(x, bool):
            c = self.boolean & (self.get("boolean") == F.lit(x))
        elif isinstance(x, int):
            c = self.integer & (self.get("decimal(38,0)") == F.lit(str(x)).cast("decimal(38,0)"))
        elif isinstance(x, float):
            c = self.fraction & (self.get("double") == F.lit(x))
        elif isinstance(x, str):
            c = self.string & (self.get("string") == F.lit(x))
        else:
            c = self.nested & (F.to_json(self.value) == F.to_json(F.parse_json(F.lit(json.dumps(x)))))
        return F.coalesce(c, F.lit(False))

    def compares(self, op: str, x: Any, strings: bool) -> Column:
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            kind, own, other = self.integer | self.fraction, self.get("double"), F.lit(float(x))
        elif isinstance(x, str) and strings:
            kind, own, other = self.string, self.get("string"), F.lit(x)
        else:
            return F.lit(False)
        test = {"$gt": own > other, "$gte": own >= other, "$lt": own < other, "$lte": own <= other}[op]
        return F.coalesce(kind & test, F.lit(False))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _condition(field: _Field, op: str, x: Any, browser: bool) -> Column | None:
    """None where the operator is unknown or its operand isn't of the kind that it takes."""
    there = F.lit(True) if browser else field.exists
    if op == "$eq":
        return field.equals(x)
    if op == "$ne":
        return there & ~field.equals(x)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return field.compares(op, x, strings=not browser)
    if op in ("$in", "$nin"):
        if not isinstance(x, list):
            return F.lit(False) if browser else None
        hit = _any([field.equals(y) for y in x])
        return hit if op == "$in" else there & ~hit
    return None


def compile_filter(spec: Any, metadata: Column | str = "metadata", dialect: str = "core") -> Column:
    """A predicate over a JSON text column.

    ``core``: unknown operators, and lists that aren't lists, are ignored; what isn't an
    object matches all. ``wasm``: ``$ne`` and ``$nin`` hold for missing keys, strings have no
    order, and an object with a key that is no operator is compared as a whole. ``cli``:
    equality with strings, numbers and booleans only, else an error.
    """
    column = F.col(metadata) if isinstance(metadata, str) else metadata
    if dialect not in ("core", "wasm", "cli"):
        raise InvalidInput(f"unknown dialect: {dialect}")
    if not isinstance(spec, dict):
        if dialect == "cli":
            raise InvalidInput("a filter is a JSON object")
        return F.lit(True)
    parts: list[Column] = []
    for key, want in spec.items():
        field = _Field(column, key)
        if dialect == "cli":
            if not isinstance(want, (str, int, float, bool)):
                raise InvalidInput(f"{key}: only strings, numbers and booleans can be compared")
            parts.append(field.equals(want))
            continue
        if isinstance(want, dict) and want:
            marks = [k.startswith("$") for k in want]
            if all(marks) if dialect == "wasm" else any(marks):
                parts += [c for op, x in want.items() if (c := _condition(field, op, x, dialect == "wasm")) is not None]
                continue
        parts.append(field.equals(want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


class Filter:
    """Builder: ``Filter().eq("a", 1).gt("b", 2).column()``."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, str, Any]] = []

    def _add(self, key: str, op: str, x: Any) -> Filter:
        self.parts.append((key, op, x))
        return self

    def eq(self, key: str, x: Any) -> Filter:
        return self._add(key, "$eq", x)

    def ne(self, key: str, x: Any) -> Filter:
        return self._add(key, "$ne", x)

    def gt(self, key: str, x: Any) -> Filter:
        return self._add(key, "$gt", x)

    def gte(self, key: str, x: Any) -> Filter:
        return self._add(key, "$gte", x)

    def lt(self, key: str, x: Any) -> Filter:
        return self._add(key, "$lt", x)

    def lte(self, key: str, x: Any) -> Filter:
        return self._add(key, "$lte", x)

    def is_in(self, key: str, x: list) -> Filter:
        return self._add(key, "$in", x)

    def not_in(self, key: str, x: list) -> Filter:
        return self._add(key, "$nin", x)

    def column(self, metadata: Column | str = "metadata") -> Column:
        column = F.col(metadata) if isinstance(metadata, str) else metadata
        parts = [c for key, op, x in self.parts if (c := _condition(_Field(column, key), op, x, False)) is not None]
        return reduce(lambda a, b: a & b, parts, F.lit(True))
