"""Field and table specifications, normalised once on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field as dc_field, replace
from typing import Any

from pyspark.sql import types as T

# Accepted type names and their aliases.
TYPES = ("int", "float", "string", "datetime", "category", "bool", "ip")
TYPE_ALIASES = {
    "integer": "int",
    "double": "float",
    "number": "float",
    "str": "string",
    "datetime64": "datetime",
    "timestamp": "datetime",
    "categorical": "category",
    "boolean": "bool",
}

SPARK_TYPES = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "category": T.StringType(),
    "bool": T.IntegerType(),
    "ip": T.StringType(),
}

# The rename rule as (pattern, replacement) steps; Spark and Python both apply them in this order.
SNAKE_STEPS = (
    (r"[\s\-]+", "_"),
    (r"([a-z0-9])([A-Z])", "{1}_{2}"),
    (r"[^A-Za-z0-9_]+", "_"),
    (r"_+", "_"),
)


def snake(name: str) -> str:
    out = str(name).strip()
    for pattern, repl in SNAKE_STEPS:
        out = re.sub(pattern, repl.replace("{1}", r"\1").replace("{2}", r"\2"), out)
    return out.lower().strip("_")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    nullable: float = 0.0
    unique: bool = False
    distribution: str = "uniform"
    min: Any = None
    max: Any = None
    categories: tuple = ()
    probs: tuple | None = None
    examples: tuple = ()
    metadata: dict = dc_field(default_factory=dict)
    format: str | None = None
    mean: float | None = None
    std: float | None = None
    p: float | None = None

    @property
    def numeric(self) -> bool:
        return self.type in ("int", "float")

    @property
    def supported(self) -> bool:
        return self.type in TYPES

    @staticmethod
    def from_dict(raw: dict, strict: bool = True) -> "FieldSpec":
        if not isinstance(raw.get("type"), str):
            raise ValueError("each field needs a text 'type'")
        name = snake(raw["name"])
        given = raw["type"].strip().lower()
        ftype = TYPE_ALIASES.get(given, given)
        if strict and ftype not in TYPES:
            raise ValueError(f"unsupported field type: {raw['type']}")
        lo, hi = raw.get("min"), raw.get("max")
        if ftype in ("int", "float") and "salary" not in name:
            lo, hi = (0 if lo is None else lo), (100 if hi is None else hi)
        balance = {str(k): v for k, v in (raw.get("class_balance") or {}).items()}
        p = float(balance["1"]) if "1" in balance else raw.get("p")
        return FieldSpec(
            name=name,
            type=ftype,
            nullable=float(raw.get("nullable") or 0.0),
            unique=bool(raw.get("unique", False)),
            distribution=(raw.get("distribution") or "uniform").lower(),
            min=lo,
            max=hi,
            categories=tuple(str(c) for c in raw.get("categories") or ()),
            probs=tuple(float(q) for q in raw["probs"]) if raw.get("probs") else None,
            examples=tuple(raw.get("examples") or ()),
            metadata=dict(raw.get("metadata") or {}),
            format=(raw.get("format") or "").lower() or None,
            mean=raw.get("mean"),
            std=raw.get("std"),
            p=None if p is None else float(p),
        )

    def struct_field(self) -> T.StructField:
        detail = {
            k: getattr(self, k)
            for k in ("type", "nullable", "unique", "distribution", "min", "max", "format", "mean", "std", "p")
            if getattr(self, k) is not None
        }
        return T.StructField(
            self.name, SPARK_TYPES[self.type], True, json.loads(json.dumps(detail, default=str))
        )


@dataclass(frozen=True)
class TableSpec:
    fields: tuple
    name: str | None = None
    description: str | None = None
    n_rows: int = 1000
    class_balance: dict = dc_field(default_factory=dict)
    metadata: dict = dc_field(default_factory=dict)

    @staticmethod
    def from_dict(raw: dict | list, strict: bool = True) -> "TableSpec":
        if isinstance(raw, list):
            if not raw:
                raise ValueError("empty specification list")
            raw = raw[0]
        return TableSpec(
            fields=tuple(FieldSpec.from_dict(f, strict) for f in raw.get("fields", [])),
            name=snake(raw["name"]) if raw.get("name") else None,
            description=raw.get("description"),
            n_rows=int(raw.get("n_rows", 1000)),
            class_balance={str(k): float(v) for k, v in (raw.get("class_balance") or {}).items()},
            metadata=dict(raw.get("metadata") or {}),
        )

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def names(self, *types: str) -> list[str]:
        return [f.name for f in self.fields if not types or f.type in types]

    def with_fields(self, **changes: dict) -> "TableSpec":
        """Copy with some attributes of some fields replaced: ``with_fields(price={"mean": 3.0})``."""
        return replace(
            self,
            fields=tuple(replace(f, **changes[f.name]) if f.name in changes else f for f in self.fields),
        )

    def struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def canonical(self) -> str:
        body = {
            "name": self.name,
            "n_rows": self.n_rows,
            "class_balance": self.class_balance,
            "metadata": self.metadata,
            "fields": [vars(f) for f in self.fields],
        }
        return json.dumps(body, sort_keys=True, default=str, separators=(",", ":"))
