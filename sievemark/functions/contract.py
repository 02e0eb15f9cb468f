"""The answer's contract, stated once and compiled three ways: a Spark type, a JSON Schema for prompts, and a validating column.

A field is a text, a number, a list of texts, a closed vocabulary (single or a list of it) or an object of further fields. All
fields may be left out; a list that is left out is empty, anything else null.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


@dataclass(frozen=True)
class Text:
    """Any text, or null."""


@dataclass(frozen=True)
class Number:
    """Any number, or null."""


@dataclass(frozen=True)
class OneOf:
    """A value of a closed vocabulary, or null."""

    name: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """A list of texts, or of the values of a vocabulary; no null is in it."""

    of: Text | OneOf = Text()


@dataclass(frozen=True)
class Object:
    """Named fields and no others, or null."""

    name: str
    fields: Mapping[str, Text | Number | OneOf | Listed | Object]


Kind = Text | Number | OneOf | Listed | Object

SALARY = Object("Salary", {"kind": OneOf("SalaryKind", vocab.SALARY_KINDS), "currency": Text(), "amount_from": Number(), "amount_to": Number(), "period": Text()})
_LISTS = {
    "seniority": Listed(OneOf("Seniority", vocab.SENIORITY_LEVELS)), "work_mode": Listed(OneOf("WorkMode", vocab.WORK_MODES)),
    "tech_expected": Listed(), "tech_optional": Listed(),
}
POSTING = Object("JobPosting", {"title": Text(), **_LISTS, "responsibilities": Listed(), "requirements": Listed(), "contract_types": Listed(), "salary": SALARY})
#: The fields that a gold label has.
GOLD_FIELDS = ("title", *_LISTS, "contract_types", "salary")
GOLD = Object("Gold", {f: POSTING.fields[f] for f in GOLD_FIELDS})


def spark_type(kind: Kind) -> str:
    """DDL of the type."""
    if isinstance(kind, Object):
        return "struct<" + ",".join(f"{n}:{spark_type(k)}" for n, k in kind.fields.items()) + ">"
    return {Number: "double", Listed: "array<string>"}.get(type(kind), "string")


def json_schema(root: Object) -> dict:
    """A JSON Schema that admits exactly what the contract admits; named parts are definitions."""
    parts: dict[str, dict] = {}

    def plain(kind: Kind) -> dict:
        if isinstance(kind, OneOf):
            parts[kind.name] = {"enum": list(kind.values), "title": kind.name, "type": "string"}
            return {"$ref": f"#/$defs/{kind.name}"}
        if isinstance(kind, Object):
            parts[kind.name] = whole(kind)
            return {"$ref": f"#/$defs/{kind.name}"}
        return {"type": "number" if isinstance(kind, Number) else "string"}

    def field(name: str, kind: Kind) -> dict:
        title = {} if isinstance(kind, OneOf | Object) else {"title": name.replace("_", " ").title()}
        if isinstance(kind, Listed):
            return {"items": plain(kind.of), **title, "type": "array"}
        return {"anyOf": [plain(kind), {"type": "null"}], "default": None, **title}

    def whole(kind: Object) -> dict:
        return {"additionalProperties": False, "properties": {n: field(n, k) for n, k in kind.fields.items()}, "title": kind.name, "type": "object"}

    out = whole(root)
    return {"$defs": dict(sorted(parts.items())), **out}


def schema_text(root: Object = POSTING) -> str:
    """The JSON Schema as text for a prompt."""
    return json.dumps(json_schema(root), ensure_ascii=False, indent=2)


def violations(x: Column, kind: Object, path: str = "", fields: Sequence[str] | None = None) -> Column:
    """Array of the places of a struct column that break the contract; a null struct breaks nothing. Types are Spark's to
    check, as a column has one; fields that the column lacks are not looked at."""  # noqa: D205
    none = F.array().cast("array<string>")
    found = [none]
    for name, part in kind.fields.items():
        if fields is not None and name not in fields:
            continue
        here, value = f"{path}{name}", x[name]
        if isinstance(part, Object):
            found.append(violations(value, part, f"{here}."))
            continue
        bad = F.lit(False)
        if isinstance(part, OneOf):
            bad = value.isNotNull() & ~value.isin(*part.values)
        elif isinstance(part, Listed):
            fits = (lambda v, p=part: v.isin(*p.of.values)) if isinstance(part.of, OneOf) else (lambda v: v.isNotNull())
            bad = F.exists(F.coalesce(value, F.array().cast("array<string>")), lambda v: ~F.coalesce(fits(v), F.lit(False)))
        else:
            continue
        found.append(F.when(bad, F.array(F.lit(here))).otherwise(none))
    return F.when(x.isNull(), none).otherwise(F.concat(*found))


def conforming(x: Column, kind: Object, name: Column) -> Column:
    """``x``, or an error that names the row and the fields that break the contract."""
    broken = violations(x, kind)
    return F.when(F.size(broken) == 0, x).otherwise(F.raise_error(F.concat(name, F.lit(" does not fit the schema: "), F.array_join(broken, ", "))))
