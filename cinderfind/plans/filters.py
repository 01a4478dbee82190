"""Metadata filters and scopes compiled to Columns, typed and validated before a plan is built.

A filter is {key: condition}; all keys must hold. A condition is a value (equality) or {operator: operand} with $in,
$gt, $gte, $lt, $lte, all of which must hold. A key among the table's columns filters that column; any other key
filters a VARIANT (or JSON text) column of attributes. Text, numbers and truth values never equal one another, and
whole and broken numbers of one value do. What lacks the key doesn't match.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderfind.model import Scope

RANGES = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        if math.isnan(value) or math.isinf(value):
            raise ValueError("a filter's numbers are finite")
        return "number"
    if isinstance(value, str):
        return "text"
    raise ValueError(f"{value!r} is no text, number or truth value")


def _check_key(key) -> None:
    if not (key and isinstance(key, str)):
        raise ValueError("a filter's keys are non-empty strings")


class _Plain:
    """A typed column."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    def typed(self, kind: str) -> Column | None:
        """The column as a kind, or None if it never is of that kind."""
        return self.column if kind == self.kind else None

    def check(self, key, value, ranged):
        if self.kind == "text" and _kind(value) != "text":
            raise ValueError(f"{key} is a text column; {value!r} is no text")


class _Attribute:
    """A key of a VARIANT column, read by its stored type."""

    def __init__(self, variant: Column, key: str):
        self.path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        self.value = F.try_variant_get(variant, self.path, "variant")
        self.type = F.schema_of_variant(self.value)

    def typed(self, kind: str) -> Column:
        if kind == "text":
            return F.when(self.type == "STRING", self.value.cast("string"))
        if kind == "bool":
            return F.when(self.type == "BOOLEAN", self.value.cast("boolean"))
        return F.when(self.type.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), self.value.cast("double"))

    def check(self, key, value, ranged):
        if ranged and _kind(value) != "number":
            raise ValueError(f"attribute {key} has a range of numbers alone")


def _literal(value) -> Column:
    return F.lit(float(value)) if _kind(value) == "number" and not isinstance(value, bool) else F.lit(value)


def _equals(target, value) -> Column:
    typed = target.typed(_kind(value))
    return F.lit(False) if typed is None else typed == (F.lit(value) if isinstance(target, _Plain) else _literal(value))


def _condition(key: str, target, condition) -> Column:
    if not isinstance(condition, dict):
        target.check(key, condition, False)
        return _equals(target, condition)
    if not condition:
        raise ValueError(f"{key} has a condition without operators")
    parts = []
    for op, operand in condition.items():
        if op == "$in":
            if not isinstance(operand, (list, tuple, set, frozenset)) or not operand:
                raise ValueError(f"$in of {key} takes a list that isn't empty")
            for v in operand:
                target.check(key, v, False)
            by_kind: dict[str, list] = {}
            for v in operand:
                by_kind.setdefault(_kind(v), []).append(v)
            some = []
            for kind, values in by_kind.items():
                typed = target.typed(kind)
                if typed is not None:
                    some.append(typed.isin(sorted(values) if isinstance(target, _Plain) or kind != "number" else sorted(map(float, values))))
            parts.append(reduce(operator.or_, some, F.lit(False)))
        elif op in RANGES:
            target.check(key, operand, True)
            typed = target.typed(_kind(operand))
            parts.append(F.lit(False) if typed is None else RANGES[op](typed, F.lit(operand) if isinstance(target, _Plain) else _literal(operand)))
        else:
            raise ValueError(f"{op} of {key} is no operator")
    return reduce(operator.and_, parts)


def compile_filter(where: dict | None, columns: dict[str, tuple[Column, str]], attributes: Column | None = None) -> Column:
    """The predicate of a filter. columns: key -> (column, kind) with kind text, number or bool."""
    parts = []
    for key, condition in (where or {}).items():
        _check_key(key)
        if key in columns:
            target = _Plain(*columns[key])
        elif attributes is not None:
            target = _Attribute(attributes, key)
        else:
            raise ValueError(f"{key} is no column, and there are no attributes")
        parts.append(_condition(key, target, condition))
    return reduce(operator.and_, parts) if parts else F.lit(True)


def compile_scope(scope: Scope | None, tenant: Column, visibility: Column) -> Column:
    """The catalog's reading of a scope: a row without tenant or visibility is shared."""
    parts = []
    if scope is not None and scope.tenant_id is not None:
        parts.append(tenant.isNull() | (tenant == scope.tenant_id))
    if scope is not None and scope.visibility is not None:
        parts.append(visibility.isNull() | visibility.isin(list(scope.visibility)))
    return reduce(operator.and_, parts) if parts else F.lit(True)


def merge_scope(where: dict | None, scope: Scope | None) -> dict | None:
    """The dense branch's stricter reading: the scope joins the filter, so what lacks the keys is left out."""
    if scope is None or scope.open:
        return where
    tenant = {} if scope.tenant_id is None else {"tenant_id": scope.tenant_id}
    seen = {} if scope.visibility is None else {"visibility": {"$in": list(scope.visibility)}}
    return (where or {}) | tenant | seen


def matches(where: dict | None, metadata: dict) -> bool:
    """The same predicate over one Python mapping, for driver-side use."""
    for key, condition in (where or {}).items():
        _check_key(key)
        tests = condition.items() if isinstance(condition, dict) else [("$eq", condition)]
        if isinstance(condition, dict) and not condition:
            raise ValueError(f"{key} has a condition without operators")
        for op, operand in tests:
            if op == "$in":
                if not isinstance(operand, (list, tuple, set, frozenset)) or not operand:
                    raise ValueError(f"$in of {key} takes a list that isn't empty")
                good = key in metadata and any(_kind(v) == _kind(metadata[key]) and v == metadata[key] for v in operand)
            elif op == "$eq":
                good = key in metadata and _kind(metadata[key]) == _kind(operand) and metadata[key] == operand
            elif op in RANGES:
                good = key in metadata and _kind(metadata[key]) == _kind(operand) and RANGES[op](metadata[key], operand)
            else:
                raise ValueError(f"{op} of {key} is no operator")
            if not good:
                return False
    return True
