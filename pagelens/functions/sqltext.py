"""Column expressions as SQL text.

Page rules are large expressions over lambdas. A Column is made by calls into the JVM, one for each part; text is made here
and parsed once. The names are those of ``pyspark.sql.functions``, so predicates can be written for both.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

_numbers = itertools.count()
#: Functions whose text arguments are values, from the given place on; elsewhere text is the name of a column.
_VALUES_FROM = {"regexp_replace": 1, "regexp_extract": 1, "split": 1, "array_contains": 1, "array_join": 1, "substring_index": 1, "concat_ws": 0, "format_string": 0}
_NAMES = {"create_map": "map"}


def _value(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def _text(v: Any, name: bool = False) -> str:
    if isinstance(v, Sql):
        return v.text
    if callable(v):
        params = [f"x{next(_numbers)}" for _ in inspect.signature(v).parameters]
        names = params[0] if len(params) == 1 else f"({', '.join(params)})"
        return f"{names} -> {_text(v(*map(Sql, params)))}"
    return f"`{v}`" if name and isinstance(v, str) else _value(v)


class Sql:
    """One expression; ``name`` is what it is called within a struct."""

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    def _with(self, op: str, other: Any) -> Sql:
        return Sql(f"({self.text} {op} {_text(other)})")

    def __getitem__(self, field: str) -> Sql:
        return Sql(f"{self.text}.`{field}`", field)

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.text})")

    def __radd__(self, other: Any) -> Sql:
        return Sql(f"({_text(other)} + {self.text})")

    def __eq__(self, other: Any) -> Sql:  # type: ignore[override]
        return self._with("=", other)

    def __ne__(self, other: Any) -> Sql:  # type: ignore[override]
        return self._with("<>", other)

    __hash__ = object.__hash__

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"cast({self.text} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"try_cast({self.text} AS {kind})")

    def isin(self, *values: Any) -> Sql:
        return Sql(f"({self.text} IN ({', '.join(map(_text, values))}))")

    def between(self, low: Any, high: Any) -> Sql:
        return Sql(f"({self.text} BETWEEN {_text(low)} AND {_text(high)})")

    def isNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self.text} IS NOT NULL)")


def _method(op: str) -> Callable[[Sql, Any], Sql]:
    return lambda self, other: self._with(op, other)


def _called(name: str) -> Callable[[Sql, Any], Sql]:
    return lambda self, other: Sql(f"{name}({self.text}, {_text(other)})")


for _m, _op in {"and": "AND", "or": "OR", "add": "+", "sub": "-", "mul": "*", "truediv": "/", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    setattr(Sql, f"__{_m}__", _method(_op))
for _m, _op in {"contains": "contains", "startswith": "startswith", "endswith": "endswith", "rlike": "rlike"}.items():
    setattr(Sql, _m, _called(_op))


class _Case(Sql):
    def __init__(self, arms: str):
        super().__init__(f"(CASE {arms} END)")
        self.arms = arms

    def when(self, test: Sql, value: Any) -> _Case:
        return _Case(f"{self.arms} WHEN {test.text} THEN {_text(value)}")

    def otherwise(self, value: Any) -> Sql:
        return Sql(f"(CASE {self.arms} ELSE {_text(value)} END)")


def when(test: Sql, value: Any) -> _Case:
    return _Case(f"WHEN {test.text} THEN {_text(value)}")


def lit(value: Any) -> Sql:
    return Sql(_value(value))


def col(name: str) -> Sql:
    return Sql(f"`{name}`", name)


def struct(*parts: Sql) -> Sql:
    return Sql(f"named_struct({', '.join(f'{_value(p.name)}, {p.text}' for p in parts)})")


def __getattr__(name: str) -> Callable[..., Sql]:
    """Any other SQL function by its name."""
    if name.startswith("_"):
        raise AttributeError(name)
    values_from = _VALUES_FROM.get(name, 99)
    return lambda *args: Sql(f"{_NAMES.get(name, name)}({', '.join(_text(a, i < values_from) for i, a in enumerate(args))})")


def column(x: Sql):
    """The Column of an expression."""
    return F.expr(x.text)
