"""Functions that make columns, as ``pyspark.sql.functions`` does, or the same expressions as SQL text.

A column costs a call to the JVM for each of its parts, which for the whole rule pack is seconds. Within ``as_text`` the functions of
``F`` work on text instead, so that an expression of any size reaches Spark as one string. In that mode plain strings given
to functions are literals, not names of columns.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

from pyspark.sql import functions as real

_names: ContextVar[Iterator[int] | None] = ContextVar("names", default=None)


@contextmanager
def as_text() -> Iterator[None]:
    held = _names.set(count(1))
    try:
        yield
    finally:
        _names.reset(held)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"({value})" if value < 0 else str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


def sql_of(value: object) -> str:
    return value.sql if isinstance(value, Text) else literal(value)


class Text:
    """The text of an expression, with the operators of a column."""

    def __init__(self, sql: str, name: str | None = None) -> None:
        self.sql, self.name = sql, name

    def __getattr__(self, field: str) -> Text:
        if field.startswith("__"):
            raise AttributeError(field)
        return Text(f"{self.sql}.{quoted(field)}", field)

    def __getitem__(self, field: str) -> Text:
        return Text(f"{self.sql}.{quoted(field)}", field)

    def alias(self, name: str) -> Text:
        return Text(self.sql, name)

    def cast(self, kind: str) -> Text:
        return Text(f"CAST({self.sql} AS {kind})")

    def try_cast(self, kind: str) -> Text:
        return Text(f"TRY_CAST({self.sql} AS {kind})")

    def isNull(self) -> Text:
        return Text(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Text:
        return Text(f"({self.sql} IS NOT NULL)")

    def isin(self, *values: object) -> Text:
        return Text(f"({self.sql} IN ({', '.join(map(sql_of, values))}))")

    def between(self, low: object, high: object) -> Text:
        return Text(f"({self.sql} BETWEEN {sql_of(low)} AND {sql_of(high)})")

    def __invert__(self) -> Text:
        return Text(f"(NOT {self.sql})")

    def __neg__(self) -> Text:
        return Text(f"(- {self.sql})")

    def __bool__(self) -> bool:
        raise ValueError("an expression has no truth of its own; use &, | and ~")

    __hash__ = None


def _infix(sign: str, turned: bool = False) -> Callable[[Text, object], Text]:
    def both(self: Text, other: object) -> Text:
        a, b = (sql_of(other), self.sql) if turned else (self.sql, sql_of(other))
        return Text(f"({a} {sign} {b})")

    return both


def _named(name: str) -> Callable[..., Text]:
    return lambda self, *others: Text(f"{name}({', '.join(map(sql_of, (self, *others)))})")


for _method, _sign in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "and": "AND", "or": "OR", "add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%"}.items():
    setattr(Text, f"__{_method}__", _infix(_sign))
for _method, _sign in {"and": "AND", "or": "OR", "add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%"}.items():
    setattr(Text, f"__r{_method}__", _infix(_sign, turned=True))
for _method in ("contains", "startswith", "endswith", "rlike"):
    setattr(Text, _method, _named(_method))
Text.eqNullSafe = _infix("<=>")


class Case(Text):
    def __init__(self, cases: list[tuple[Text, object]], other: object = None) -> None:
        self.cases = cases
        whens = " ".join(f"WHEN {sql_of(c)} THEN {sql_of(v)}" for c, v in cases)
        super().__init__(f"(CASE {whens} ELSE {sql_of(other)} END)")

    def when(self, condition: Text, value: object) -> Case:
        return Case([*self.cases, (condition, value)])

    def otherwise(self, value: object) -> Text:
        return Text(Case(self.cases, value).sql)


def _lambda(body: Callable[..., Text]) -> str:
    names = [f"v{next(_names.get())}" for _ in inspect.signature(body).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {sql_of(body(*map(Text, names)))}"


def _call(name: str, *args: object) -> Text:
    return Text(f"{name}({', '.join(_lambda(a) if callable(a) and not isinstance(a, Text) else sql_of(a) for a in args)})")


_TEXT: dict[str, Callable[..., Text]] = {
    "lit": lambda value: value if isinstance(value, Text) else Text(literal(value)),
    "col": lambda name: Text(".".join(map(quoted, name.split(".")))),
    "when": lambda condition, value: Case([(condition, value)]),
    "struct": lambda *fields: Text(f"named_struct({', '.join(f'{literal(f.name)}, {f.sql}' for f in fields)})"),
    "call_function": _call,
}


class Functions:
    def __getattr__(self, name: str) -> Callable:
        if _names.get() is None:
            return getattr(real, name)
        return _TEXT.get(name) or (lambda *args: _call(name, *args))


F = Functions()
