"""Scalar expressions over records.

A lambda gets ``Record`` objects and builds a small tree; the tree is lowered
to Columns once the records are bound to a DataFrame.  The tree is kept until
then because join conditions are taken apart by side (see ``plans.conditions``).

Equality is null-safe, as the language has no third truth value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "boolean": "boolean"}


@dataclass
class Binding:
    """What a record's name stands for: its columns, and whether it is there."""

    get: Callable[[str], Column]
    schema: T.StructType
    whole: Callable[[], Column]
    present: Callable[[], Column] = field(default=lambda: F.lit(True))


class Expr:
    """Base of all nodes; operators build new nodes."""

    args: tuple[Expr, ...] = ()

    def lower(self, env: dict[str, Binding]) -> Column:
        raise NotImplementedError

    def dtype(self, env: dict[str, Binding]) -> T.DataType | None:
        """The type where it is plain to see; None otherwise."""
        return None

    def sides(self) -> set[str]:
        return set().union(*(a.sides() for a in self.args)) if self.args else set()

    def walk(self) -> Iterable[Expr]:
        yield self
        for a in self.args:
            yield from a.walk()

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return self.is_null() if other is None else Eq(self, expr(other))

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return Not(self == other)

    __hash__ = object.__hash__

    def __lt__(self, o: Any) -> Expr:
        return Binary("<", self, expr(o))

    def __le__(self, o: Any) -> Expr:
        return Binary("<=", self, expr(o))

    def __gt__(self, o: Any) -> Expr:
        return Binary(">", self, expr(o))

    def __ge__(self, o: Any) -> Expr:
        return Binary(">=", self, expr(o))

    def __add__(self, o: Any) -> Expr:
        return Plus(self, expr(o))

    def __radd__(self, o: Any) -> Expr:
        return Plus(expr(o), self)

    def __sub__(self, o: Any) -> Expr:
        return Binary("-", self, expr(o))

    def __rsub__(self, o: Any) -> Expr:
        return Binary("-", expr(o), self)

    def __mul__(self, o: Any) -> Expr:
        return Binary("*", self, expr(o))

    def __rmul__(self, o: Any) -> Expr:
        return Binary("*", expr(o), self)

    def __truediv__(self, o: Any) -> Expr:
        return Binary("/", self, expr(o))

    def __mod__(self, o: Any) -> Expr:
        return Binary("%", self, expr(o))

    def __neg__(self) -> Expr:
        return Binary("-", expr(0), self)

    def __and__(self, o: Any) -> Expr:
        return And(self, expr(o))

    def __or__(self, o: Any) -> Expr:
        return Or(self, expr(o))

    def __invert__(self) -> Expr:
        return Not(self)

    def __bool__(self) -> bool:
        raise TypeError("use & | ~ and if_else, not and/or/not/if, on expressions")

    def is_null(self) -> Expr:
        return IsNull(self)

    def is_not_null(self) -> Expr:
        return Not(IsNull(self))

    def get(self, name: str) -> Expr:
        """A field of a struct, or an element ``_n`` of a tuple."""
        return Element(self, name)

    def _to(self, kind: str) -> Expr:
        return Cast(self, _TYPES[kind])

    def to_int(self) -> Expr:
        return self._to("int")

    def to_long(self) -> Expr:
        return self._to("long")

    def to_float(self) -> Expr:
        return self._to("float")

    def to_double(self) -> Expr:
        return self._to("double")

    def to_string(self) -> Expr:
        return self._to("string")

    def to_boolean(self) -> Expr:
        return self._to("boolean")


class Const(Expr):
    def __init__(self, value: Any) -> None:
        self.value = value

    def lower(self, env):  # noqa: ANN001, ANN201
        return F.lit(self.value)

    def dtype(self, env):  # noqa: ANN001, ANN201
        return T.StringType() if isinstance(self.value, str) else None


class Typed(Expr):
    """A null of a type."""

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def lower(self, env):  # noqa: ANN001, ANN201
        return F.lit(None).cast(self.kind)


class Arg(Expr):
    """A whole record.  Fields are attributes; one named like a method is ``r["get"]``."""

    def __init__(self, name: str) -> None:
        self._arg = name

    def lower(self, env):  # noqa: ANN001, ANN201
        return env[self._arg].whole()

    def sides(self) -> set[str]:
        return {self._arg}

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__") or name == "_arg":
            raise AttributeError(name)
        return FieldRef(self, name)

    def __getitem__(self, name: str) -> Expr:
        return FieldRef(self, name)


Record = Arg


class FieldRef(Expr):
    def __init__(self, record: Arg, name: str) -> None:
        self.record, self.name, self.args = record, name, (record,)

    def lower(self, env):  # noqa: ANN001, ANN201
        return env[self.record._arg].get(self.name)

    def dtype(self, env):  # noqa: ANN001, ANN201
        schema = env[self.record._arg].schema
        return schema[self.name].dataType if self.name in schema.names else None


class Element(Expr):
    def __init__(self, of: Expr, name: str) -> None:
        self.of, self.name, self.args = of, name, (of,)

    def lower(self, env):  # noqa: ANN001, ANN201
        return self.of.lower(env).getField(self.name)

    def dtype(self, env):  # noqa: ANN001, ANN201
        kind = self.of.dtype(env)
        return kind[self.name].dataType if isinstance(kind, T.StructType) else None


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "%": lambda a, b: a % b,
}


class Binary(Expr):
    def __init__(self, op: str, a: Expr, b: Expr) -> None:
        self.op, self.args = op, (a, b)

    def lower(self, env):  # noqa: ANN001, ANN201
        return _OPS[self.op](*(x.lower(env) for x in self.args))


class Plus(Expr):
    """Numeric addition, or concatenation where either side is a string."""

    def __init__(self, a: Expr, b: Expr) -> None:
        self.args = (a, b)

    def dtype(self, env):  # noqa: ANN001, ANN201
        kinds = [x.dtype(env) for x in self.args]
        return next((k for k in kinds if isinstance(k, T.StringType)), kinds[0])

    def lower(self, env):  # noqa: ANN001, ANN201
        a, b = (x.lower(env) for x in self.args)
        if isinstance(self.dtype(env), T.StringType):
            return F.concat(a.cast("string"), b.cast("string"))
        return a + b


class Eq(Expr):
    def __init__(self, a: Expr, b: Expr) -> None:
        self.args = (a, b)

    def lower(self, env):  # noqa: ANN001, ANN201
        return self.args[0].lower(env).eqNullSafe(self.args[1].lower(env))


class And(Expr):
    def __init__(self, a: Expr, b: Expr) -> None:
        self.args = (a, b)

    def lower(self, env):  # noqa: ANN001, ANN201
        return self.args[0].lower(env) & self.args[1].lower(env)


class Or(Expr):
    def __init__(self, a: Expr, b: Expr) -> None:
        self.args = (a, b)

    def lower(self, env):  # noqa: ANN001, ANN201
        return self.args[0].lower(env) | self.args[1].lower(env)


class Not(Expr):
    def __init__(self, a: Expr) -> None:
        self.args = (a,)

    def lower(self, env):  # noqa: ANN001, ANN201
        return ~self.args[0].lower(env)


class IsNull(Expr):
    """Of a record: whether that side is missing, which a record of nulls is not."""

    def __init__(self, a: Expr) -> None:
        self.args = (a,)

    def lower(self, env):  # noqa: ANN001, ANN201
        a = self.args[0]
        return ~env[a._arg].present() if isinstance(a, Arg) else a.lower(env).isNull()


class IfElse(Expr):
    def __init__(self, test: Expr, then: Expr, other: Expr) -> None:
        self.args = (test, then, other)

    def dtype(self, env):  # noqa: ANN001, ANN201
        return self.args[1].dtype(env)

    def lower(self, env):  # noqa: ANN001, ANN201
        test, then, other = (x.lower(env) for x in self.args)
        return F.when(test, then).otherwise(other)


class Cast(Expr):
    def __init__(self, a: Expr, kind: str) -> None:
        self.args, self.kind = (a,), kind

    def dtype(self, env):  # noqa: ANN001, ANN201
        return T.StringType() if self.kind == "string" else None

    def lower(self, env):  # noqa: ANN001, ANN201
        return self.args[0].lower(env).cast(self.kind)


class Struct(Expr):
    """A nested record with named fields, or a tuple with fields _1, _2, ..."""

    def __init__(self, names: list[str], args: list[Expr]) -> None:
        self.names, self.args = names, tuple(args)

    def lower(self, env):  # noqa: ANN001, ANN201
        return F.struct(*(a.lower(env).alias(n) for n, a in zip(self.names, self.args, strict=True)))


class Apply(Expr):
    """A Python function from Columns to a Column (a UDF is one)."""

    def __init__(self, fn: Callable[..., Column], args: list[Expr]) -> None:
        self.fn, self.args = fn, tuple(args)

    def lower(self, env):  # noqa: ANN001, ANN201
        return self.fn(*(a.lower(env) for a in self.args))


def expr(value: Any) -> Expr:
    """A constant, a timedelta, a tuple, a dict of fields, or an expression as it is."""
    if isinstance(value, Expr):
        return value
    if isinstance(value, tuple):
        return tuple_of(*value)
    if isinstance(value, dict):
        return Struct(list(value), [expr(v) for v in value.values()])
    return Const(value)


def lit(value: Any) -> Expr:
    return Const(value)


def duration(milliseconds: int) -> Expr:
    return Const(dt.timedelta(milliseconds=milliseconds))


def none_of(kind: str) -> Expr:
    return Typed(kind)


def tuple_of(*values: Any) -> Expr:
    return Struct([f"_{i}" for i in range(1, len(values) + 1)], [expr(v) for v in values])


def fields(**named: Any) -> dict[str, Expr]:
    """Named output fields of map, select and add_fields."""
    return {k: expr(v) for k, v in named.items()}


def record(**named: Any) -> Expr:
    """A nested record."""
    return expr(named)


def if_else(test: Expr, then: Any, other: Any) -> Expr:
    return IfElse(test, expr(then), expr(other))


def map_option(value: Expr, if_some: Callable[[Expr], Any], if_none: Any) -> Expr:
    return if_else(value.is_not_null(), if_some(value), if_none)


def call(fn: Callable[..., Column], *args: Any) -> Expr:
    return Apply(fn, [expr(a) for a in args])


def unpack(value: Expr, names: int, body: Callable[..., Any]) -> Any:
    """Bind the elements of a tuple to the arguments of ``body``."""
    return body(*(Element(value, f"_{i}") for i in range(1, names + 1)))
