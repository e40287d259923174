"""Aggregates of a group, running or final.

``any`` is the first value seen; ``argmax`` and ``argmin`` keep the first of
equal keys; ``count`` counts records; ``mean`` is a double.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Binding, Expr, expr


class Aggregate(Expr):
    def __init__(self, kind: str, *args: Any) -> None:
        self.kind, self.args = kind, tuple(expr(a) for a in args)

    def column(self, env: dict[str, Binding], earliest: Column, latest_last: Column) -> Column:
        """The aggregate function.

        ``earliest`` orders records by arrival, ``latest_last`` the other way round.
        """
        a = [x.lower(env) for x in self.args]
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind in ("sum", "min", "max"):
            return getattr(F, self.kind)(a[0])
        if self.kind == "mean":
            return F.avg(a[0])
        if self.kind == "any":
            return F.min_by(a[0], earliest)
        # of equal keys the earliest record wins
        if self.kind == "argmax":
            return F.max_by(a[1], F.when(a[0].isNotNull(), F.struct(a[0], latest_last)))
        return F.min_by(a[1], F.when(a[0].isNotNull(), F.struct(a[0], earliest)))

    def sides(self) -> set[str]:
        return set().union(*(a.sides() for a in self.args)) if self.args else set()

    def lower(self, env):  # noqa: ANN001, ANN201
        make = env.get("__aggregate__")
        if make is None:
            raise TypeError(f"{self.kind}() stands outside of a group's select")
        return make(self)


def sum_(x: Any) -> Expr:
    return Aggregate("sum", x)


def min_(x: Any) -> Expr:
    return Aggregate("min", x)


def max_(x: Any) -> Expr:
    return Aggregate("max", x)


def mean(x: Any) -> Expr:
    return Aggregate("mean", x)


def count() -> Expr:
    return Aggregate("count")


def any_(x: Any) -> Expr:
    return Aggregate("any", x)


def argmax(key: Any, value: Any) -> Expr:
    return Aggregate("argmax", key, value)


def argmin(key: Any, value: Any) -> Expr:
    return Aggregate("argmin", key, value)


def check(output: dict[str, Expr]) -> None:
    """Reject nested aggregates and group keys inside aggregates."""
    from .expr import Arg

    for name, e in output.items():
        for node in e.walk():
            if isinstance(node, Aggregate):
                inner = [x for a in node.args for x in a.walk()]
                if any(isinstance(x, Aggregate) for x in inner):
                    raise ValueError(f"{name}: an aggregate inside an aggregate")
                if any(isinstance(x, Arg) and x._arg == "key" for x in inner):
                    raise ValueError(f"{name}: the group key inside an aggregate")
