"""Taking a join condition apart.

A condition is a conjunction.  Its parts are, by the sides they speak of:

* an equality of one expression of each side: part of the key;
* a predicate on one side: a pre-condition, applied before pairing;
* anything else, and any test for a missing side: the post-condition.

The key is mandatory.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from ..functions.expr import And, Arg, Eq, Expr, IsNull


@dataclass
class Condition:
    keys: list[tuple[Expr, Expr]] = field(default_factory=list)
    left: Expr | None = None
    right: Expr | None = None
    post: Expr | None = None


def conjuncts(e: Expr) -> list[Expr]:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, And) else [e]


def _tests_side(e: Expr) -> bool:
    return any(isinstance(x, IsNull) and isinstance(x.args[0], Arg) for x in e.walk())


def _all(parts: list[Expr]) -> Expr | None:
    return reduce(And, parts) if parts else None


def split(condition: Expr, left: str = "l", right: str = "r") -> Condition:
    keys, pre_l, pre_r, post = [], [], [], []
    for part in conjuncts(condition):
        sides = part.sides()
        if isinstance(part, Eq):
            a, b = part.args
            if a.sides() == {left} and b.sides() == {right}:
                keys.append((a, b))
                continue
            if a.sides() == {right} and b.sides() == {left}:
                keys.append((b, a))
                continue
        if not _tests_side(part) and sides == {left}:
            pre_l.append(part)
        elif not _tests_side(part) and sides == {right}:
            pre_r.append(part)
        else:
            post.append(part)
    if not keys:
        raise ValueError("a join needs an equality between its two sides")
    return Condition(keys, _all(pre_l), _all(pre_r), _all(post))
