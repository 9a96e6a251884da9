"""Formulas of metric first-order temporal logic, as immutable nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace


class FormulaError(ValueError):
    """A formula that can't be read, checked or evaluated; the message names the part."""


@dataclass(frozen=True)
class Interval:
    """Half-open [lo, hi) over time-stamp differences; hi is None for no bound."""

    lo: int = 0
    hi: int | None = None

    def check(self) -> None:
        if self.lo < 0 or (self.hi is not None and self.hi <= self.lo):
            raise FormulaError(f"empty or negative interval {self}")

    def __str__(self) -> str:
        return f"[{self.lo},{'*' if self.hi is None else self.hi})"


ANY = Interval()


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: int | str

    def __str__(self) -> str:
        return str(self.value) if isinstance(self.value, int) else f'"{self.value}"'


Term = Var | Const


@dataclass(frozen=True)
class Formula:
    def children(self) -> tuple[Formula, ...]:
        return tuple(v for f in fields(self) if isinstance(v := getattr(self, f.name), Formula))

    def rebuilt(self, change) -> Formula:
        """The same node with every direct part changed."""
        return replace(self, **{f.name: change(v) for f in fields(self) if isinstance(v := getattr(self, f.name), Formula)})

    def walk(self) -> Iterator[Formula]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Truth(Formula):
    value: bool = True


@dataclass(frozen=True)
class Pred(Formula):
    relation: str
    args: tuple[Term, ...] = ()


@dataclass(frozen=True)
class Compare(Formula):
    """left = right, or left < right."""

    op: str
    left: Term
    right: Term


@dataclass(frozen=True)
class Not(Formula):
    arg: Formula


@dataclass(frozen=True)
class And(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Or(Formula):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Exists(Formula):
    var: str
    arg: Formula


@dataclass(frozen=True)
class Forall(Formula):
    var: str
    arg: Formula


@dataclass(frozen=True)
class Temporal(Formula):
    interval: Interval


@dataclass(frozen=True)
class Prev(Temporal):
    arg: Formula


@dataclass(frozen=True)
class Next(Temporal):
    arg: Formula


@dataclass(frozen=True)
class Once(Temporal):
    arg: Formula


@dataclass(frozen=True)
class Eventually(Temporal):
    arg: Formula


@dataclass(frozen=True)
class Since(Temporal):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Until(Temporal):
    left: Formula
    right: Formula


@dataclass(frozen=True)
class Trigger(Temporal):
    """left TRIGGER right: not ((not left) SINCE (not right))."""

    left: Formula
    right: Formula


@dataclass(frozen=True)
class Release(Temporal):
    """left RELEASE right: not ((not left) UNTIL (not right))."""

    left: Formula
    right: Formula


def implies(a: Formula, b: Formula) -> Formula:
    return Or(Not(a), b)


def equiv(a: Formula, b: Formula) -> Formula:
    return And(implies(a, b), implies(b, a))


def historically(i: Interval, f: Formula) -> Formula:
    return Trigger(i, Truth(False), f)


def always(i: Interval, f: Formula) -> Formula:
    return Release(i, Truth(False), f)


def atoms(f: Formula) -> list[Pred]:
    """Relation atoms in order, with repeats."""
    return [x for x in f.walk() if isinstance(x, Pred)]


def free_variables(f: Formula) -> list[str]:
    """Free variables in order of first occurrence."""
    if isinstance(f, (Pred, Compare)):
        terms = f.args if isinstance(f, Pred) else (f.left, f.right)
        return list(dict.fromkeys(t.name for t in terms if isinstance(t, Var)))
    out = list(dict.fromkeys(v for c in f.children() for v in free_variables(c)))
    return [v for v in out if v != f.var] if isinstance(f, (Exists, Forall)) else out
