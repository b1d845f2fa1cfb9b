"""Rules as data: variables, atoms, rule bodies, Datalog rules and search rules. Everything is checked when it is built,
before any DataFrame exists; a bad rule raises RuleError."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field


class RuleError(ValueError):
    """A rule or plan that cannot mean anything."""


_numbers = itertools.count(1)


@dataclass(frozen=True, order=True)
class Var:
    """A logic variable. Order and identity are those of creation; two variables may share a name."""

    number: int = field(init=False, default_factory=lambda: next(_numbers))
    name: str = field(default="v", compare=False)

    def __init__(self, name: str = "v") -> None:
        object.__setattr__(self, "number", next(_numbers))
        object.__setattr__(self, "name", name)

    @property
    def column(self) -> str:
        return f"{self.name}__{self.number}"

    def __repr__(self) -> str:
        return self.name


def variables(names: str) -> tuple[Var, ...]:
    """``x, y = variables("x y")``."""
    return tuple(Var(n) for n in names.split())


Term = Var | int | str  # anything but a Var is a constant


def _key(term: Term) -> tuple:
    return (1, term.number) if isinstance(term, Var) else (0, type(term).__name__, term)


@dataclass(frozen=True)
class Atom:
    """A predicate over terms; a variable that occurs twice asks for equal values."""

    predicate: str
    terms: tuple[Term, ...]

    def __init__(self, predicate: str, *terms: Term) -> None:
        object.__setattr__(self, "predicate", predicate)
        object.__setattr__(self, "terms", tuple(terms))

    @property
    def arity(self) -> int:
        return len(self.terms)

    @property
    def vars(self) -> tuple[Var, ...]:
        return tuple(sorted({t for t in self.terms if isinstance(t, Var)}))

    def sort_key(self) -> tuple:
        return self.predicate, tuple(map(_key, self.terms))

    def __lt__(self, other: Atom) -> bool:
        return self.sort_key() < other.sort_key()


def _as_set(atoms: Iterable[Atom]) -> tuple[Atom, ...]:
    return tuple(sorted(set(atoms)))


def vars_of(atoms: Iterable[Atom]) -> tuple[Var, ...]:
    return tuple(sorted({v for a in atoms for v in a.vars}))


@dataclass(frozen=True)
class Body:
    """A conjunction and the variables whose values it captures, in the order of their creation."""

    captures: tuple[Var, ...]
    atoms: tuple[Atom, ...]

    def __init__(self, captures: Iterable[Var], atoms: Iterable[Atom]) -> None:
        atoms, captures = _as_set(atoms), tuple(sorted(set(captures)))
        if missing := set(captures) - set(vars_of(atoms)):
            raise RuleError(f"captured variables {sorted(missing)} occur in no atom")
        object.__setattr__(self, "captures", captures)
        object.__setattr__(self, "atoms", atoms)

    @classmethod
    def partial(cls, captures: Iterable[Var], atoms: Iterable[Atom]) -> Body:
        """Captures only those of the variables that occur in the atoms."""
        atoms = _as_set(atoms)
        return cls(set(captures) & set(vars_of(atoms)), atoms)

    @property
    def vars(self) -> tuple[Var, ...]:
        return vars_of(self.atoms)


@dataclass(frozen=True)
class Rule:
    """Datalog rule: every match of the body gives all heads. Head variables must be captured."""

    body: Body
    heads: tuple[Atom, ...]

    def __init__(self, body: Body, *heads: Atom) -> None:
        heads = _as_set(heads)
        if missing := set(vars_of(heads)) - set(body.captures):
            raise RuleError(f"head variables {sorted(missing)} are not captured by the body")
        object.__setattr__(self, "body", body)
        object.__setattr__(self, "heads", heads)


def rule(heads: Atom | Iterable[Atom], *atoms: Atom) -> Rule:
    """A rule whose body captures all its variables."""
    return Rule(Body(vars_of(atoms), atoms), *([heads] if isinstance(heads, Atom) else heads))


@dataclass(frozen=True)
class Search:
    """Matches of the body should satisfy at least one alternative. Variables of an alternative that the body does not
    capture are existential. No alternative at all: a contradiction detector. An alternative without atoms always holds."""

    body: Body
    alternatives: tuple[Body, ...]

    def __init__(self, body: Body, *alternatives: Body) -> None:
        for a in alternatives:
            if missing := set(a.captures) - set(body.captures):
                raise RuleError(f"an alternative captures {sorted(missing)}, which the body does not capture")
        object.__setattr__(self, "body", body)
        object.__setattr__(self, "alternatives", tuple(sorted(set(alternatives), key=lambda b: (tuple(v.number for v in b.captures), tuple(a.sort_key() for a in b.atoms)))))


def search(body: Body, *alternatives: Iterable[Atom]) -> Search:
    """A search rule whose alternatives capture what they share with the body."""
    return Search(body, *(Body.partial(body.captures, a) for a in alternatives))


def predicate_shapes(rules: Iterable[Rule], searches: Iterable[Search] = ()) -> dict[str, int]:
    """Arity of each predicate that rules mention anywhere."""
    shapes: dict[str, int] = {}
    atoms = [a for r in rules for a in (*r.body.atoms, *r.heads)] + [a for s in searches for b in (s.body, *s.alternatives) for a in b.atoms]
    for a in atoms:
        if shapes.setdefault(a.predicate, a.arity) != a.arity:
            raise RuleError(f"predicate {a.predicate} is used with {shapes[a.predicate]} and with {a.arity} columns")
    return shapes


def instantiate(atom: Atom, env: Mapping[Var, int], backfill) -> tuple:
    """The atom's row under ``env``; ``backfill(var)`` gives the value of a missing variable, once for each."""
    env = dict(env)
    out = []
    for t in atom.terms:
        if isinstance(t, Var) and t not in env:
            env[t] = backfill(t)
        out.append(env[t] if isinstance(t, Var) else t)
    return tuple(out)
