"""Matching plans: five operators over captures. A plan's ``shape`` is the tuple of variables it gives, in output order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from tidemark.functions.terms import Atom, RuleError, Var


@dataclass(frozen=True)
class Unit:
    """One match that captures nothing."""

    shape: tuple[Var, ...] = ()


@dataclass(frozen=True)
class Scan:
    """Facts of a predicate that fit an atom: constants and repeated variables filter, each variable becomes a column."""

    atom: Atom
    shape: tuple[Var, ...]


@dataclass(frozen=True)
class Project:
    input: Plan
    shape: tuple[Var, ...]


@dataclass(frozen=True)
class Join:
    left: Plan
    right: Plan
    key: tuple[Var, ...]
    shape: tuple[Var, ...]


@dataclass(frozen=True)
class AntiJoin:
    """Matches of the minuend whose key is in none of the subtrahends."""

    minuend: Plan
    key: tuple[Var, ...]
    subtrahends: tuple[Plan, ...]
    shape: tuple[Var, ...]


Plan = Unit | Scan | Project | Join | AntiJoin


def scan(atom: Atom, arity: int | None = None) -> Scan:
    if arity is not None and arity != atom.arity:
        raise RuleError(f"{atom.predicate} has {arity} columns, the pattern has {atom.arity}")
    return Scan(atom, atom.vars)


def project(plan: Plan, kept: Iterable[Var]) -> Project:
    kept = tuple(kept)
    if missing := set(kept) - set(plan.shape):
        raise RuleError(f"projected variables {sorted(missing)} are not in the input")
    return Project(plan, kept)


def _two(inputs: Iterable[Plan]) -> tuple[Plan, Plan]:
    inputs = tuple(inputs)
    if len(inputs) != 2:
        raise RuleError("joins take two inputs")
    return inputs


def join(inputs: Iterable[Plan], key: Iterable[Var], kept: Iterable[Var]) -> Join:
    left, right = _two(inputs)
    key, kept = tuple(sorted(set(key))), tuple(kept)
    if not set(key) <= set(left.shape) & set(right.shape):
        raise RuleError("the join key is not in both inputs")
    for v in kept:
        there = (v in left.shape) + (v in right.shape)
        if not there:
            raise RuleError(f"kept variable {v} is in no input")
        if there == 2 and v not in key:
            raise RuleError(f"kept variable {v} is in both inputs but not in the key")
    return Join(left, right, key, kept)


def natural_join(inputs: Iterable[Plan]) -> Join:
    """Equal on all shared variables; a cross product if there are none."""
    left, right = _two(inputs)
    return join((left, right), set(left.shape) & set(right.shape), sorted(set(left.shape) | set(right.shape)))


def antijoin(minuend: Plan, key: Iterable[Var], subtrahends: Iterable[Plan]) -> AntiJoin:
    key, subtrahends = tuple(key), tuple(subtrahends)
    if any(s.shape != key for s in subtrahends):
        raise RuleError("a subtrahend does not have the shape of the key")
    if not set(key) <= set(minuend.shape):
        raise RuleError("the minuend does not hold the key")
    return AntiJoin(minuend, key, subtrahends, minuend.shape)
