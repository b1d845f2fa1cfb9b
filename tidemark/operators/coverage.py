"""Coverage of a space of choices. A state makes exactly one atom of every choice true; a region (nogood) is a set of atoms
and covers the states in which all of them are true. Questions: which states are covered by no region, is a partial
assignment clear of all regions, and how far can it be cut down and stay clear.

All gaps and all overlaps are DataFrames: states are enumerated choice by choice, and a partial state that holds a region is
dropped at once. Single witnesses and reductions search on the driver instead, over the declared constraints."""

from __future__ import annotations

import enum
import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.terms import RuleError

log = logging.getLogger(__name__)


class Reduction(enum.Enum):
    NOOP = "check only"
    ONE_SHOT = "one core of what matters, maybe not minimal"
    IN_ORDER = "drop atoms from the back while the rest stays clear"
    GREEDY = "minimal, in any order"


MOST_ATOMS = 1_000_000  # of all choices together; they are declared constraints and travel with the plan


def _states(choices: DataFrame, spark: SparkSession, regions: DataFrame | None, given: Sequence = ()) -> DataFrame:
    """(state): sorted arrays of the true atoms. ``regions``: (atoms); states that hold one are left out, as soon as their last atom
    comes in. States without an atom of ``given`` that a choice has are not made. A choice without atoms leaves no state."""
    kind = choices.schema["atom"].dataType.simpleString()
    rows = choices.groupBy("choice_id").agg(F.array_sort(F.collect_set("atom")).alias("atoms")).orderBy("choice_id").limit(MOST_ATOMS + 1).collect()
    if sum(max(1, len(r["atoms"])) for r in rows) > MOST_ATOMS:
        raise RuleError(f"the choices have more than {MOST_ATOMS} atoms")
    declared = sorted((r["atoms"] for r in rows), key=len)  # small choices first: fewer partial states
    states, seen = spark.range(1).select(F.array().cast(f"array<{kind}>").alias("state")), []
    if regions is not None:
        none = regions.where(F.size("atoms") == 0).limit(1)
        states = states.join(none, F.lit(True), "left_anti")
        by_atom = regions.select("atoms", F.explode("atoms").alias("key"))
    for atoms in declared:
        wanted = [a for a in atoms if a in given] or atoms
        options = spark.createDataFrame([(a,) for a in wanted], f"atom {kind}")
        states = states.crossJoin(F.broadcast(options)).select("atom", F.array_sort(F.array_distinct(F.array_append("state", F.col("atom")))).alias("state"))
        # an atom may stand in several choices: each needs exactly one
        shared = [c for c in (*seen, atoms) if len(seen) and any(set(c) & set(d) for d in (*seen, atoms) if d is not c)]
        seen.append(atoms)
        for c in shared:
            states = states.where(F.size(F.array_intersect("state", F.array(*map(F.lit, c)).cast(f"array<{kind}>"))) == 1)
        if regions is not None:
            states = states.join(by_atom, (F.col("atom") == F.col("key")) & (F.size(F.array_except("atoms", "state")) == 0), "left_anti")
        states = states.select("state").distinct() if shared else states.select("state")
    return states


def region_arrays(nogoods: DataFrame) -> DataFrame:
    """(atoms) of each region once. A region whose only row has a null atom is the empty one, which covers everything."""
    return nogoods.groupBy("region_id").agg(F.collect_set("atom").alias("atoms")).select(F.array_sort("atoms").alias("atoms")).distinct()


def _rarest(regions: DataFrame) -> DataFrame:
    """(atoms, key): each region with the atom of it that the fewest regions have; null for the empty region."""
    each = regions.select("atoms", F.explode_outer("atoms").alias("atom"))
    count = each.groupBy("atom").agg(F.count(F.lit(1)).alias("n"))
    counted = each.join(count.withColumnRenamed("atom", "_atom"), F.col("atom").eqNullSafe(F.col("_atom")))
    return counted.groupBy("atoms").agg(F.min(F.struct("n", "atom")).alias("least")).select("atoms", F.col("least.atom").alias("key"))


def gaps(spark: SparkSession, choices: DataFrame, nogoods: DataFrame) -> DataFrame:
    """(state): all states that no region covers. choices: (choice_id, atom); nogoods: (region_id, atom)."""
    return _states(choices, spark, region_arrays(nogoods))


def overlaps(spark: SparkSession, choices: DataFrame, nogoods: DataFrame, assignment: Sequence[str]) -> DataFrame:
    """(state): the covered states in which all atoms of the assignment are true; none if it is clear of all regions."""
    kind = choices.schema["atom"].dataType.simpleString()
    given = F.array(*map(F.lit, assignment)).cast(f"array<{kind}>") if assignment else F.array().cast(f"array<{kind}>")
    states = _states(choices, spark, None, assignment).where(F.size(F.array_except(given, F.col("state"))) == 0)
    keyed = states.select("state", F.explode(F.concat("state", F.array(F.lit(None).cast(kind)))).alias("atom"))
    inside = F.col("atom").eqNullSafe(F.col("key")) & (F.size(F.array_except("atoms", "state")) == 0)
    return keyed.join(_rarest(region_arrays(nogoods)), inside, "left_semi").select("state").distinct()


class Coverage:
    """Choices and regions declared one by one. ``positive``: answers list the true atoms only and every atom of a region must
    occur in a choice; otherwise answers are (atom, truth) pairs and atoms outside all choices are free.

    A search that takes more than ``budget`` decisions raises RuleError."""

    def __init__(self, positive: bool = True, budget: int | None = None) -> None:
        self.positive, self.budget = positive, budget  # budget: decisions of one search, after which it gives up
        self.choices: list[frozenset] = []
        self.regions: list[frozenset] = []
        self.atoms: dict = {}  # any hashable values, in the order they were first mentioned

    def _mention(self, atoms: Iterable) -> frozenset:
        atoms = list(atoms)
        for a in sorted(atoms, key=lambda a: (type(a).__name__, a if isinstance(a, (int, str)) else repr(a))):
            self.atoms.setdefault(a, len(self.atoms))
        return frozenset(atoms)

    def declare_choice(self, atoms: Iterable[str]) -> None:
        if (c := self._mention(atoms)) not in self.choices:
            self.choices.append(c)

    def add_nogood(self, atoms: Iterable[str]) -> None:
        atoms = list(atoms)
        if self.positive and (loose := set(atoms) - set().union(*self.choices)):
            raise RuleError(f"atoms {sorted(loose)} of the region are in no choice")
        if (r := self._mention(atoms)) not in self.regions:
            self.regions.append(r)

    # --- search on the driver
    def _solve(self, given: dict[str, bool], covered: bool) -> dict[str, bool] | None:
        """A state that extends ``given`` and is in a region (``covered``) or in none, or None. Depth-first with unit propagation."""
        if covered:
            for region in self.regions:
                if all(given.get(a, True) for a in region) and (found := self._extend(given | dict.fromkeys(region, True), [])) is not None:
                    return found
            return None
        return self._extend(given, self.regions)

    def _extend(self, given: dict, blocked: Sequence[frozenset]) -> dict | None:
        """A state that extends ``given``, with one true atom a choice and no region of ``blocked`` in it; None if there is none.
        Counts of each choice and region are kept up to date, so a step costs what it touches; the search keeps its own stack."""
        if any(not c for c in self.choices) or any(not r for r in blocked):
            return None
        names = [*self.atoms, *(a for a in given if a not in self.atoms)]
        number = {a: i for i, a in enumerate(names)}
        choices, regions = ([[number[a] for a in s] for s in sets] for sets in (self.choices, blocked))
        in_choice, in_region = [[] for _ in names], [[] for _ in names]
        for found, sets in ((in_choice, choices), (in_region, regions)):
            for k, s in enumerate(sets):
                for a in s:
                    found[a].append(k)
        state: list[bool | None] = [None] * len(names)
        true, free, away, open_ = [0] * len(choices), [len(c) for c in choices], [0] * len(regions), [len(r) for r in regions]
        trail: list[int] = []

        def put(atom: int, value: bool) -> bool:
            """Sets an atom and all that follows from it; False if that contradicts itself."""
            todo = [(atom, value)]
            while todo:
                a, v = todo.pop()
                if state[a] is not None:
                    if state[a] != v:
                        return False
                    continue
                state[a] = v
                trail.append(a)
                for k in in_choice[a]:
                    free[k] -= 1
                    true[k] += v
                for k in in_region[a]:
                    open_[k] -= 1
                    away[k] += not v
                for k in in_choice[a]:
                    if true[k] > 1 or not true[k] and not free[k]:
                        return False
                    if free[k] and (v or free[k] == 1 and not true[k]):
                        todo += [(x, not true[k]) for x in choices[k] if state[x] is None]
                for k in in_region[a]:
                    if not away[k] and open_[k] < 2:
                        if not open_[k]:
                            return False
                        todo += [(x, False) for x in regions[k] if state[x] is None]
            return True

        def back(length: int) -> None:
            while len(trail) > length:
                a = trail.pop()
                for k in in_choice[a]:
                    free[k] += 1
                    true[k] -= state[a]
                for k in in_region[a]:
                    open_[k] += 1
                    away[k] -= not state[a]
                state[a] = None

        alone = [(x, True) for c in choices if len(c) == 1 for x in c] + [(x, False) for r in regions if len(r) == 1 for x in r]
        if not all(put(a, v) for a, v in [*((number[a], v) for a, v in given.items()), *alone]):
            return None
        stack: list[tuple[int, int, int]] = []  # length of the trail before a decision, its atom, the next atom to look at
        at = steps = 0
        while True:
            while at < len(names) and state[at] is not None:
                at += 1
            if at == len(names):
                return dict(zip(names, state, strict=True))
            steps += 1
            if self.budget is not None and steps > self.budget:
                raise RuleError("conflict checking timed out")
            stack.append((len(trail), at, at + 1))
            fits = put(at, False)
            while not fits:
                if not stack:
                    return None
                length, atom, at = stack.pop()
                back(length)
                fits = put(atom, True)  # the decision was false; now the other value holds at this depth

    def _core(self, given: dict[str, bool]) -> dict[str, bool]:
        """Assumptions that some region's refutation uses: all that are needed to keep every region away. An atom of a region is
        false if it is given so, or if another atom of one of its choices is given as true."""
        core: dict[str, bool] = {}
        for region in self.regions:
            rivals = set().union(*(c - {a} for a in region for c in self.choices if a in c))
            clash = [a for a, v in given.items() if a in region and not v] + [a for a, v in given.items() if a in rivals and v]
            if clash and not core.keys() & set(clash):
                core[clash[0]] = given[clash[0]]
        core = {a: v for a, v in given.items() if a in core}
        if self._solve(core, True) is None:
            return core
        # some region is kept away only through choices in between: runs of assumptions are left out, long runs first
        kept, run = list(given), len(given) // 2
        while run:
            at = 0
            while at < len(kept):
                rest = kept[:at] + kept[at + run :]
                if self._solve({a: given[a] for a in rest}, True) is None:
                    kept = rest
                else:
                    at += run
            run //= 2
        return {a: given[a] for a in kept}

    def _reduce(self, given: dict[str, bool], policy: Reduction) -> dict[str, bool]:
        if policy is Reduction.ONE_SHOT:
            return self._core(given)
        if policy in (Reduction.IN_ORDER, Reduction.GREEDY):
            given = self._core(given) if policy is Reduction.GREEDY else given
            for atom in sorted(given, key=lambda a: self.atoms[a], reverse=True) if policy is Reduction.GREEDY else list(given)[::-1]:
                rest = {a: v for a, v in given.items() if a != atom}
                if self._solve(rest, True) is None:
                    given = rest
        return given

    def _answer(self, state: dict[str, bool]) -> list:
        return [a for a, v in state.items() if v] if self.positive else list(state.items())

    def gap_witness(self, policy: Reduction = Reduction.NOOP) -> list | None:
        """A state that no region covers, maybe cut down to a part that is clear of all regions; None if all is covered."""
        found = self._solve({}, False)
        if found is None:
            return None
        state = {a: found[a] for a in self.atoms}
        if self.positive:
            state = {a: True for a, v in state.items() if v}
        return self._answer(self._reduce(state, policy) if self.regions else ({} if policy is not Reduction.NOOP else state))

    def disjoint_from_nogoods(self, assignment: Sequence, policy: Reduction = Reduction.NOOP) -> list:
        """The assignment, cut down by the policy, if no valid extension is covered; else RuleError. Without any region the
        answer is empty. Atoms that were never mentioned are registered and skipped with a warning."""
        if not self.regions:
            return []
        given = {}
        for item in assignment:
            atom, value = (item, True) if self.positive or isinstance(item, str) or item in self.atoms else item
            if atom not in self.atoms:
                log.warning("atom %s was never mentioned; it is skipped", atom)
                self._mention([atom])
            else:
                given[atom] = value
        if self._solve(given, True) is not None:
            raise RuleError("the assignment overlaps with a region")
        return self._answer(self._reduce(given, policy))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The declared choices and regions as tables for ``gaps`` and ``overlaps``; an empty one is a row with a null atom."""
        kind = "long" if self.atoms and all(isinstance(a, int) for a in self.atoms) else "string"
        value = (lambda a: a) if kind == "long" else (lambda a: a if isinstance(a, str) else repr(a))
        rows = lambda sets: [(i, a) for i, s in enumerate(sets) for a in (sorted(map(value, s)) or [None])]
        return spark.createDataFrame(rows(self.choices), f"choice_id long, atom {kind}"), spark.createDataFrame(rows(self.regions), f"region_id long, atom {kind}")
