"""Plans to DataFrames. Only built-in columns are used, so Catalyst pushes filters and projections into the scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.terms import Atom, RuleError, Var
from tidemark.operators.relation import MARK, WEIGHT, Relation, columns_of, concat
from tidemark.plans.ir import AntiJoin, Join, Plan, Project, Scan, Unit


def _mark():
    return F.lit(1).cast("long").alias(MARK)


def _select(df: DataFrame, cols: list) -> DataFrame:
    """``cols``, or the marker if there are none, with the multiplicity if there is one."""
    return df.select(*(cols or [_mark()]), *([WEIGHT] if WEIGHT in df.columns else []))


def match(facts: Relation, atom: Atom) -> Relation:
    """Captures of the facts that fit an atom."""
    if facts.shape != atom.arity:
        raise RuleError(f"{atom.predicate} has {facts.shape} columns, the plan says {atom.arity}")
    if facts.words is not None and len(atom.vars) == 2:
        return Relation.of_words(atom.vars, facts.words.withColumnRenamed(facts.words.columns[0], atom.terms[int(facts.words.columns[0][1:])].column), facts.rows, facts.numbers)
    df, first = facts.df, {}
    for i, t in enumerate(atom.terms):
        if isinstance(t, Var):
            if t in first:
                df = df.where(F.col(f"_{i}") == F.col(f"_{first[t]}"))
            first.setdefault(t, i)
        else:
            df = df.where(F.col(f"_{i}") == F.lit(t))
    return Relation(atom.vars, _select(df, [F.col(f"_{first[v]}").alias(v.column) for v in atom.vars]))


def instantiate_head(captures: Relation, head: Atom) -> Relation:
    """Facts of a head under each capture."""
    if missing := {t for t in head.terms if isinstance(t, Var)} - set(captures.shape):
        raise RuleError(f"variables {sorted(missing)} of the head are not captured")
    if captures.words is not None and head.arity == 2 and len(set(head.vars)) == 2:
        words = captures.words_by(head.terms[0].column)
        return Relation.of_words(2, words.withColumnRenamed(words.columns[0], "_0"), numbers=captures.numbers, sole=captures.sole and words is captures.words)
    cols = [(F.col(t.column) if isinstance(t, Var) else F.lit(t).cast("long") if isinstance(t, int) else F.lit(t)).alias(f"_{i}") for i, t in enumerate(head.terms)]
    return Relation(head.arity, _select(captures.df, cols))


def instantiate_heads(captures: Relation, heads) -> dict[str, list[Relation]]:
    """For each head predicate its derived collections."""
    found: dict[str, list[Relation]] = {}
    for head in heads:
        found.setdefault(head.predicate, []).append(instantiate_head(captures, head))
    return found


def _side(r: Relation, wanted: set[Var], weight: str) -> DataFrame:
    cols = [v.column for v in r.shape if v in wanted]
    return r.df.select(*cols, *([F.col(WEIGHT).alias(weight)] if r.signed else []), *([] if cols or r.signed else [_mark()]))


def lower(plan: Plan, relations: Mapping[str, Relation], spark: SparkSession) -> Relation:
    if isinstance(plan, Unit):
        return Relation((), spark.range(1).select(_mark()))
    if isinstance(plan, Scan):
        if plan.atom.predicate not in relations:
            raise RuleError(f"predicate {plan.atom.predicate} not found")
        return match(relations[plan.atom.predicate], plan.atom)
    if isinstance(plan, Project):
        inner = lower(plan.input, relations, spark)
        if inner.words is not None and set(plan.shape) == set(inner.shape):
            return Relation.of_words(plan.shape, inner.words, inner.rows, inner.numbers)
        return Relation(plan.shape, _select(inner.df, [F.col(c) for c in columns_of(plan.shape)] if plan.shape else []))
    if isinstance(plan, Join):
        left, right = lower(plan.left, relations, spark), lower(plan.right, relations, spark)
        wanted, key = {*plan.key, *plan.shape}, [v.column for v in plan.key]
        a, b = _side(left, wanted, "_wl"), _side(right, wanted, "_wr")
        if MARK in a.columns and MARK in b.columns:
            b = b.withColumnRenamed(MARK, "_ur")
        df = a.join(b, key) if key else a.crossJoin(b)
        if left.signed or right.signed:
            df = df.withColumn(WEIGHT, (F.col("_wl") if left.signed else F.lit(1)) * (F.col("_wr") if right.signed else F.lit(1)))
        return Relation(plan.shape, _select(df, [F.col(v.column) for v in plan.shape]))
    if isinstance(plan, AntiJoin):
        minuend = lower(plan.minuend, relations, spark)
        if not plan.subtrahends:
            return minuend
        parts = [lower(s, relations, spark) for s in plan.subtrahends]
        if set(plan.key) == set(minuend.shape) and all(r.words is not None for r in (minuend, *parts)):
            for part in parts:
                minuend = minuend.minus(Relation.of_words(minuend.shape, part.words, numbers=part.numbers))
            return minuend
        taken = concat(parts)
        taken = taken.distinct() if taken.signed else taken  # an antijoin does not mind repeated rows
        key = [v.column for v in plan.key]
        df = minuend.df.join(taken.df.select(*key), key, "left_anti") if key else minuend.df.join(taken.df.limit(1), F.lit(True), "left_anti")
        return minuend.with_df(df.select(*minuend.df.columns))  # joins by name put the key first
    raise TypeError(plan)
