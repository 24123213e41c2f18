"""Propositional sentences in disjunctive normal form: made from a seed and evaluated as nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 1000003


def draw(seed: Column, *places: Column | int) -> Column:
    """A number below ``PRIME`` for a seed and places, the same in every run."""
    total = seed * 7919
    for factor, p in zip((104729, 1299709, 15485863), places):
        total = total + (p if isinstance(p, Column) else F.lit(p)).cast("long") * factor
    return F.pmod(F.pmod(total, F.lit(PRIME)) * 48271, F.lit(PRIME))


def made_sentences(rows: DataFrame, seed: str, variables: int = 20, most_clauses: int = 3, most_literals: int = 3) -> DataFrame:
    """Adds ``clauses``: array<array<int>>, each clause its literals, ``-v - 1`` for the negation of variable v.

    Clauses and literals are drawn by hash: one to ``most_clauses`` of one to ``most_literals`` each.
    """
    s = F.col(seed).cast("long")
    last = lambda n: n.cast("int") - 1

    def literal(c: Column, j: Column) -> Column:
        v = draw(s, c, j, 1) % variables
        return F.when(draw(s, c, j, 2) % 2 == 0, v).otherwise(-v - 1).cast("int")

    def clause(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last(1 + draw(s, c, 50, 3) % most_literals)), lambda j: literal(c, j))

    return rows.withColumn("clauses", F.transform(F.sequence(F.lit(0), last(1 + draw(s, 70, 70, 4) % most_clauses)), clause))


def sentence_text(clauses: Column) -> Column:
    """The written form: literals joined by ``^``, clauses by ``v``, ``~`` for a negation."""
    said = lambda x: F.when(x < 0, F.concat(F.lit("~"), (-x - 1).cast("string"))).otherwise(x.cast("string"))
    return F.array_join(F.transform(clauses, lambda c: F.array_join(F.transform(c, said), "^")), "v")


def holds(clauses: Column, true_variables: Column) -> Column:
    """Whether some clause has all its literals true; ``true_variables`` is the array of the variables that are."""
    known = lambda x: F.when(x < 0, ~F.array_contains(true_variables, -x - 1)).otherwise(F.array_contains(true_variables, x))
    return F.exists(clauses, lambda c: F.forall(c, known))
