"""Aligning gold labels with runs, and unions that keep an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import with_position


def by_position(gold: DataFrame, run: DataFrame, order: str) -> DataFrame:
    """Row i of ``gold`` beside row i of ``run``, either in the order of its unique column ``order``; unequal lengths are refused.

    ``order`` of the run becomes ``run_`` + its name; other names must differ.
    """
    left, right = with_position(gold, order), with_position(run.withColumnRenamed(order, f"run_{order}"), f"run_{order}")
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} gold rows but {m} rows of the run")
    return left.join(right, "position")


def by_id(gold: DataFrame, key: str, *runs: DataFrame) -> DataFrame:
    """``gold`` with the columns of every run, by id; a run that lacks or repeats an id, or has another, is refused."""
    total = gold.count()
    joined = reduce(lambda a, b: a.join(b, key), runs, gold)
    if any(r.count() != total for r in runs) or joined.count() != total or joined.select(key).distinct().count() != total:
        raise ValueError("the runs do not have the ids of the gold rows, each once")
    return joined


def ordered_union(key: str, order: str, *parts: DataFrame) -> DataFrame:
    """The distinct values of ``key`` over all parts, each with where it first comes: the part's number, then the least ``order``."""
    each = [p.select(key, F.struct(F.lit(k).alias("part"), F.col(order).alias("at")).alias("first")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, each).groupBy(key).agg(F.min("first").alias("first")).select(key, "first.part", "first.at")
