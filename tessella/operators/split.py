"""Deterministic splits, caps, balances and samples. Every order is a salted hash, never a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.identity import number
from tessella.operators.ordering import with_position


def hash_mod(content: Column, modulus: int = 3) -> Column:
    """``test`` where the content's hash leaves 0, else ``train``."""
    return F.when(number(content) % modulus == 0, "test").otherwise("train")


def salted(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def group_split(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """Whole groups to ``validation``: in hash order the first max(1, min(G - 1, round(G * share)))."""
    ranked = with_position(df.select(group).distinct().withColumn("_hash", salted(seed, F.col(group))), "_hash", group, name="_rank")
    n = ranked.count()
    take = max(1, min(n - 1, round(n * share)))  # halves to even
    sides = ranked.select(group, F.when(F.col("_rank") < take, "validation").otherwise("train").alias("split"))
    return df.join(sides, group)


def stratified_groups(groups: DataFrame, group: str, label: str, share: float, seed: str) -> DataFrame:
    """Label-pure groups: of each label's n groups max(1, round(n * share)) to validation, none if n is 1."""
    w = Window.partitionBy(label)
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(salted(seed, F.col(group)), group))
    take = F.when(n > 1, F.greatest(F.lit(1), F.bround(n * share).cast("long"))).otherwise(0)
    return groups.withColumn("split", F.when(rank <= take, "validation").otherwise("train"))


def three_way(groups: DataFrame, group: str, label: str, seed: str) -> DataFrame:
    """Of each label's n groups n // 2 to hard, then n // 7 (one at least, none if n <= 4) to validation."""
    w = Window.partitionBy(label)
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(salted(seed, F.col(group)), group))
    hard = F.floor(n / 2)
    val = F.when(n > 4, F.greatest(F.lit(1), F.floor(n / 7))).otherwise(0)
    return groups.withColumn("split", F.when(rank <= hard, "hard").when(rank <= hard + val, "validation").otherwise("train"))


def shares(df: DataFrame, group: str, seed: str, parts: dict[str, float]) -> DataFrame:
    """Whole groups in hash order, dealt by shares that add up to 1: a part ends at the whole number below its share's end."""
    ranked = with_position(df.select(group).distinct().withColumn("_hash", salted(seed, F.col(group))), "_hash", group, name="_rank")
    n, upto, names = ranked.count(), 0.0, list(parts)
    side = F.when(F.lit(False), "")
    for name in names[:-1]:
        upto += parts[name]
        side = side.when(F.col("_rank") < int(n * upto + 1e-9), name)
    return df.join(ranked.select(group, side.otherwise(names[-1]).alias("split")), group)


def permutation_split(df: DataFrame, share: float, seed: str, key: str, least: int = 2) -> DataFrame:
    """The first max(``least``, floor(n * share)) rows in hash order to ``validation``; ``key`` is unique."""
    placed = with_position(df.withColumn("_hash", salted(seed, F.col(key))), "_hash", key, name="_place")
    return placed.withColumn("split", F.when(F.col("_place") < max(least, int(df.count() * share)), "validation").otherwise("train")).select(*df.columns, "split")


def cap(df: DataFrame, label: str, most: int, seed: str, key: str) -> DataFrame:
    """At most ``most`` rows of each label, the first in hash order."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(salted(seed, F.col(key)), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def balance(df: DataFrame, label: str, seed: str, key: str) -> DataFrame:
    """As many rows of every label as the rarest has, the first in hash order; ``key`` is unique.

    Rows are numbered over all labels by range partitions, and a label's first number taken off: no label meets in one task.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n")).first()[0]
    placed = with_position(df.withColumn("_hash", salted(seed, F.col(key))), label, "_hash", key, name="_place")
    first = placed.groupBy(label).agg(F.min("_place").alias("_first"))
    kept = placed.join(first, label).where(F.col("_place") - F.col("_first") < (least or 0))
    return kept.select(*df.columns)


def sample(df: DataFrame, share: float, seed: str, key: str) -> DataFrame:
    """floor(n * share) rows without replacement, the first in hash order; ``key`` is unique."""
    placed = with_position(df.withColumn("_hash", salted(seed, F.col(key))), "_hash", key, name="_place")
    return placed.where(F.col("_place") < int(df.count() * share)).select(*df.columns)
