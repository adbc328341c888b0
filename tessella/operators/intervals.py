"""Rows near each other on a line: earlier writes of a block, sessions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earlier_within(df: DataFrame, container: str, position: str, order: list[str], distance: int, most: int, keep: list[str]) -> DataFrame:
    """``df`` with ``earlier``: the ``most`` nearest earlier rows of its container within ``distance``, nearest first.

    Positions are cut into buckets as long as the distance; each row stands in its own bucket, and
    once more in the next, so what a row can reach lies in one bucket. A container of any size is
    so dealt over its buckets, each row costs two, and no pairs arise. ``order`` breaks ties of
    ``position`` and must make rows distinct; rows at one position count as earlier by it. ``keep`` names what an
    earlier row tells. A row without container or position has no earlier ones.
    """
    bucket = F.floor(F.col(position) / distance)
    known = F.col(container).isNotNull() & F.col(position).isNotNull()
    spread = F.when(known, F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own"))))
    placed = df.where(known).select("*", F.inline(spread).alias("_bucket", "_own"))
    w = Window.partitionBy(container, "_bucket").orderBy(position, *order)
    told = [F.lag(F.struct(position, *keep), k).over(w) for k in range(1, most + 1)]
    found = placed.select("*", F.array(*told).alias("_told")).where("_own")
    found = found.withColumn("earlier", F.filter("_told", lambda e: e.isNotNull() & (F.col(position) - e[position] <= distance)))
    none = df.where(~known).withColumn("earlier", F.slice(F.array(F.struct(position, *keep)), 1, 0))
    return found.select(*df.columns, "earlier").unionByName(none)


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Rows (key, start, end, n): runs of events of a key with less than ``gap`` between neighbours.

    The same expression serves a stream, where a watermark on ``at`` decides what is late.
    """
    return df.groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def throttled(df: DataFrame, key: str, at: Column, order: list[str], gap: int) -> DataFrame:
    """``df`` with ``allowed``: whether an event comes ``gap`` or more after the last one allowed of its key.

    The first of a key is allowed. What is allowed depends on all before, so a key's times are folded in order; they are
    numbers, and runs that no gap parts are folded each for itself, since the first event after a gap is allowed whatever came before.
    """
    w = Window.partitionBy(key).orderBy("_at", *order)
    timed = df.withColumn("_at", at).withColumn("_new", F.coalesce(F.col("_at") - F.lag("_at").over(w) >= gap, F.lit(True)))
    runs = timed.withColumn("_run", F.count_if("_new").over(w))
    folded = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("_at", *order))).alias("_all"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<boolean>").alias("said"))

    def step(state: Column, e: Column) -> Column:
        ok = state["last"].isNull() | (e["_at"] - state["last"] >= gap)
        return F.struct(F.when(ok, e["_at"]).otherwise(state["last"]).alias("last"), F.concat(state["said"], F.array(ok)).alias("said"))

    told = folded.select(key, F.explode(F.arrays_zip(F.col("_all").alias("e"), F.aggregate("_all", start, step, lambda s: s["said"]).alias("said"))).alias("_x"))
    told = told.select(key, *[F.col(f"_x.e.{o}").alias(o) for o in order], F.col("_x.said").alias("allowed"))
    return df.join(told, [key, *order])
