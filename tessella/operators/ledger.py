"""Logs of versions: promoted, rejected, rolled back; their state in batch and in a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "current long, target long, n_promoted long"


def registry_state(log: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows (name, current, target, n_promoted, n_rejected): the state that a log of events leaves.

    ``log`` has event (promote, reject, rollback; others change nothing) and version. A promotion
    remembers what was current as the target of a rollback; a rollback exchanges the two once there is a target, which is
    from the second promotion on. So after a promotion only the parity of the rollbacks up to the next one counts:
    if odd, what was current before it is current again. That is the version of the last promotion before with an even
    count, and the whole fold is two counts and two maxima: sums of a sorted pass, no row waits for all before it.
    """
    w = Window.partitionBy(name).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    staged = log.withColumn("_stage", F.count_if(F.col("event") == "promote").over(w))
    stages = staged.groupBy(name, "_stage").agg(
        F.max(F.when(F.col("event") == "promote", F.col("version"))).alias("version"), F.count_if(F.col("event") == "rollback").alias("_back"), F.count_if(F.col("event") == "reject").alias("_rejected"),
    )
    odd = (F.col("_stage") >= 2) & (F.col("_back") % 2 == 1)
    last = stages.groupBy(name).agg(F.max("_stage").alias("n_promoted"), F.sum("_rejected").alias("n_rejected"), F.max_by("version", "_stage").alias("last"), F.max_by(odd, F.col("_stage")).alias("odd"))
    before = stages.join(last.select(name, "n_promoted"), name).where(~odd & (F.col("_stage") < F.col("n_promoted")) & (F.col("_stage") > 0)).groupBy(name).agg(F.max_by("version", "_stage").alias("before"))
    both = last.join(before, name, "left")
    return both.select(name, F.when(F.col("odd"), F.col("before")).otherwise(F.col("last")).alias("current"), F.when(F.col("odd"), F.col("last")).otherwise(F.col("before")).alias("target"), "n_promoted", "n_rejected")


def registry_stream(log: DataFrame, name: str, at: str) -> DataFrame:
    """The state of each name after every micro-batch that tells of it, by a fold over its events in the order of ``at`` and version.

    ``log`` is a stream with ``name``, ``at``, event and version. Memory is a micro-batch's events of one name and three numbers for each name.
    """

    def fold(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        current, target, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values([at, "version"])
        for event, version in zip(rows["event"], rows["version"], strict=True):
            if event == "promote":
                current, target, n = int(version), current, n + 1
            elif event == "rollback" and target is not None:
                current, target = target, current
        state.update((current, target, n))
        yield pd.DataFrame({name: [key[0]], "current": pd.array([current], dtype="Int64"), "target": pd.array([target], dtype="Int64"), "n_promoted": [n]})

    kind = log.schema[name].dataType.simpleString()
    return log.groupBy(name).applyInPandasWithState(fold, f"`{name}` {kind}, {STATE}", STATE, "update", "NoTimeout")
