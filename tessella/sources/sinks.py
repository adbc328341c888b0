"""Tables written together with what must be known of them: counts, sums and an order-free hash, in the pass that writes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.functions.canonical import canonical, digest
from tessella.sources.jsonl import LockedSourceError
from tessella.tables import stored


def row_number_of(df: DataFrame) -> Column:
    """48 bits of the hash of a row's canonical JSON, as a number."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kind = df.select(whole.alias("row")).schema["row"].dataType
    return F.conv(F.substring(digest(canonical(whole, kind)), 1, 12), 16, 10).cast("decimal(38,0)")


def allowed(path: str, denied: tuple[str, ...]) -> str:
    if any(part in denied for part in path.split("/")):
        raise LockedSourceError(f"results may not go to {path}")
    return path.rstrip("/")


def write_observed(df: DataFrame, path: str, counters: dict[str, Column], denied: tuple[str, ...] = ("frozen", "evaluation")) -> dict:
    """Writes ``df`` as Parquet, never over anything, and returns n_rows, row_hash and ``counters``, taken while writing.

    ``row_hash`` is the sum of the rows' hashes: the same for every order and partitioning, another for a repeated row.
    """
    seen = Observation()
    metrics = [F.count("*").alias("n_rows"), F.sum(row_number_of(df)).alias("row_hash"), *(c.alias(k) for k, c in counters.items())]
    df.observe(seen, *metrics).write.mode("errorifexists").parquet(allowed(path, denied))
    found = seen.get
    return {"n_rows": int(found["n_rows"]), "row_hash": int(found["row_hash"] or 0), **{k: found[k] for k in counters}}


def fan_out(df: DataFrame, folder: str, outputs: dict[str, Column], counters: dict[str, Column] | None = None) -> dict[str, dict]:
    """One table as several: ``folder``/<name> for each output (rows for which its Column is true), and their manifest.

    The source is read and computed once, into a table that the outputs are cut from; what each of them
    holds is observed as it is written. The manifest goes to ``folder``/manifest as a row of JSON with sorted keys for each output.
    Nothing is overwritten: an output that exists is an error.
    """
    spark, whole = df.sparkSession, stored(df, "fan-out")
    manifest = {name: write_observed(whole.where(test), f"{folder}/{name}", counters or {}) for name, test in outputs.items()}
    rows = [(name, json.dumps(m, sort_keys=True, separators=(",", ":"))) for name, m in sorted(manifest.items())]
    spark.createDataFrame(rows, "name string, content string").coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return manifest
