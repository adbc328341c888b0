"""Nested provenance: an original by three hashes, a fragment inside it, the input made from the fragment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bytes_of(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def git_blob(content: Column) -> Column:
    """The identity that git gives to a file's bytes."""
    return F.sha1(F.concat(bytes_of(F.concat(F.lit("blob "), F.octet_length(content).cast("string"))), F.lit(bytearray(b"\0")), content))


def static_input(fragment: Column, kind: Column) -> Column:
    """What a case of this kind makes of its fragment: a callback is bound to a name, others stay."""
    return F.when(kind.endswith("callback"), F.concat(F.lit("const externalCallback = "), fragment, F.lit(";"))).otherwise(fragment)


def checked(cases: DataFrame, sources: DataFrame, source: str, case_id: str, order: str) -> DataFrame:
    """``cases`` with ``reason``: the first check that fails, ``ok`` if none does.

    Cases have kind, fragment, code, source_sha256, blob_sha1 and fragment_sha256; sources have ``source`` and content
    (bytes). A case whose id an earlier one has (by ``order``) is a duplicate. Fragments are sought in the original's bytes.
    """
    first = cases.groupBy(case_id).agg(F.min(order).alias("_first"))
    held = cases.join(first, case_id).join(sources.select(source, F.col("content").alias("_raw")), source, "left")
    raw, piece = F.col("_raw"), bytes_of(F.col("fragment"))
    reason = (
        F.when(F.col(order) != F.col("_first"), "duplicate_identity")
        .when(raw.isNull(), "missing_original")
        .when(~F.sha2(raw, 256).eqNullSafe(F.col("source_sha256")), "source_hash")
        .when(~git_blob(raw).eqNullSafe(F.col("blob_sha1")), "blob_identity")
        .when(~F.coalesce(F.contains(raw, piece), F.lit(False)), "fragment_outside")
        .when(~F.sha2(piece, 256).eqNullSafe(F.col("fragment_sha256")), "fragment_hash")
        .when(~F.col("code").eqNullSafe(static_input(F.col("fragment"), F.col("kind"))), "static_input")
        .otherwise("ok")
    )
    return held.withColumn("reason", reason).drop("_first", "_raw")
