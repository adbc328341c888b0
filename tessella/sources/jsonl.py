"""JSON Lines in and out: explicit schemas, guards on what may be read and where results may go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class LockedSourceError(PermissionError):
    """A locked split was to be read, or a forbidden path to be used."""


def training_input(path: str, allowed: tuple[str, ...] = ("data/training",), denied: tuple[str, ...] = ("frozen", "evaluation", "reports")) -> str:
    """``path`` itself, if it lies under an allowed folder and in no denied one; anything else is refused.

    Folders are whole segments; a path that steps up is refused, since where it leads cannot be told from its text.
    """
    parts = [p for p in path.split("://", 1)[-1].split("/") if p not in ("", ".")]
    inside = any(parts[i : i + len(a)] == a for a in (x.split("/") for x in allowed) for i in range(len(parts) - len(a)))
    if ".." in parts or not inside or any(p in denied for p in parts):
        raise LockedSourceError(f"no training input: {path}")
    return path


def read(spark: SparkSession, path: str, schema: StructType, defaults: dict | None = None, limit: int | None = None) -> DataFrame:
    """Rows of one or more files (a glob will do), with their file; blank lines are skipped.

    ``defaults`` fill missing values, as strings or numbers of the column's type.
    """
    df = spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_name"))
    df = df.na.fill(defaults) if defaults else df
    return df.limit(limit) if limit is not None else df


def read_split(spark: SparkSession, folder: str, split: str, schema: StructType, locked: tuple[str, ...] = ("test",), unlock: bool = False) -> DataFrame:
    """A split by name; a locked one only with ``unlock``."""
    if split in locked and not unlock:
        raise LockedSourceError(f"split {split} is locked")
    return read(spark, f"{folder}/{split}.jsonl", schema).withColumn("split", F.lit(split))


def read_summaries(spark: SparkSession, glob: str, schema: StructType, required: str) -> DataFrame:
    """Whole-file JSON documents; malformed ones and those without ``required`` are left out."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(glob)
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).where(F.col(required).isNotNull())


def source_tree(spark: SparkSession, folder: str, extensions: tuple[str, ...], excluded: str = r"/(?:node_modules|vendor|dist)/|\.min\.") -> DataFrame:
    """Source files under ``folder``: path, bytes, text and content hash, vendored and minified ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    return files.where(~F.col("path").rlike(excluded)).select("path", "content", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def numbered_lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """A row per line, numbered from 1."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def verified_spans(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Spans (path, start_byte, end_byte, excerpt) with ``ok``: the snapshot's bytes (``content``) are the excerpt's."""
    raw = files.select("path", F.col("content").alias("_raw"))
    joined = spans.join(raw, "path", "left")
    cut = F.expr("substring(_raw, start_byte + 1, end_byte - start_byte)")
    return joined.withColumn("ok", F.coalesce(cut == F.encode("excerpt", "UTF-8"), F.lit(False))).drop("_raw")


def frozen(files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Files whose hash is not the expected one, or that are missing: must be empty."""
    want = files.sparkSession.createDataFrame(list(expected.items()), "path string, expected string")
    return want.join(files.select("path", "sha256"), "path", "left").where(~F.col("expected").eqNullSafe(F.col("sha256")))


def write(df: DataFrame, path: str, denied: tuple[str, ...] = ("frozen", "evaluation"), overwrite: bool = False) -> None:
    """JSON Lines with keys in order; forbidden folders are refused and nothing is overwritten unasked."""
    if any(part in denied for part in path.split("/")):
        raise LockedSourceError(f"results may not go to {path}")
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").json(path)
