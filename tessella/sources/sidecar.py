"""Summaries of runs, one folder each, with the side files that lie beside them."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def runs(spark: SparkSession, base: str, summary: tuple[str, StructType], sides: dict[str, tuple[str, StructType]], markers: dict[str, str]) -> DataFrame:
    """A row per folder under ``base`` with a summary: run, summary, a column for each side file and each marker, corrupt.

    ``summary`` and ``sides`` name JSON files and their schemas; ``markers`` name files that need only exist. Files are
    read once and met by their folder, from the file's own path. A side file that is absent or
    malformed is null; ``corrupt`` counts the malformed ones, the summary included, whose column is then null too.
    """
    listed = lambda names: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(base)
    files = listed([summary[0], *(f for f, _ in sides.values())])
    place = F.regexp_replace("path", "^([^:/]+):/+", "$1:/")
    own = files.select(F.regexp_extract(place, r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(place, r"^(.*)/[^/]+$", 1).alias("_folder"), F.regexp_extract(place, r"([^/]+)$", 1).alias("_file"), F.decode("content", "UTF-8").alias("_text"))

    def parsed(file: str, schema: StructType) -> F.Column:
        withheld = StructType([*schema.fields]).add("_corrupt_record", "string")
        return F.max(F.when(F.col("_file") == file, F.from_json("_text", withheld, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))

    found = own.groupBy("_folder", "run").agg(
        parsed(*summary).alias("summary"), *(parsed(*s).alias(k) for k, s in sides.items()), F.max(F.col("_file") == summary[0]).alias("_has")
    )
    bad = {k: F.coalesce(F.col(k)["_corrupt_record"].isNotNull(), F.lit(False)) for k in ("summary", *sides)}
    corrupt = sum((b.cast("int") for b in bad.values()), F.lit(0))
    columns = [F.when(~bad[k], F.col(k).dropFields("_corrupt_record")).alias(k) for k in bad]
    # a marker may be empty, and scans pass over empty files: its place is taken from the listing, which the driver has anyway
    there = spark.createDataFrame([tuple(re.sub("^([^:/]+):/+", r"\1:/", unquote(x)).rsplit("/", 1)) for x in (listed(markers.values()).inputFiles() if markers else [])], "_folder string, _marker string")
    there = there.groupBy("_folder").agg(F.collect_set("_marker").alias("_markers"))
    marked = found.where("_has").join(there, "_folder", "left")
    seen = [F.coalesce(F.array_contains("_markers", f), F.lit(False)).alias(k) for k, f in markers.items()]
    return marked.select("run", *columns, *seen, corrupt.alias("corrupt"))
