"""Line dedup by winnowing over line hashes, in DataFrame and SQL functions only.

A line here ends at a line break or where a sentence does, so that a passage pasted into the middle of a line is
seen as well. Where it has more than ``LONG_CHARS`` characters it is cut further, after commas and words that end in one of a few
letters, so that passages with hardly a full stop are seen too. A run is two lines with
``RUN_CHARS`` characters together, or else ``WINDOW`` lines. Every run selects its smallest line hash (the leftmost on ties), hashes of longer lines being smaller than
those of short ones, which recur by chance; the selected positions are
the document's fingerprints. Two documents that share a run share a fingerprint in it: that is winnowing's
guarantee. Fingerprints that occur at two positions or more are joined back to their positions
and extended to both sides over every run that holds them. A run that also
occurs earlier (in a smaller document id, or further up in the same document) makes its lines
go; runs that overlap or touch make one. So what goes is exactly the lines in repeated
runs, and the first occurrence stays.

No pairs are formed: each fingerprint is reduced to its count, and each run to its first
position, before it is joined, so that a passage that a third of all documents share costs one
row for each of its occurrences. Runs are told apart by 96 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored

#: A run is two lines if they have so many characters together, or else so many lines.
WINDOW, RUN_CHARS = 4, 80
#: One line with what ends it; lines joined give the text again.
LINE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
#: Longer lines are cut after each of these with a space.
LONG_CHARS, CUT = 80, r"[,;:hpx][ \t]"
#: Lines of so many characters have the smaller hashes.
SHORT_CHARS = 20
TRIMMED = " \n\t\r"


def once(value: Column, name: str) -> Column:
    """``value`` as a column that is computed once a row: lambdas that use it would each compute it anew."""
    return F.explode(F.array(value)).alias(name)


def lines_of(text: Column) -> Column:
    whole = F.regexp_extract_all(text, F.lit(LINE), F.lit(0))
    return F.flatten(F.transform(whole, lambda x: F.when(F.length(x) > LONG_CHARS, F.split(x, f"(?<={CUT})")).otherwise(F.array(x))))


def line_hash(line: Column) -> Column:
    """The hash of a trimmed line: negative for longer lines, so that these are the minima."""
    h = F.xxhash64(line)
    return F.when(F.length(line) >= SHORT_CHARS, h.bitwiseOR(F.lit(-(1 << 63)))).otherwise(h.bitwiseAND(F.lit((1 << 63) - 1)))


def _byte(value: int) -> Column:
    return F.lit(value).cast("byte")


def _chosen() -> Column:
    """Where the smallest hash of each run in columns h and n is; ``two`` holds where the smaller of a line's hash and the next one's is."""
    at = lambda i: F.get("two", i)
    four = lambda i: F.when(F.get("h", at(i)) <= F.get("h", at(i + 2)), at(i)).otherwise(at(i + 2))
    least = F.transform("n", lambda n, i: F.when(n == _byte(2), at(i)).when(n == _byte(WINDOW), four(i)).otherwise(-1))
    return F.array_remove(F.array_distinct(least), -1)


def _lined(docs: DataFrame) -> DataFrame:
    """Stored rows (uid, doc_id, hash, h, n, chosen): line hashes, the lines of the run that starts at each, fingerprint positions.

    ``uid`` is in the order of the documents. Ids that are distinct serve as they are; otherwise documents
    are numbered in the order of id and hash.
    """
    own = docs.select("doc_id", "hash", once(F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(TRIMMED))), "t"))
    own = own.where(F.size("t") > 1).select("doc_id", "hash", F.transform("t", line_hash).alias("h"), F.transform("t", lambda x: F.length(x)).alias("c"))
    runs = F.transform("c", lambda c, i: F.when(c + F.get("c", i + 1) >= RUN_CHARS, _byte(2)).when(i <= F.size("c") - WINDOW, _byte(WINDOW)).otherwise(_byte(0)))
    smaller = F.transform("h", lambda h, i: F.when(h <= F.get("h", i + 1), i).otherwise(i + 1))
    own = own.select("doc_id", "hash", "h", once(runs, "n"), once(smaller, "two"))
    own = own.select("doc_id", "hash", "h", "n", once(_chosen(), "chosen")).where(F.size("chosen") > 0)  # once: the condition would compute it anew
    if docs.agg(F.count("*") == F.count_distinct("doc_id")).first()[0]:
        return stored(own.select(F.col("doc_id").alias("uid"), "doc_id", "hash", "h", "n", "chosen"), "line-hashes")
    own = stored(own.dropDuplicates(["doc_id", "hash"]), "line-hashes")
    order = [F.asc_nulls_last("doc_id"), F.asc("hash")]
    keys = stored(own.select("doc_id", "hash").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "line-documents")
    sizes = keys.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("low")).alias("base"))  # a row per partition
    numbered = keys.join(F.broadcast(base), "part").select((F.col("row") + F.col("base")).alias("uid"), F.col("doc_id").alias("k_id"), F.col("hash").alias("k_hash"))
    joined = own.join(numbered, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
    return stored(joined.select("uid", "doc_id", "hash", "h", "n", "chosen"), "line-hashes")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, hash, runs): start and lines of the runs that occur earlier; ``docs`` has doc_id, hash, text.

    Each step is a table of its own.
    """
    lined = _lined(docs)
    seeds = lined.select("uid", F.inline(F.transform("chosen", lambda i: F.struct(F.get("h", i).alias("seed"), i.alias("at")))))
    repeated = stored(seeds.groupBy("seed").count().where("count > 1").select("seed"), "repeated-seeds")
    met = stored(seeds.join(repeated, "seed").groupBy("uid").agg(F.collect_list("at").alias("seeds")), "seed-positions")
    around = lambda p: F.filter(F.sequence(F.greatest(p - WINDOW + 1, F.lit(0)), p), lambda s: s + F.get("n", s) > p)
    starts = F.array_distinct(F.flatten(F.transform("seeds", around)))
    run = lambda i: [F.get("h", i + k) if k < 2 else F.when(F.get("n", i) == _byte(WINDOW), F.get("h", i + k)) for k in range(WINDOW)]
    each = lambda i: F.struct(F.xxhash64(*run(i)).alias("run"), F.hash(*run(i)).alias("check"), i.alias("at"), F.get("n", i).alias("n"))
    near = stored(lined.select("uid", "h", "n").join(met, "uid").select("uid", F.inline(F.transform(starts, each))), "line-runs")
    number = F.col("uid").cast("decimal(19,0)")
    narrow = lined.agg(F.coalesce(F.bool_and(number.between(-(1 << 32), (1 << 32) - 1)), F.lit(True))).first()[0]  # a place is then a long, otherwise a decimal
    place = F.col("uid").cast("long") * F.lit(1 << 31) + F.col("at") if narrow else number * F.lit(1 << 31).cast("decimal(10,0)") + F.col("at")
    # a table of its own: a join of two plain shuffles is one that Spark can split where a run is hot
    earliest = stored(near.groupBy("run", "check").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "first-runs")
    later = near.join(earliest, ["run", "check"]).where(place > F.col("first")).groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return stored(later.join(lined.select("uid", "doc_id", "hash"), "uid").select("doc_id", "hash", "runs"), "later-runs")


def drop_repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, doc_id, text, removed_lines): ``row`` holds all columns as they came.

    Documents are ordered by id, nulls last, then by their text's hash. Rows alike in both count
    as one document, and all keep or lose the same lines. A null text stays null; a
    text without a run stays as it is; one whose lines all go becomes empty. Repeated rows, ties of
    id and text, are thus all cleaned alike, an empty table stays empty, and no column's name clashes.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("hash", F.xxhash64("text"))
    by_doc = repeated_runs(own.select("doc_id", "hash", "text")).withColumnsRenamed({"doc_id": "f_id", "hash": "f_hash"})
    joined = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")), "left")
    lines = lines_of(F.col("text"))
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1))))
    joined = joined.select("row", "doc_id", "text", gone.alias("gone")).withColumn("lines", once(F.when(F.col("gone").isNotNull(), lines), "lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "")
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, repeated runs gone from ``text`` and ``n_chars`` to match."""
    cleaned = drop_repeated_runs(docs)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return cleaned.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = rf"""
WITH lined AS (
  SELECT doc_id, text, flatten(list_transform(regexp_extract_all(text, '{LINE}'),
    lambda x: CASE WHEN length(x) > {LONG_CHARS} THEN string_split(regexp_replace(x, '({CUT})', '\1' || chr(1), 'g'), chr(1)) ELSE [x] END)) AS lines FROM documents
), trimmed AS (
  SELECT doc_id, list_transform(lines, lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))) AS t FROM lined
), sized AS (
  SELECT doc_id, i, t, length(t[i]) + length(t[i + 1]) AS two
  FROM trimmed, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)
), runs AS (
  SELECT doc_id, i, t, CASE WHEN two >= {RUN_CHARS} THEN 2 WHEN i + {WINDOW} - 1 <= len(t) THEN {WINDOW} ELSE 0 END AS n FROM sized
), later AS (
  SELECT doc_id, i, n FROM runs WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY t[i:i + n - 1] ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS line FROM later, LATERAL (SELECT unnest(range(0, n)) AS k)
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM lined
), kept AS (
  SELECT n.doc_id, string_agg(CASE WHEN g.line IS NULL THEN n.line ELSE '' END, '' ORDER BY n.pos) AS text,
         count(g.line) AS removed_lines
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.line = n.pos GROUP BY n.doc_id
)
SELECT l.doc_id, coalesce(k.text, l.text) AS text, CAST(coalesce(k.removed_lines, 0) AS INTEGER) AS removed_lines
FROM lined l LEFT JOIN kept k USING (doc_id)
"""
