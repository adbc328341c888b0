"""Queries that align gold labels with runs, and further splits, gates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import align, dedup, identity, metrics, split
from tessella.registry import query
from tessella.tables import load

GOLD = "SELECT doc_id, quality AS gold FROM labels"


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold"))


def run_rows(spark: SparkSession, sf_dir: str, modulus: int, name: str) -> DataFrame:
    """A run's answers for the labelled documents: by the length of the text."""
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return docs.select("doc_id", (F.col("n_chars") % modulus > 0).cast("int").alias(name))


def run_sql(modulus: int, name: str) -> str:
    return f"SELECT doc_id, CAST(n_chars % {modulus} > 0 AS INTEGER) AS {name} FROM documents JOIN labels USING (doc_id)"


@query(f"""
WITH g AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM ({GOLD})), r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM ({run_sql(5, 'answer')}))
SELECT gold, answer, count(*) AS n, count(*) FILTER (2 * g.doc_id <> 2 * r.doc_id + (r.doc_id % 10 = 3)::INT) AS n_other_id FROM g JOIN r USING (pos) GROUP BY ALL""")
def aligned_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and run side by side, row by row, with a check that the ids agree; a tenth of the run's ids is another."""
    twice, other = F.col("doc_id") * 2, F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0)
    run = run_rows(spark, sf_dir, 5, "answer").withColumn("doc_id", twice + other)
    both = align.by_position(gold_rows(spark, sf_dir).withColumn("doc_id", twice), run, "doc_id")
    return both.groupBy("gold", "answer").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") != F.col("run_doc_id")).alias("n_other_id"))


@query(f"""
SELECT count(*) AS n, avg(CAST(base = gold AS DOUBLE)) AS base_accuracy, avg(CAST(tuned = gold AS DOUBLE)) AS tuned_accuracy, count(*) FILTER (tuned = gold AND base <> gold) AS won, count(*) FILTER (tuned <> gold AND base = gold) AS lost
FROM ({GOLD}) JOIN ({run_sql(5, 'base')}) USING (doc_id) JOIN ({run_sql(7, 'tuned')}) USING (doc_id)""")
def aligned_base_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold, base and tuned run by id, all with the same ids."""
    both = align.by_id(gold_rows(spark, sf_dir), "doc_id", run_rows(spark, sf_dir, 5, "base"), run_rows(spark, sf_dir, 7, "tuned"))
    right = lambda c: F.col(c) == F.col("gold")
    return both.agg(
        F.count("*").alias("n"), F.avg(right("base").cast("double")).alias("base_accuracy"), F.avg(right("tuned").cast("double")).alias("tuned_accuracy"),
        F.count_if(right("tuned") & ~right("base")).alias("won"), F.count_if(~right("tuned") & right("base")).alias("lost"),
    )


@query(f"""
WITH a AS (SELECT * FROM ({run_sql(5, 'first')}) WHERE doc_id % 3 <> 0), b AS (SELECT * FROM ({run_sql(7, 'second')}) WHERE doc_id % 4 <> 0)
SELECT doc_id, second - first AS difference FROM a JOIN b USING (doc_id)""")
def paired_common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences of two runs on the ids that both have."""
    first, second = run_rows(spark, sf_dir, 5, "first").where("doc_id % 3 <> 0"), run_rows(spark, sf_dir, 7, "second").where("doc_id % 4 <> 0")
    return first.join(second, "doc_id").select("doc_id", (F.col("second") - F.col("first")).alias("difference"))


@query("""
WITH c AS (SELECT doc_id, lang, sha256(text) AS h, n_chars % 4 = 0 AS dev FROM documents), d AS (SELECT * FROM c WHERE dev AND h NOT IN (SELECT h FROM c WHERE NOT dev)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('23:' || doc_id), doc_id) AS rn FROM d)
SELECT doc_id, lang FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM d GROUP BY lang))""")
def dev_without_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development rows whose content is not in training, balanced again."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", identity.exact(F.col("text")).alias("h"), (F.col("n_chars") % 4 == 0).alias("dev"))
    dev = docs.where("dev").join(docs.where("not dev"), "h", "left_anti").select("doc_id", "lang")
    return split.balance(dev, "lang", "23", "doc_id")


@query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('29:' || source), source) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN r < floor(n * 0.8 + 1e-9) THEN 'train' WHEN r < floor(n * 0.9 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM documents JOIN g USING (source)""")
def split_group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in a seeded order, 80, 10 and 10 per cent by truncation."""
    return split.shares(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", "29", {"train": 0.8, "validation": 0.1, "test": 0.1})


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('31:' || doc_id), doc_id) <= greatest(2, floor((SELECT count(*) FROM documents) * 0.15)) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def split_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded permutation's first 15 per cent, two rows at least."""
    return split.permutation_split(load(spark, sf_dir, "documents").select("doc_id"), 0.15, "31", "doc_id")


@query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('37:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
s AS (SELECT doc_id, sha256(text) AS h, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.3, 0)::BIGINT)) THEN 'validation' ELSE 'train' END AS split FROM documents JOIN g USING (source))
SELECT split, min(doc_id) AS doc_id, count(*) AS n_copies FROM s GROUP BY split, h""")
def split_then_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups split first, then each split without repeated content."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", identity.exact(F.col("text")).alias("h"))
    return split.group_split(docs, "source", 0.3, "37").groupBy("split", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).drop("h")


@query("SELECT n_char_class, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS h, n_chars % 2 AS n_char_class FROM documents) GROUP BY h, n_char_class")
def dedup_unique_or_raise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each content; rows alike in content that differ in the label would be refused."""
    docs = load(spark, sf_dir, "documents").select("doc_id", identity.exact(F.col("text")).alias("h"), (F.col("n_chars") % 2).alias("n_char_class"))
    return dedup.unique_or_raise(docs, "h", "n_char_class", "doc_id").select("n_char_class", "doc_id")


@query("""
WITH c AS (SELECT sha256(text) AS h, count(*) AS k FROM documents GROUP BY 1) SELECT k AS n_copies, count(*) AS n_hashes, CAST(sum(k) AS BIGINT) AS n_rows FROM c GROUP BY k""")
def content_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents occur so many times."""
    copies = load(spark, sf_dir, "documents").groupBy(identity.exact(F.col("text")).alias("h")).agg(F.count("*").alias("n_copies"))
    return copies.groupBy("n_copies").agg(F.count("*").alias("n_hashes"), F.sum("n_copies").alias("n_rows"))


@query(f"""
WITH c AS (SELECT d.lang, CAST(count(*) FILTER (answer = gold) AS DOUBLE) AS k, count(*) AS n FROM ({GOLD}) JOIN ({run_sql(5, 'answer')}) USING (doc_id) JOIN documents d USING (doc_id) GROUP BY 1)
SELECT lang, k / n >= 0.65 AS point_gate, (k / n + {metrics.Z95}^2 / (2 * n) - {metrics.Z95} * sqrt(k / n * (1 - k / n) / n + {metrics.Z95}^2 / (4 * n * n))) / (1 + {metrics.Z95}^2 / n) >= 0.6 AS interval_gate FROM c""")
def point_and_interval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An accuracy gate on the estimate, and on the lower end of its interval."""
    both = align.by_id(gold_rows(spark, sf_dir), "doc_id", run_rows(spark, sf_dir, 5, "answer")).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    counts = both.groupBy("lang").agg(F.count_if(F.col("answer") == F.col("gold")).alias("k"), F.count("*").alias("n"))
    low, _ = metrics.wilson(F.col("k"), F.col("n"))
    return counts.select("lang", (F.col("k") / F.col("n") >= 0.65).alias("point_gate"), (low >= 0.6).alias("interval_gate"))


@query("""
WITH c AS (SELECT doc_id, lang AS truth, CASE n_chars % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'other' ELSE lang END AS pred FROM documents)
SELECT CASE WHEN truth <> pred THEN upper(truth) || '_AS_' || upper(pred) END AS error, count(*) AS n FROM c GROUP BY 1""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error named by truth and prediction; none where they agree."""
    c = load(spark, sf_dir, "documents").select(F.col("lang").alias("truth"), F.when(F.col("n_chars") % 6 == 0, "en").when(F.col("n_chars") % 6 == 1, "other").otherwise(F.col("lang")).alias("pred"))
    return c.groupBy(F.when(F.col("truth") != F.col("pred"), F.concat(F.upper("truth"), F.lit("_AS_"), F.upper("pred"))).alias("error")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT lang AS truth, CASE n_chars % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'other' ELSE lang END AS pred FROM documents), l AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS label),
f AS (SELECT label, 2 * count(*) FILTER (truth = label AND pred = label) / CAST(nullif(count(*) FILTER (truth = label) + count(*) FILTER (pred = label), 0) AS DOUBLE) AS f1 FROM c, l GROUP BY label)
SELECT round(avg(coalesce(f1, 0)), 9) AS macro_f1, round(min(coalesce(f1, 0)), 9) AS least_f1 FROM f""")
def macro_without_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and minimum of the classes' F1, the class for all else not among them."""
    c = load(spark, sf_dir, "documents").select(F.col("lang").alias("truth"), F.when(F.col("n_chars") % 6 == 0, "en").when(F.col("n_chars") % 6 == 1, "other").otherwise(F.col("lang")).alias("pred"))
    per = metrics.per_label(c, ["en", "de", "fr", "es", "other"]).where("label <> 'other'")
    return per.agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.round(F.min("f1"), 9).alias("least_f1"))


@query("""
WITH u AS (SELECT source, 0 AS part, doc_id AS at FROM documents WHERE lang = 'de' AND right(source, 1) IN ('0', '2', '4') UNION ALL SELECT source, 1, doc_id FROM documents WHERE lang = 'en')
SELECT source, part, at FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY part, at) = 1""".replace("AS at ", 'AS "at" ').replace("part, at", 'part, "at"'))
def ordered_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of two lists one after the other, each where it first comes."""
    docs = load(spark, sf_dir, "documents")
    return align.ordered_union("source", "doc_id", docs.where("lang = 'de' and right(source, 1) in ('0', '2', '4')"), docs.where("lang = 'en'"))
