"""Audits: rule violations, split manifests, names one edit apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.identity import number


def violations(df: DataFrame, key: str, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """A row (key, rule) for every rule a row breaks; a null test is not broken.

    All rules are tested in one pass. ``strict`` raises if any row breaks one.
    """
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    found = df.select(key, F.explode(broken).alias("rule"))
    if strict and (some := found.limit(20).collect()):
        raise ValueError(f"rules broken, among them {[tuple(r) for r in some]}")
    return found


def manifest(df: DataFrame, locked: tuple[str, ...] = ()) -> DataFrame:
    """Each split's counts and one hash of its contents (``split``, ``h``, ``lang``, ``source``).

    The contents' hash is that of the sum of their hashes' heads: rows in any order give the same,
    and nothing is gathered.
    """
    return df.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_english"), F.countDistinct("source").alias("n_groups"), F.countDistinct("h").alias("n_unique"),
        F.sha2(F.sum(number(F.col("h"), 12, hashed=True).cast("decimal(38,0)")).cast("string"), 256).alias("content_sha256"), F.col("split").isin(*locked).alias("locked"),
    )


def edit_neighbours(names: DataFrame, name: str) -> DataFrame:
    """Pairs (name, neighbour) at edit distance 1, without comparing all names.

    Two strings one edit apart share a string that either becomes by deleting one character, or
    is itself: names are joined on those and compared where they meet.
    """
    c = F.col(name)
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    keys = names.select(name, F.explode(F.array_distinct(F.concat(F.array(c), without))).alias("_key"))
    other = keys.withColumnRenamed(name, "neighbour")
    return keys.join(other, "_key").where(F.levenshtein(name, "neighbour") == 1).select(name, "neighbour").distinct()


def split_disjoint(df: DataFrame, split: str, *keys: str) -> DataFrame:
    """(key, value) that occur in more than one split: must be empty. One pass, no join of splits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("p")
    return df.select(split, pairs).groupBy("p.key", "p.value").agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi").drop("lo", "hi")


# fixed values: what a relation may be, who vouches for it, and the groups that splits must not share
RELATIONS, REVIEW, GROUPS = ("CONNECTED", "DISCONNECTED", "UNKNOWN"), ("reviewer", "rationale", "reference"), ("repository", "framework", "template", "generator")


def relation_reasons(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``reason``: the first rule of a relation corpus that a row breaks, ``ok`` if none.

    Rows have split, id, content, label, status, native, and a column for each of ``REVIEW`` and ``GROUPS``. A row whose
    content or id an earlier one of its split has (by ``order``) is a duplicate; ``not-applicable`` stands
    only for a template or generator of native code.
    """
    blank = lambda c: F.coalesce(F.btrim(F.col(c), F.lit(" \t\r\n\f\v")) == "", F.lit(True))
    some = lambda cs: F.exists(F.array(*[blank(c) for c in cs]), lambda x: x)
    for key in ("content", "id"):
        first = df.groupBy("split", key).agg(F.min(order).alias(f"_first_{key}"))
        df = df.join(first.where(F.col(key).isNotNull()), ["split", key], "left")
    na = lambda c: F.coalesce(F.btrim(F.col(c)) == "not-applicable", F.lit(False))
    unfit = na("repository") | na("framework") | ((na("template") | na("generator")) & ~F.coalesce(F.col("native"), F.lit(False)))
    reason = (
        F.when(~F.coalesce(F.col("label").isin(*RELATIONS), F.lit(False)), "label").when(blank("id"), "id").when(~F.col("status").eqNullSafe(F.lit("REVIEWED")) | some(REVIEW), "review")
        .when(some(GROUPS), "provenance").when(unfit, "not_applicable").when((F.col(order) != F.col("_first_content")) | (F.col(order) != F.col("_first_id")), "duplicate").otherwise("ok")
    )
    return df.withColumn("reason", reason).drop("_first_content", "_first_id")


def relation_overlap(df: DataFrame) -> DataFrame:
    """Rows (key, n): how many values of each key more than one split has; not-applicable counts as none."""
    known = [F.when(F.btrim(F.col(g)) != "not-applicable", F.btrim(F.col(g))).alias(g) for g in GROUPS]
    shared = split_disjoint(df.select("split", "id", "content", *known), "split", *GROUPS, "content", "id").where("value is not null")
    return shared.groupBy("key").agg(F.count("*").alias("n"))


# fixed values: annotations that tell of the next line
ANNOTATION, MEANS_SAFE = r"(?:ruleid|ok)\s*:\s*([\w.-]+)", r"\bok\s*:"


def annotated(lines: DataFrame, key: str, at: str, line: str) -> DataFrame:
    """Rows (key, at, rule, label, target): each annotation with the next line that is not blank, and what it says of it.

    An annotation that no such line follows is left out. A file's lines are looked through once, from its end.
    """
    w = Window.partitionBy(key).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.btrim(F.col(line), F.lit(" \t\r\n\f")) != "", F.col(at)), ignorenulls=True).over(w)
    found = lines.withColumn("target", following).where(F.col(line).rlike(ANNOTATION) & F.col("target").isNotNull())
    return found.select(key, at, F.lower(F.regexp_extract(line, ANNOTATION, 1)).alias("rule"), F.when(F.col(line).rlike(MEANS_SAFE), "SAFE").otherwise("UNSAFE").alias("label"), "target")


def pinned(rows: DataFrame, pins: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``reason``: unpinned, wrong_revision, wrong_license, duplicate_identity or ok.

    Rows have repository, revision, path and license; ``pins`` has one row (repository, revision, license) for each
    repository, and two are refused. An identity is (repository, revision, path); of rows alike in it the first by ``order`` stands.
    """
    if twice := [r["repository"] for r in pins.groupBy("repository").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"pinned more than once, among them {twice}")
    identity = ["repository", "revision", "path"]
    first = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in identity]).agg(F.min(order).alias("_first"))
    known = pins.select("repository", F.col("revision").alias("_revision"), F.col("license").alias("_license"), F.lit(True).alias("_pinned"))
    held = rows.join(first, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in identity]).join(known, "repository", "left")
    reason = (
        F.when(F.col("_pinned").isNull(), "unpinned").when(~F.col("revision").eqNullSafe(F.col("_revision")), "wrong_revision").when(~F.col("license").eqNullSafe(F.col("_license")), "wrong_license")
        .when(F.col(order) != F.col("_first"), "duplicate_identity").otherwise("ok")
    )
    return held.select(*rows.columns, reason.alias("reason"))
