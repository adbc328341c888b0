"""Checks of an external holdout against its development set: by case, by dataset, by manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a manifest must say
DECLARED = {
    "dataset_is_not_external_holdout": ("evaluation_kind", "external_holdout"), "dataset_already_exposed_or_unverified": ("exposure_status", "unseen"),
    "freeze_order_unverified": ("frozen_before_engine_changes", True), "development_inventory_incomplete": ("development_inventory_complete", True),
}
LABELS = ("unsafe", "safe")


def fingerprint(code: Column) -> Column:
    """The hash of a text without any white space."""
    return F.sha2(F.regexp_replace(code, r"(?U)\s+", "").cast("binary"), 256)


def filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def case_reasons(cases: DataFrame, development: DataFrame, order: str, authors: tuple[str, ...] = ()) -> DataFrame:
    """``cases`` with ``reasons``, all codes that speak against each, sorted; and its ``fingerprint``.

    Cases have id, code, label, repository, revision, path, family, reviewer, evidence_ref, semantic_reason,
    safe_by_nonexecution_only and executed; ``development`` has code and repository. Of cases alike in id or fingerprint
    the first by ``order`` stands. A case without code is told of its id and that alone. What is compared are one row per
    fingerprint, id and repository, so groups of copies of any size meet in aggregates.
    """
    own = cases.withColumn("fingerprint", F.when(filled(F.col("code")), fingerprint(F.col("code"))))
    for key in ("id", "fingerprint"):
        first = own.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(f"_first_{key}"))
        own = own.join(first, key, "left")
    known = development.select(fingerprint(F.col("code")).alias("fingerprint")).where("fingerprint is not null").distinct().withColumn("_dev_code", F.lit(True))
    places = development.select("repository").where("repository is not null").distinct().withColumn("_dev_place", F.lit(True))
    own = own.join(known, "fingerprint", "left").join(places, "repository", "left")
    c = F.col
    immutable = filled(c("repository")) & F.coalesce(c("revision").rlike(r"^[0-9a-f]{40}\z"), F.lit(False)) & filled(c("path"))
    codes = {
        "development_code_overlap": c("_dev_code"), "repeated_holdout_code": c(order) != c("_first_fingerprint"), "label_not_adjudicated": ~F.coalesce(c("label").isin(*LABELS), F.lit(False)),
        "immutable_external_source_missing": ~immutable, "development_repository_overlap": c("_dev_place"), "source_family_missing": ~filled(c("family")),
        "independent_label_review_missing": ~(filled(c("reviewer")) & filled(c("evidence_ref")) & filled(c("semantic_reason"))), "reviewer_is_engine_author": c("reviewer").isin(*authors) if authors else F.lit(False),
        "negative_browser_result_is_not_safe_ground_truth": ~c("safe_by_nonexecution_only").eqNullSafe(F.lit(False)), "positive_execution_evidence_missing": (c("label") == "unsafe") & ~c("executed").eqNullSafe(F.lit(True)),
    }
    identity = F.when(~filled(c("id")) | (c(order) != c("_first_id")), "missing_or_duplicate_case_id")
    absent = F.when(c("fingerprint").isNull(), "source_code_missing")
    rest = [F.when(absent.isNull() & test, code) for code, test in codes.items()]
    return own.withColumn("reasons", F.array_sort(F.array_compact(F.array(identity, absent, *rest)))).drop("_first_id", "_first_fingerprint", "_dev_code", "_dev_place")


def report(judged: DataFrame, manifest: dict, per_class: int = 100, repositories: int = 5, families: int = 10) -> DataFrame:
    """Rows (reason, n): how many cases each code speaks against; what speaks against the whole counts once.

    Only cases with code count for classes, repositories and families.
    """
    spark = judged.sparkSession
    by_case = judged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    whole = judged.where("fingerprint is not null").agg(
        *(F.count_if(F.col("label") == x).alias(x) for x in LABELS), F.countDistinct(F.when(filled(F.col("repository")), F.col("repository"))).alias("places"), F.countDistinct(F.when(filled(F.col("family")), F.col("family"))).alias("kinds")
    )
    few = {"insufficient_cases_per_class": F.least(*LABELS) < per_class, "insufficient_disjoint_source_repositories": F.col("places") < repositories, "insufficient_source_families": F.col("kinds") < families}
    by_set = whole.select(F.explode(F.array_compact(F.array(*[F.when(test, code) for code, test in few.items()]))).alias("reason"), F.lit(1).cast("long").alias("n"))
    said = [code for code, (key, want) in DECLARED.items() if manifest.get(key) is not want and manifest.get(key) != want or (want is True and manifest.get(key) is not True)]
    said += ["representative_sampling_plan_missing"] if manifest.get("sampling_plan_ref") is None else []
    return by_case.unionByName(by_set).unionByName(spark.createDataFrame([(code, 1) for code in said], "reason string, n long"))
