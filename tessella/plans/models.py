"""Queries on linear classifiers: scores from a model that SQL can derive, and a fit by regression."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import linear
from tessella.operators import metrics as m
from tessella.operators.split import hash_mod
from tessella.registry import query
from tessella.tables import load, shared_folder

#: Terms of the model that SQL derives, and of the fitted one.
TERMS, FITTED_TERMS = 1000, 12_000
TEST = "('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 3 = 0"


def divided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents to learn from and documents to test on, by the hash of their id."""
    own = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", hash_mod(F.col("doc_id").cast("string")).alias("split"))
    return own.where("split = 'train' and lang is not null"), own.where("split = 'test'")


@query(rf"""
WITH d AS (SELECT doc_id, text, lang, {TEST} AS test FROM documents), train AS (SELECT * FROM d WHERE NOT test AND lang IS NOT NULL),
w AS (SELECT doc_id, test, lang, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM d WHERE text IS NOT NULL AND (test OR lang IS NOT NULL)),
t AS (SELECT doc_id, test, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT doc_id, test, lang, term, count(*) AS n FROM t GROUP BY ALL),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM train WHERE text IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM c WHERE NOT test GROUP BY term ORDER BY sum(n) DESC, term LIMIT {TERMS}),
x AS (SELECT doc_id, test, lang, term, (1 + ln(n)) * idf AS w FROM c JOIN v USING (term)),
u AS (SELECT doc_id, test, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS z FROM x),
l AS (SELECT lang, count(*) AS n FROM train GROUP BY lang),
mean AS (SELECT term, sum(z) / (SELECT count(*) FROM train) AS m FROM u WHERE NOT test GROUP BY term),
s AS (SELECT term, lang, sum(z) AS s FROM u WHERE NOT test GROUP BY ALL),
b AS (SELECT mean.term, l.lang, 10 * (coalesce(s, 0) / l.n - m) AS b FROM mean CROSS JOIN l LEFT JOIN s ON s.term = mean.term AND s.lang = l.lang),
g AS (SELECT doc_id, b.lang, sum(z * b) AS logit FROM u JOIN b USING (term) WHERE test GROUP BY ALL),
p AS (SELECT d.doc_id, l.lang AS label, coalesce(logit, 0) AS logit FROM d CROSS JOIN l LEFT JOIN g ON g.doc_id = d.doc_id AND g.lang = l.lang WHERE d.test)
SELECT doc_id, label, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY doc_id), 6) AS probability FROM p""")
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's probability for each test document, by the centroids of the others."""
    train, test = divided(spark, sf_dir)
    model = linear.centroid_model(train, "doc_id", "text", "lang", TERMS)
    return linear.scores(test, "doc_id", "text", model, TERMS).select("doc_id", "label", F.round("probability", 6).alias("probability"))


@query()
def linear_fit_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label precision, recall and F1 on test documents of a regression fitted on the others, and their macro mean."""
    train, test = divided(spark, sf_dir)
    model = linear.fit(train, "doc_id", "text", "lang", f"{shared_folder(spark)}/linear-{uuid.uuid4().hex}", FITTED_TERMS)
    found = linear.predicted(linear.scores(test.where("lang is not null"), "doc_id", "text", model, FITTED_TERMS), "doc_id")
    both = test.select("doc_id", F.col("lang").alias("gold")).join(found, "doc_id")
    labels = [r["label"] for r in model.intercepts.select("label").orderBy("label").collect()]  # the model's labels
    return m.per_label(both.withColumnRenamed("label", "predicted"), labels, "gold", "predicted")
