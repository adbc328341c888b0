"""Queries on metrics, gates on metrics, and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import metrics as m
from tessella.registry import query
from tessella.tables import load

P = """p AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 AS gold, l.toxic = 1 AS toxic, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS conf,
  CASE WHEN d.n_chars % 100 >= 30 THEN 'vulnerable' WHEN d.n_chars % 100 < 20 THEN 'safe' ELSE 'abstain' END AS pred FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT *, CASE WHEN pred = 'abstain' THEN 'abstain' WHEN gold AND pred = 'vulnerable' THEN 'tp' WHEN NOT gold AND pred = 'safe' THEN 'tn' WHEN NOT gold THEN 'fp' ELSE 'fn' END AS cell FROM p)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a truth, a confidence and a three-way prediction by rule."""
    docs = load(spark, sf_dir, "documents").drop("text").join(load(spark, sf_dir, "labels"), "doc_id")
    last = F.col("n_chars") % 100
    pred = F.when(last >= 30, "vulnerable").when(last < 20, "safe").otherwise("abstain")
    return docs.select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("gold"), (F.col("toxic") == 1).alias("toxic"), (last.cast("double") / 100).alias("conf"), pred.alias("pred"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {P} SELECT lang, cell, count(*) AS n FROM c GROUP BY ALL")
def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = predicted(spark, sf_dir).withColumn("cell", m.cell(F.col("gold"), F.col("pred")))
    return cells.groupBy("lang", "cell").agg(F.count("*").alias("n"))


@query(f"""
WITH {P}, s AS (SELECT lang, count(*) AS n, count(*) FILTER (cell = 'tp') AS tp, count(*) FILTER (cell = 'tn') AS tn, count(*) FILTER (cell = 'fp') AS fp, count(*) FILTER (cell = 'fn') AS fn,
  count(*) FILTER (cell = 'abstain') AS abstain, count(*) FILTER (gold) AS n_vulnerable, avg((conf - (cell IN ('tp', 'tn'))::INT)^2) FILTER (pred <> 'abstain') AS brier FROM c GROUP BY lang),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM s)
SELECT lang, n, tp, tn, fp, fn, abstain, n_vulnerable, round(brier, 6) AS brier, round(coalesce((tp + tn) / nullif(n - abstain, 0), 0), 6) AS accuracy_decided, round((tp + tn) / n, 6) AS accuracy_all,
 round(pr, 6) AS precision_vuln, round(re, 6) AS recall_vuln, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1_vuln,
 round(coalesce(fp / nullif(n - n_vulnerable, 0), 0), 6) AS false_positive_rate, round(coalesce(fn / nullif(n_vulnerable, 0), 0), 6) AS false_negative_rate, round(abstain / n, 6) AS abstention_rate FROM r""")
def metrics_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.scorer(predicted(spark, sf_dir), "lang"))


@query(f"""
WITH {P}, s AS (SELECT count(*) AS n, count(*) FILTER (gold) AS unsafe, count(*) FILTER (NOT gold) AS safe, count(*) FILTER (cell = 'tp') AS tp, count(*) FILTER (cell = 'fp') AS fp,
  count(*) FILTER (gold AND pred = 'safe') AS missed, count(*) FILTER (gold AND pred = 'abstain') AS ua, count(*) FILTER (NOT gold AND pred = 'abstain') AS sa FROM c)
SELECT 'decision' AS convention, round(tp / unsafe, 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(fp / safe, 6) AS fpr, round((n - ua - sa) / n, 6) AS coverage FROM s UNION ALL
SELECT 'strict', round(tp / unsafe, 6), round(tp / nullif(tp + fp, 0), 6), round(fp / safe, 6), round(1 - sa / safe, 6) FROM s UNION ALL
SELECT 'abstain_is_error', round(tp / unsafe, 6), round(tp / nullif(tp + fp + sa, 0), 6), round((fp + sa) / safe, 6), 1.0 FROM s UNION ALL
SELECT 'decided_only', round(tp / (tp + missed), 6), round(tp / nullif(tp + fp, 0), 6), round(fp / (safe - sa), 6), round((n - ua - sa) / n, 6) FROM s""")
def metrics_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    counts = predicted(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(g).alias("unsafe"), F.count_if(~g).alias("safe"), F.count_if(g & (p == "vulnerable")).alias("tp"), F.count_if(~g & (p == "vulnerable")).alias("fp"),
        F.count_if(g & (p == "safe")).alias("missed"), F.count_if(g & (p == "abstain")).alias("ua"), F.count_if(~g & (p == "abstain")).alias("sa"),
    )
    n, unsafe, safe, tp, fp, missed, ua, sa = (F.col(c) for c in counts.columns)
    rows = {
        "decision": (m.ratio(tp, unsafe), m.ratio(tp, tp + fp), m.ratio(fp, safe), (n - ua - sa) / n),
        "strict": (m.ratio(tp, unsafe), m.ratio(tp, tp + fp), m.ratio(fp, safe), 1 - m.ratio(sa, safe)),
        "abstain_is_error": (m.ratio(tp, unsafe), m.ratio(tp, tp + fp + sa), m.ratio(fp + sa, safe), F.lit(1.0)),
        "decided_only": (m.ratio(tp, tp + missed), m.ratio(tp, tp + fp), m.ratio(fp, safe - sa), (n - ua - sa) / n),
    }
    each = F.array(*[F.struct(F.lit(k).alias("convention"), r.alias("recall"), x.alias("precision"), f.alias("fpr"), c.alias("coverage")) for k, (r, x, f, c) in rows.items()])
    return rounded(counts.select(F.inline(each)))


@query(f"""
WITH {P}, s AS (SELECT CASE WHEN gold THEN 'unsafe' WHEN toxic THEN 'needs_review' ELSE 'safe' END AS label, CASE pred WHEN 'vulnerable' THEN 'CANDIDATE' WHEN 'safe' THEN 'SAFE' ELSE 'INCONCLUSIVE' END AS status FROM c),
d AS (SELECT * FROM (VALUES ('unsafe'), ('safe'), ('needs_review')) a(label), (VALUES ('CANDIDATE'), ('SAFE'), ('INCONCLUSIVE'), ('NOT_TESTED')) b(status))
SELECT d.label, d.status, count(s.label) AS n FROM d LEFT JOIN s USING (label, status) GROUP BY ALL""")
def decision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicted(spark, sf_dir)
    label = F.when(F.col("gold"), "unsafe").when(F.col("toxic"), "needs_review").otherwise("safe")
    status = F.when(F.col("pred") == "vulnerable", "CANDIDATE").when(F.col("pred") == "safe", "SAFE").otherwise("INCONCLUSIVE")
    statuses = ["CANDIDATE", "SAFE", "INCONCLUSIVE", "NOT_TESTED"]
    counts = own.select(label.alias("label"), status.alias("status")).groupBy("label").pivot("status", statuses).count().na.fill(0)
    counts = spark.createDataFrame([("unsafe",), ("safe",), ("needs_review",)], "label string").join(counts, "label", "left").na.fill(0)
    return counts.unpivot("label", statuses, "status", "n")


@query(f"""
WITH {P}, b AS (SELECT round_even(least(0.99, greatest(0, conf)) * 10, 0) AS bin, count(*) AS n, avg((cell IN ('tp', 'tn'))::INT) AS acc FROM c WHERE pred <> 'abstain' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - bin / 10)) / sum(n), 6) AS ece FROM b""")
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicted(spark, sf_dir).where("pred <> 'abstain'").withColumn("cell", m.cell(F.col("gold"), F.col("pred")))
    return rounded(m.ece(own, "conf", F.col("cell").isin("tp", "tn"), clip=0.99))


@query(f"""
WITH {P}, s AS (SELECT gold, CASE WHEN n_chars % 7 = 0 THEN 0.99 WHEN n_chars % 7 < 3 THEN 0.6 WHEN n_chars % 7 < 5 THEN 0.2 ELSE 0.12 END::DOUBLE AS pos FROM p),
t AS (SELECT gold, pos, pos >= 0.6 AS positive, CASE WHEN pos >= 0.6 THEN pos ELSE 1 - pos END AS conf FROM s),
b AS (SELECT round_even(conf * 10, 0) AS bin, count(*) AS n, avg((positive = gold)::INT) AS acc FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM t) AS n, round((SELECT sum(n * abs(acc - bin / 10)) / sum(n) FROM b), 6) AS ece, round((SELECT avg((pos - gold::INT)^2) FROM t), 6) AS brier,
 (SELECT round(avg(conf), 6) FROM t WHERE NOT positive AND gold) AS mean_false_safe, (SELECT round(avg(conf), 6) FROM t WHERE positive AND NOT gold) AS mean_false_positive""")
def calibration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_chars") % 7
    pos = F.when(k == 0, 0.99).when(k < 3, 0.6).when(k < 5, 0.2).otherwise(0.12)
    own = predicted(spark, sf_dir).select("gold", pos.alias("pos")).withColumn("positive", F.col("pos") >= 0.6)
    own = own.withColumn("conf", F.when(F.col("positive"), F.col("pos")).otherwise(1 - F.col("pos")))
    g, p = F.col("gold"), F.col("positive")
    rest = own.agg(F.avg(F.pow(F.col("pos") - g.cast("double"), 2)).alias("brier"), F.avg(F.when(~p & g, F.col("conf"))).alias("mean_false_safe"), F.avg(F.when(p & ~g, F.col("conf"))).alias("mean_false_positive"))
    return rounded(m.ece(own, "conf", p == g).join(rest, how="cross"))  # two single rows


@query(f"""
WITH {P}, s AS (SELECT lang, count(*) FILTER (cell = 'tp') AS k, count(*) FILTER (gold) AS n FROM c GROUP BY lang), z AS (SELECT *, {m.Z95} AS z, k / n AS p FROM s)
SELECT lang, k, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
 round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z""")
def wilson_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicted(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("gold") & (F.col("pred") == "vulnerable")).alias("k"), F.count_if(F.col("gold")).alias("n"))
    low, high = m.wilson(F.col("k"), F.col("n"))
    return rounded(own.select("lang", "k", "n", low.alias("low"), high.alias("high")))


STATUSES = ["F", "O", "P"]


@query("""
WITH o AS (SELECT o_orderstatus AS truth, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_custkey % 3 = 0 THEN 'P' ELSE 'O' END AS pred FROM orders),
l AS (SELECT unnest(['F', 'O', 'P', 'X']) AS label),
s AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn,
  count(*) FILTER (truth <> label AND pred <> label) AS tn FROM o, l GROUP BY label), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM s),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)
SELECT label, tp + fn AS support, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS fnr,
 round(avg(f1) OVER (), 6) AS macro_f1_full, round(avg(CASE WHEN tp + fn > 0 THEN f1 END) OVER (), 6) AS macro_f1_present FROM f""")
def macro_f1_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_custkey") % 3 == 0, "P").otherwise("O")
    per = m.per_label(load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("truth"), pred.alias("pred")), [*STATUSES, "X"])  # a label without support
    every = Window.partitionBy()
    return rounded(per.withColumns({"macro_f1_full": F.avg("f1").over(every), "macro_f1_present": F.avg(F.when(F.col("support") > 0, F.col("f1"))).over(every)}))


@query(f"""
WITH {P}, t AS (SELECT *, pred = 'vulnerable' AS positive, CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS size FROM p),
s AS (SELECT lang, source, size, count(*) AS n, count(*) FILTER (positive AND gold) AS tp, count(*) FILTER (positive AND NOT gold) AS fp, count(*) FILTER (NOT positive AND gold) AS fn, count(*) FILTER (NOT positive AND NOT gold) AS tn
 FROM t GROUP BY GROUPING SETS ((), (lang), (source), (size)))
SELECT lang, source, size, n, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(tp + fn, 0), 6) AS fnr FROM s""")
def sliced_confusion_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicted(spark, sf_dir).withColumns({"positive": F.col("pred") == "vulnerable", "size": F.when(F.col("n_chars") < 1500, "short").otherwise("long")})
    counts, rates = m.live()
    cube = own.groupingSets([[], ["lang"], ["source"], ["size"]], "lang", "source", "size").agg(*counts)
    return rounded(cube.select("lang", "source", "size", "n", "tp", "fp", "fn", "tn", *rates))


RULES = {"E1_long": "n_chars >= 1500", "E2_even": "n_chars % 2 = 0", "E3_either": "n_chars >= 1500 OR n_chars % 2 = 0", "E4_confident": "conf >= 0.7", "E5_final": "pred = 'vulnerable'"}


@query(f"WITH {P}, u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS condition, gold, {v} AS positive FROM p" for k, v in RULES.items()) + """)
SELECT condition, count(*) AS n, count(*) FILTER (positive AND gold) AS tp, count(*) FILTER (positive AND NOT gold) AS fp, count(*) FILTER (NOT positive AND gold) AS fn, count(*) FILTER (NOT positive AND NOT gold) AS tn,
 round(count(*) FILTER (positive AND gold) / nullif(count(*) FILTER (positive), 0), 6) AS "precision", round(count(*) FILTER (positive AND gold) / nullif(count(*) FILTER (gold), 0), 6) AS recall FROM u GROUP BY condition""")
def ablation_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k).alias("condition"), F.expr(v).alias("positive")) for k, v in RULES.items()])
    counts, rates = m.live()
    own = predicted(spark, sf_dir).select("gold", F.inline(each)).groupBy("condition").agg(*counts)
    return rounded(own.select("condition", "n", "tp", "fp", "fn", "tn", *rates[:2]))


@query(f"""
WITH {P} SELECT CASE WHEN gold AND pred <> 'vulnerable' THEN CASE WHEN source LIKE 'src1%' AND toxic THEN 'SANITIZER_IDENTITY_ERROR' WHEN pred = 'abstain' THEN CASE WHEN lang = 'en' THEN 'PROBE_GENERATION_ERROR' ELSE 'UNSUPPORTED_FLOW' END
   WHEN conf >= 0.1 THEN CASE WHEN n_chars % 2 = 0 THEN 'INTERACTION_MISSING' ELSE 'BROWSER_ORACLE_ERROR' END WHEN conf >= 0.05 THEN 'CONTEXT_CLASSIFICATION_ERROR' ELSE 'UNSUPPORTED_FLOW' END WHEN NOT gold AND pred = 'vulnerable' THEN 'CONTEXT_CLASSIFICATION_ERROR' ELSE 'OTHER' END AS failure, lang, count(*) AS n FROM p GROUP BY ALL""")
def miss_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = F.col("gold"), F.col("pred")
    unseen = F.when(F.col("lang") == "en", "PROBE_GENERATION_ERROR").otherwise("UNSUPPORTED_FLOW")
    unexecuted = F.when(F.col("n_chars") % 2 == 0, "INTERACTION_MISSING").otherwise("BROWSER_ORACLE_ERROR")
    missed = F.when(F.col("source").startswith("src1") & F.col("toxic"), "SANITIZER_IDENTITY_ERROR").when(p == "abstain", unseen).when(F.col("conf") >= 0.1, unexecuted)
    missed = missed.when(F.col("conf") >= 0.05, "CONTEXT_CLASSIFICATION_ERROR").otherwise("UNSUPPORTED_FLOW")
    failure = F.when(g & (p != "vulnerable"), missed).when(~g & (p == "vulnerable"), "CONTEXT_CLASSIFICATION_ERROR").otherwise("OTHER")
    return predicted(spark, sf_dir).groupBy(failure.alias("failure"), "lang").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT conv_id, role, bool_and(length(text) % 3 <> 0) AS ok FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL),
p AS (SELECT conv_id, bool_or(ok) FILTER (role = 'user') AS u, bool_or(ok) FILTER (role = 'assistant') AS a FROM r GROUP BY conv_id)
SELECT count(*) AS n_pairs, count(*) FILTER (u AND a) AS both_right, count(*) FILTER (u <> a) AS one_right, round(count(*) FILTER (u AND a) / count(*), 6) AS paired_accuracy FROM p WHERE u IS NOT NULL AND a IS NOT NULL""")
def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    pairs = turns.groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.bool_and(F.length("text") % 3 != 0)).na.drop()
    both = F.count_if(F.col("user") & F.col("assistant"))
    return rounded(pairs.agg(F.count("*").alias("n_pairs"), both.alias("both_right"), F.count_if(F.col("user") != F.col("assistant")).alias("one_right"), (both / F.count("*")).alias("paired_accuracy")))


@query(f"""
WITH {P}, d AS (SELECT ((pred = 'vulnerable') = gold)::INT - ((n_chars >= 1500) = gold)::INT AS d FROM p), o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM d), n AS (SELECT count(*) AS n FROM d),
r AS (SELECT rep, ('0x' || substr(sha256('7:' || rep || ':' || i), 1, 15))::BIGINT % n AS pos FROM n, range(5000) a(rep), LATERAL (SELECT unnest(range(n)) AS i) b),
s AS (SELECT rep, avg(d) AS mean FROM r JOIN o USING (pos) GROUP BY rep)
SELECT round((SELECT avg(d) FROM d), 6) AS delta, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM s""")
def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = lambda test: (test == F.col("gold")).cast("int")
    own = predicted(spark, sf_dir).select((right(F.col("pred") == "vulnerable") - right(F.col("n_chars") >= 1500)).alias("d"))
    return rounded(m.bootstrap(own, "d", "d", reps=5000, seed=7))


GRID = [(t / 10, g / 10) for t in range(2, 9) for g in (0, 1, 2)]


@query(f"""
WITH {P}, g AS (SELECT * FROM (VALUES {', '.join(f'({t}, {g})' for t, g in GRID)}) v(threshold, margin)),
s AS (SELECT threshold, margin, gold, CASE WHEN conf < threshold OR conf - (1 - conf) / 2 < margin THEN 'safe' ELSE 'vulnerable' END AS said FROM p, g),
a AS (SELECT threshold, margin, count(*) FILTER (said = 'vulnerable' AND gold) / nullif(count(*) FILTER (said = 'vulnerable'), 0) AS p, count(*) FILTER (said = 'vulnerable' AND gold) / count(*) FILTER (gold) AS r FROM s GROUP BY ALL)
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(margin AS DOUBLE) AS margin, round(coalesce(p, 0), 6) AS "precision", round(r, 6) AS recall, row_number() OVER (ORDER BY round(coalesce(p, 0) * 0.4 + r * 0.6, 9) DESC, threshold, margin) AS place FROM a""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.broadcast(spark.createDataFrame(GRID, "threshold double, margin double"))  # a fixed grid
    conf = F.col("conf")
    said = ~((conf < F.col("threshold")) | (conf - (1 - conf) / 2 < F.col("margin")))
    cells = predicted(spark, sf_dir).groupBy("gold", "conf").count().join(grid, how="cross")  # a hundred confidences times the grid
    s = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0))
    per = cells.groupBy("threshold", "margin").agg(m.ratio(s(said & F.col("gold")), s(said), 0.0).alias("precision"), m.ratio(s(said & F.col("gold")), s(F.col("gold"))).alias("recall"))
    score = F.round(F.col("precision") * 0.4 + F.col("recall") * 0.6, 9)
    return rounded(per.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), "threshold", "margin")).cast("long")))


@query(f"""
WITH {P}, s AS (SELECT lang AS split, avg((pred = 'vulnerable' AND gold OR pred = 'safe' AND NOT gold)::INT) AS ca, avg(((n_chars >= 1500) = gold)::INT) AS ba,
  count(*) FILTER (pred = 'vulnerable' AND NOT gold) / nullif(count(*) FILTER (NOT gold), 0) AS cf, count(*) FILTER (n_chars >= 1500 AND NOT gold) / nullif(count(*) FILTER (NOT gold), 0) AS bf, avg((pred = 'abstain')::INT) AS ab,
  coalesce(avg((pred = 'safe')::INT) FILTER (gold), 1) AS cl, coalesce(avg((n_chars < 1500)::INT) FILTER (gold), 1) AS bl FROM p GROUP BY lang),
k AS (SELECT 'dev_no_regression' AS criterion, ca >= ba - 1e-9 AS pass FROM s WHERE split = 'en' UNION ALL SELECT 'generalization', ca >= ba - 0.02 FROM s WHERE split = 'de' UNION ALL
 SELECT 'false_positive', bool_and(cf <= bf + 1e-9) FROM s WHERE split IN ('en', 'fr') UNION ALL SELECT 'adversarial', ca >= ba - 1e-9 FROM s WHERE split = 'fr' UNION ALL SELECT 'abstention', ab <= 0.25 FROM s WHERE split = 'en' UNION ALL
 SELECT 'nearmiss_leakage', cl <= 0.3 AND cl <= bl + 1e-9 FROM s WHERE split = 'es')
SELECT CASE WHEN bool_and(pass) THEN 'PROMOTE' ELSE 'REJECT' END AS decision, coalesce(string_agg(criterion, ',' ORDER BY criterion) FILTER (NOT pass), '') AS failed FROM k""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, base = F.col("gold"), F.col("pred"), F.col("n_chars") >= 1500
    mean = lambda test: F.avg(test.cast("int"))
    per = predicted(spark, sf_dir).groupBy("lang").agg(
        mean((p == "vulnerable") & g | (p == "safe") & ~g).alias("ca"), mean(base == g).alias("ba"), m.ratio(F.count_if((p == "vulnerable") & ~g), F.count_if(~g)).alias("cf"),
        m.ratio(F.count_if(base & ~g), F.count_if(~g)).alias("bf"), mean(p == "abstain").alias("ab"),
        F.coalesce(F.avg(F.when(g, (p == "safe").cast("int"))), F.lit(1.0)).alias("cl"), F.coalesce(F.avg(F.when(g, (~base).cast("int"))), F.lit(1.0)).alias("bl"),
    )
    at = lambda lang, test: F.bool_and(F.when(F.col("lang").isin(lang), test))
    checks = {
        "dev_no_regression": at(["en"], F.col("ca") >= F.col("ba") - 1e-9), "generalization": at(["de"], F.col("ca") >= F.col("ba") - 0.02),
        "false_positive": at(["en", "fr"], F.col("cf") <= F.col("bf") + 1e-9), "adversarial": at(["fr"], F.col("ca") >= F.col("ba") - 1e-9), "abstention": at(["en"], F.col("ab") <= 0.25),
        "nearmiss_leakage": at(["es"], (F.col("cl") <= 0.3) & (F.col("cl") <= F.col("bl") + 1e-9)),
    }
    row = per.agg(*[c.alias(k) for k, c in checks.items()])
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(k), F.lit(k)) for k in checks])))
    return row.select(F.when(F.size(failed) == 0, "PROMOTE").otherwise("REJECT").alias("decision"), F.array_join(failed, ",").alias("failed"))


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, round(power(n, -0.75) / avg(power(n, -0.75)) OVER (), 6) AS power_weight, round((1 / n) / avg(1 / n) OVER (), 6) AS balanced_weight, round(sqrt(1 / n) / avg(sqrt(1 / n)) OVER (), 6) AS sqrt_weight FROM c""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    weight = lambda power, name: m.balanced_weights(counts, "event_type", power).select("event_type", F.col("weight").alias(name))
    return rounded(counts.join(weight(0.75, "power_weight"), "event_type").join(weight(1.0, "balanced_weight"), "event_type").join(weight(0.5, "sqrt_weight"), "event_type"))


@query("""
WITH u AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS v, min(ts) FILTER (event_type = 'click') AS c, min(ts) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT count(*) AS users, count(v) AS viewed, count(*) FILTER (c > v) AS clicked, count(*) FILTER (c > v AND p > c) AS bought FROM u""")
def funnel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    users = load(spark, sf_dir, "events").groupBy("user_id").agg(first("view").alias("v"), first("click").alias("c"), first("purchase").alias("p"))
    return users.agg(F.count("*").alias("users"), F.count("v").alias("viewed"), F.count_if(F.col("c") > F.col("v")).alias("clicked"), F.count_if((F.col("c") > F.col("v")) & (F.col("p") > F.col("c"))).alias("bought"))


@query("""
SELECT c_mktsegment AS segment, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS confirmed, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') AS confirmed_not_urgent,
 round(sum(o_totalprice), 2) AS total, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS pending_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def monitoring_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    own = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    done = own.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("runs"), F.count_if(s == "F").alias("confirmed"), F.count_if((s == "F") & (F.col("o_orderpriority") != "1-URGENT")).alias("confirmed_not_urgent"),
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.count_if(s == "P") / F.count("*"), 6).alias("pending_rate"),
    )
    return done


@query(f"""
WITH {P} SELECT lang, count(*) FILTER (NOT toxic) AS n_perturbed, round(coalesce(count(*) FILTER (NOT toxic AND pred = 'safe') / nullif(count(*) FILTER (NOT toxic), 0), 0), 6) AS leakage_rate,
 round(count(*) FILTER (toxic AND pred = 'safe') / nullif(count(*) FILTER (toxic), 0), 6) AS anchor_correct FROM p GROUP BY lang""")
def leakage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, safe = F.col("toxic"), F.col("pred") == "safe"
    return rounded(predicted(spark, sf_dir).groupBy("lang").agg(F.count_if(~t).alias("n_perturbed"), m.ratio(F.count_if(~t & safe), F.count_if(~t), 0.0).alias("leakage_rate"), m.ratio(F.count_if(t & safe), F.count_if(t)).alias("anchor_correct")))


@query(f"""
WITH {P}, e AS (SELECT coalesce(nullif(source, 'src0'), nullif(lang, ''), 'unknown') AS family, CASE WHEN cell IN ('tp', 'tn', 'abstain') THEN NULL ELSE (CASE WHEN gold THEN 'XSS' ELSE 'SAFE' END) || '_AS_' || upper(pred) END AS error, cell FROM c)
SELECT family, count(*) AS n, count(*) FILTER (cell IN ('tp', 'tn')) AS correct, count(*) FILTER (cell = 'abstain') AS abstained, count(*) FILTER (error = 'XSS_AS_SAFE') AS missed, count(*) FILTER (error = 'SAFE_AS_VULNERABLE') AS alarms,
 min(round(count(*) FILTER (cell IN ('tp', 'tn')) / count(*), 6)) OVER () AS lowest FROM e GROUP BY family""")
def family_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicted(spark, sf_dir).withColumn("cell", m.cell(F.col("gold"), F.col("pred")))
    family = F.coalesce(F.nullif("source", F.lit("src0")), F.nullif("lang", F.lit("")), F.lit("unknown"))
    c, right = F.col("cell"), F.col("cell").isin("tp", "tn")
    per = own.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(c == "abstain").alias("abstained"), F.count_if(c == "fn").alias("missed"), F.count_if(c == "fp").alias("alarms"))
    return per.withColumn("lowest", F.min(F.round(F.col("correct") / F.col("n"), 6)).over(Window.partitionBy()))


@query("""
WITH d AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (SELECT 'quality' AS task, quality AS label FROM d UNION ALL SELECT 'toxic', toxic FROM d UNION ALL SELECT 'both', CASE WHEN quality = 1 THEN toxic END FROM d)
SELECT task, label, count(*) AS n FROM u GROUP BY ALL""")
def masked_task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    both = F.when(F.col("quality") == 1, F.col("toxic"))
    each = F.array(*[F.struct(F.lit(k).alias("task"), c.alias("label")) for k, c in (("quality", F.col("quality")), ("toxic", F.col("toxic")), ("both", both))])
    return docs.select(F.inline(each)).groupBy("task", "label").agg(F.count("*").alias("n"))


@query(f"""
WITH {P} SELECT lang, round(avg((gold = (pred = 'vulnerable'))::INT), 6) AS verdict, round(avg((toxic = (conf >= 0.5))::INT), 6) AS severity, round(avg((gold = (pred = 'vulnerable') AND toxic = (conf >= 0.5))::INT), 6) AS exact, round(count(DISTINCT n_chars) / count(*), 6) AS unique_rate FROM p GROUP BY lang""")
def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = F.col("gold") == (F.col("pred") == "vulnerable"), F.col("toxic") == (F.col("conf") >= 0.5)
    mean = lambda t: F.avg(t.cast("int"))
    return rounded(predicted(spark, sf_dir).groupBy("lang").agg(mean(v).alias("verdict"), mean(s).alias("severity"), mean(v & s).alias("exact"), (F.countDistinct("n_chars") / F.count("*")).alias("unique_rate")))


@query(f"""
WITH {P}, t AS (SELECT lang, avg((pred = 'vulnerable' AND gold OR pred = 'safe' AND NOT gold)::INT) AS a, avg((toxic = (conf >= 0.9))::INT) AS b, CASE WHEN count(*) FILTER (toxic) >= 5 THEN avg((conf >= 0.9)::INT) FILTER (toxic) END AS c FROM p GROUP BY lang)
SELECT lang, round((a * 0.4 + b * 0.2 + coalesce(c * 0.4, 0)) / (0.6 + CASE WHEN c IS NULL THEN 0 ELSE 0.4 END), 6) AS weighted FROM t""")
def weighted_task_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, t, hi = F.col("gold"), F.col("pred"), F.col("toxic"), F.col("conf") >= 0.9
    mean = lambda test: F.avg(test.cast("int"))
    parts = predicted(spark, sf_dir).groupBy("lang").agg(mean((p == "vulnerable") & g | (p == "safe") & ~g).alias("a"), mean(t == hi).alias("b"), F.when(F.count_if(t) >= 5, F.avg(F.when(t, hi.cast("int")))).alias("c"))
    weights = {"a": 0.4, "b": 0.2, "c": 0.4}
    total: Column = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    share: Column = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return rounded(parts.select("lang", (total / share).alias("weighted")))
