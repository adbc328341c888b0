"""Evaluation metrics as aggregates: confusion, calibration, intervals, bootstrap.

How abstentions count differs from convention to convention; each is a function of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import with_running
from tessella.tables import stored

Z95 = 1.959963984540054


def ratio(k: Column, n: Column, empty: float | None = None) -> Column:
    """k / n; ``empty`` (null if not given) where n is 0."""
    return F.when(n != 0, k.cast("double") / n).otherwise(F.lit(empty).cast("double"))


def cell(gold: Column, pred: Column) -> Column:
    """tp, tn, fp, fn or abstain; ``pred`` is vulnerable, safe or abstain."""
    return (
        F.when(pred == "abstain", "abstain")
        .when(gold & (pred == "vulnerable"), "tp")
        .when(~gold & (pred != "vulnerable"), "tn")
        .when(~gold, "fp")
        .otherwise("fn")
    )


def confusion(cells: str = "cell") -> dict[str, Column]:
    """Counts of each cell."""
    return {c: F.count_if(F.col(cells) == c) for c in ("tp", "tn", "fp", "fn", "abstain")}


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def scorer(df: DataFrame, *by: str) -> DataFrame:
    """Decided-only precision and recall; abstentions stay in accuracy_all and in the rates by truth.

    Takes gold, pred, conf. Empty denominators give 0.
    """
    d = df.withColumn("cell", cell(F.col("gold"), F.col("pred")))
    right = F.col("cell").isin("tp", "tn")
    decided = F.col("pred") != "abstain"
    c = d.groupBy(*by).agg(
        *[x.alias(k) for k, x in confusion().items()], F.count("*").alias("n"), F.count_if(F.col("gold")).alias("n_vulnerable"),
        F.avg(F.when(decided, F.pow(F.col("conf") - right.cast("double"), 2))).alias("brier"),
    )
    tp, tn, fp, fn, n = (F.col(k) for k in ("tp", "tn", "fp", "fn", "n"))
    p, r = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return c.withColumns({
        "accuracy_decided": ratio(tp + tn, n - F.col("abstain"), 0.0), "accuracy_all": (tp + tn) / n, "precision_vuln": p, "recall_vuln": r, "f1_vuln": f1(p, r),
        "false_positive_rate": ratio(fp, n - F.col("n_vulnerable"), 0.0), "false_negative_rate": ratio(fn, F.col("n_vulnerable"), 0.0), "abstention_rate": F.col("abstain") / n,
    })


def ece(df: DataFrame, conf: str, right: Column, clip: float | None = None) -> DataFrame:
    """One row: expected calibration error over bins of a tenth, rounded half to even."""
    c = F.least(F.lit(clip), F.greatest(F.lit(0.0), F.col(conf))) if clip else F.col(conf)
    bins = df.groupBy(F.bround(c * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("acc"))
    return bins.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("acc") - F.col("bin") / 10)) / F.sum("n")).alias("ece"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval; null where n is 0."""
    z, p = F.lit(Z95), k / n
    mid, radius = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - radius) / (1 + z * z / n), (mid + radius) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def per_label(df: DataFrame, labels: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Support, precision, recall, F1 and one-vs-rest rates of each label of a fixed list, absent ones too.

    The matrix is counted once; every label's sums come from it.
    """
    matrix = df.groupBy(truth, pred).agg(F.count("*").alias("k"))
    on = matrix.withColumn("label", F.explode(F.array(*map(F.lit, labels))))  # a few labels times the matrix
    s = lambda test: F.coalesce(F.sum(F.when(test, F.col("k"))), F.lit(0))
    t, p = F.col(truth) == F.col("label"), F.col(pred) == F.col("label")
    sums = on.groupBy("label").agg(s(t & p).alias("tp"), s(~t & p).alias("fp"), s(t & ~p).alias("fn"), s(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return sums.select("label", (tp + fn).alias("support"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), ratio(fp, fp + tn, 0.0).alias("fpr"), ratio(fn, tp + fn, 0.0).alias("fnr"))


def live(*by: str) -> tuple[list[Column], list[Column]]:
    """Aggregates over gold and positive, and the rates from them; empty denominators give null."""
    g, p = F.col("gold"), F.col("positive")
    counts = [F.count("*").alias("n"), F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn")]
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    rates = [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, tp + fn).alias("fnr")]
    return counts, rates


def decision_rates(df: DataFrame, *by: str, recall: float = 0.9, fpr: float = 0.05, missed: float = 0.0) -> DataFrame:
    """Rates of a suite labelled unsafe, safe or needs_review by status; null where a denominator is 0.

    Takes label and status (CANDIDATE, SAFE, INCONCLUSIVE, NOT_TESTED). candidate_precision is null while alerts lack a
    label. The gates ask for a recall, a rate of false alarms and a share of unsafe called safe, the second one at the
    ends of their intervals; they fail where there is nothing to measure.
    """
    at = lambda label, status: F.count_if((F.col("label") == label) & (F.col("status") == status))
    of = lambda column, value: F.count_if(F.col(column) == value)
    c = df.groupBy(*by).agg(
        F.count("*").alias("n"), of("label", "unsafe").alias("unsafe"), of("label", "safe").alias("safe"), of("label", "needs_review").alias("review"),
        at("unsafe", "CANDIDATE").alias("tp"), at("safe", "CANDIDATE").alias("fp"), at("needs_review", "CANDIDATE").alias("alerts"), at("unsafe", "SAFE").alias("missed"), at("needs_review", "SAFE").alias("rs"),
        at("unsafe", "INCONCLUSIVE").alias("ua"), at("safe", "INCONCLUSIVE").alias("sa"), at("unsafe", "NOT_TESTED").alias("un"), of("status", "NOT_TESTED").alias("untested"), of("status", "INCONCLUSIVE").alias("unresolved"),
    )
    n, unsafe, safe, tp, fp, alerts = (F.col(k) for k in ("n", "unsafe", "safe", "tp", "fp", "alerts"))
    tested = n - F.col("untested")
    point = (ratio(tp, unsafe) >= recall) & (ratio(fp, safe) <= fpr) & (F.col("missed") <= unsafe * missed)
    interval = point & (wilson(tp, unsafe)[0] >= recall) & (wilson(fp, safe)[1] <= fpr)
    return c.withColumns({
        "unsafe_candidate_recall": ratio(tp, unsafe), "adjudicated_precision": ratio(tp, tp + fp), "candidate_precision": F.when(alerts == 0, ratio(tp, tp + fp)), "verified_alert_fraction": ratio(tp, tp + fp + alerts),
        "safe_false_positive_rate": ratio(fp, safe), "unsafe_static_safe_rate": ratio(F.col("missed"), unsafe), "unsafe_candidate_miss_rate": ratio(unsafe - tp, unsafe),
        "unsafe_abstention_rate": ratio(F.col("ua"), unsafe), "safe_abstention_rate": ratio(F.col("sa"), safe), "needs_review_overclaim_rate": ratio(alerts + F.col("rs"), F.col("review")),
        "unsafe_not_tested_rate": ratio(F.col("un"), unsafe), "test_coverage": ratio(tested, n), "decision_coverage": ratio(tested - F.col("unresolved"), n),
        "point_gate": F.coalesce(point, F.lit(False)), "interval_gate": F.coalesce(interval, F.lit(False)),
    })


#: Distinct differences that are counted side by side; with more, draws are joined to them.
FEW_VALUES = 64


def bootstrap(df: DataFrame, order: str, difference: str, reps: int, seed: int) -> DataFrame:
    """Mean of a paired difference and its 95 % percentile interval from ``reps`` resamples.

    Resampling draws ranks with replacement by hash, the same in every engine: reps x n draws, made by range and
    aggregated at once, and no row of ``df`` is copied. Of few distinct differences a resample is how many draws
    fall below each one's last rank, so nothing is joined; of many each draw is joined to the one difference or two that its
    stretch of ranks holds.
    """
    spark = df.sparkSession
    counts = stored(df.groupBy(F.col(difference).alias("d")).agg(F.count("*").alias("n")), "differences")
    values, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    draws = spark.range(reps * n).select(F.floor(F.col("id") / F.lit(n)).alias("rep"), F.pmod("id", F.lit(n)).alias("i")) if n else spark.range(0).select(F.col("id").alias("rep"), F.col("id").alias("i"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string"))
    draws = draws.select("rep", F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long"), F.lit(max(n, 1))).alias("at"))
    if values <= FEW_VALUES:
        ends = sorted((r["d"], r["n"]) for r in counts.where("d is not null").collect())  # at most FEW_VALUES rows
        nulls, upto, mean = n - sum(k for _, k in ends), n - sum(k for _, k in ends), F.lit(0.0)
        below = F.count_if(F.col("at") < nulls)
        held, last = n - nulls, below
        for d, k in ends:
            upto += k
            now = F.count_if(F.col("at") < upto)
            mean, last = mean + F.lit(float(d)) * (now - last), now
        means = draws.groupBy("rep").agg((mean / F.nullif(F.count("*") - below, F.lit(0))).alias("mean")) if held else draws.groupBy("rep").agg(F.lit(None).cast("double").alias("mean"))
    else:
        ends, width = with_running(counts, F.col("n"), "d", name="upto"), max(1, n // values)
        first = F.floor((F.col("upto") - F.col("n")) / width)
        spread = ends.select("d", "n", "upto", F.explode(F.sequence(first, F.floor((F.col("upto") - 1) / width))).alias("stretch"))
        met = draws.withColumn("stretch", F.floor(F.col("at") / width)).join(spread, "stretch").where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
        means = met.groupBy("rep").agg(F.avg("d").alias("mean"))
    bounds = means.agg(F.expr("percentile(mean, array(0.025, 0.975))").alias("q"))
    return df.agg(F.avg(difference).alias("delta")).join(bounds, how="cross").select("delta", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # two single rows


def balanced_weights(counts: DataFrame, label: str, power: float = 1.0) -> DataFrame:
    """Weights 1 / count^power, scaled to mean 1 over the labels present."""
    raw = counts.withColumn("_raw", F.pow(F.col("n"), F.lit(-power)))
    return raw.select(label, "n", (F.col("_raw") / F.avg("_raw").over(Window.partitionBy())).alias("weight"))
