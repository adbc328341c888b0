import datetime
import math
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import intervals, ledger, linear
from tessella.plans import models


def brute_terms(text):
    words = re.findall(r"\w+", text or "")
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_features(texts, vocab):
    rows = []
    for t in texts:
        x = {k: (1 + math.log(n)) * vocab[k] for k, n in Counter(brute_terms(t)).items() if k in vocab}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rows.append({k: v / norm for k, v in x.items()})
    return rows


def labelled(n, seed):
    rng, words = random.Random(seed), {"a": ["vin", "été", "über_x", "same"], "b": ["wine", "sum9", "same", "over"], "c": ["same", "other", "third", "ça"]}
    return [(i, " ".join(rng.choice(words[y] if rng.random() < 0.7 else words["c"]) for _ in range(rng.randrange(0, 14))) or None, y) for i, y in ((i, rng.choice("aabc")) for i in range(n))]


def brute_vocabulary(texts, most):
    texts = [t for t in texts if t is not None]
    total, df = Counter(), Counter()
    for t in texts:
        total.update(brute_terms(t))
        df.update(set(brute_terms(t)))
    kept = sorted(total, key=lambda k: (-total[k], k.encode()))[:most]
    return {k: math.log((1 + len(texts)) / (1 + df[k])) + 1 for k in kept}


def test_vocabulary_and_features_equal_brute_force(spark):
    rows = labelled(120, 1)
    df = spark.createDataFrame(rows, "id long, text string, label string")
    vocab = linear.vocabulary(df, "text", 9)
    want = brute_vocabulary([t for _, t, _ in rows], 9)
    assert {r["term"]: r["idf"] for r in vocab.collect()} == pytest.approx(want)
    got = {(r["id"], r["term"]): r["w"] for r in linear.features(df, "id", "text", vocab, 9).collect()}
    assert got == pytest.approx({(i, k): v for (i, _, _), x in zip(rows, brute_features([t for _, t, _ in rows], want), strict=True) for k, v in x.items()})


def test_vocabulary_equals_brute_force_at_every_size(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(0, 30))) or None for _ in range(150)]
    texts += ["tie{0} tie{1}".format(*rng.sample(range(30), 2)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for most in (1, 5, 20, 60, 61, 75, 90, 150, 5000):  # words enough or not, ties at the bound, all terms
        assert {r["term"]: r["idf"] for r in linear.vocabulary(df, "text", most).collect()} == pytest.approx(brute_vocabulary(texts, most)), most
    assert linear.vocabulary(df.where("text is null"), "text", 5).collect() == []


def test_terms_of_a_row_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame(labelled(50, 3), "id long, text string, label string").localCheckpoint()
    plan = linear.features(df, "id", "text", linear.vocabulary(df, "text", 9), 9)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_fit_shuffles_no_row_by_term(spark):
    train, _ = models.divided(spark, "/root/testdata/sf0.01")
    sc, name = spark.sparkContext, "fit-shuffle"
    sc.setJobGroup(name, name)
    linear.fit(train, "doc_id", "text", "lang", tempfile.mkdtemp(prefix="spark-fit-"), 3000, steps=2)
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds}
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert 0 < written < 2 * train.agg(F.sum(F.octet_length("text"))).first()[0]


def test_scores_equal_brute_force(spark, monkeypatch):
    weights = [("wine", 1.5, "a", 2.0), ("wine", 1.5, "b", -1.0), ("wine sum", 1.1, "a", 700.0), ("wine sum", 1.1, "b", 900.0)]
    model = linear.LinearModel(spark.createDataFrame(weights, "term string, idf double, label string, weight double"), spark.createDataFrame([("a", 0.5), ("b", 0.25)], "label string, intercept double"))
    texts = ["wine sum wine", "wine", "Wine", "", None]
    for most in (500_000, 0):  # both joins
        monkeypatch.setattr(linear, "BROADCAST_WEIGHTS", most)
        scored = linear.scores(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", model, 2)
        got = {(r["id"], r["label"]): r["probability"] for r in scored.collect()}
        for i, x in enumerate(brute_features(texts, {"wine": 1.5, "wine sum": 1.1})):
            logits = {y: b + sum(x.get(t, 0) * w for t, _, label, w in weights if label == y) for y, b in (("a", 0.5), ("b", 0.25))}
            e = {y: math.exp(z - max(logits.values())) for y, z in logits.items()}
            for y in e:
                assert got[i, y] == pytest.approx(e[y] / sum(e.values()))
    best = {r["id"]: r["label"] for r in linear.predicted(scored, "id").collect()}
    assert best == {0: "b", 1: "a", 2: "a", 3: "a", 4: "a"}


def test_fit_is_at_the_optimum_of_the_weighted_ridge_loss(spark):
    rows = [*labelled(150, 2), (900, "of no label", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = linear.fit(df, "id", "text", "label", tempfile.mkdtemp(prefix="spark-fit-"), most=12, c=1.0, steps=300)
    rows = rows[:-1]
    vocab = brute_vocabulary([t for _, t, _ in rows], 12)
    names, labels = sorted(vocab), sorted({y for *_, y in rows})
    x = np.zeros((len(rows), len(names)))
    for i, f in enumerate(brute_features([t for _, t, _ in rows], vocab)):
        for k, v in f.items():
            x[i, names.index(k)] = v
    y = np.array([labels.index(r[2]) for r in rows])
    weight = len(rows) / (len(labels) * np.bincount(y))[y]
    w = np.zeros((len(labels), len(names)))
    for r in model.weights.collect():
        assert r["idf"] == pytest.approx(vocab[r["term"]])
        w[labels.index(r["label"]), names.index(r["term"])] = r["weight"]
    b = np.array([r["intercept"] for r in sorted(model.intercepts.collect(), key=lambda r: r["label"])])
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    gradient = ((p - np.eye(len(labels))[y]) * weight[:, None]).T @ x + w
    assert np.abs(gradient).max() < 0.05
    found = linear.predicted(linear.scores(df.where("label is not null"), "id", "text", model, 12), "id").collect()
    assert np.mean([dict((r[0], r[2]) for r in rows)[f["id"]] == f["label"] for f in found]) > 0.75
    one = linear.fit(df.where("label = 'a'"), "id", "text", "label", tempfile.mkdtemp(prefix="spark-fit-"), most=5)
    assert {r["probability"] for r in linear.scores(df, "id", "text", one, 5).collect()} == {1.0}


def test_fitted_model_finds_the_language_of_test_documents(spark):
    rows = models.linear_fit_heldout(spark, "/root/testdata/sf0.01").collect()
    assert sum(r["f1"] for r in rows) / len(rows) > 0.85


def test_earlier_rows_within_a_distance(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"c{i % 5}", rng.randrange(-2000, 5000) if i % 40 else 77, i % 4) for i in range(1500)] + [(5000, None, 1, 1), (5001, "hot", None, 1)]
    df = spark.createDataFrame(rows, "id long, block string, pos long, var long").repartition(5)
    found = intervals.earlier_within(df, "block", "pos", ["id"], 12, 4, ["id", "var"])
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(block" in plan and "_bucket" in plan and "Join" not in plan.split("Optimized")[1]
    by = {}
    for r in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        own = by.get(r["block"], [])
        at = next((k for k, x in enumerate(own) if x[0] == r["id"]), None)
        want = [(x[2], x[0], x[3]) for x in reversed(own[max(0, at - 4) : at]) if r["pos"] - x[2] <= 12] if at is not None else []
        assert [tuple(e) for e in r["earlier"]] == want


def brute_throttle(rows, gap):
    last, said = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        said[i] = key not in last or t - last[key] >= gap
        if said[i]:
            last[key] = t
    return said


def test_throttle_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(6), rng.randrange(3000)) for i in range(800)]
    got = intervals.throttled(spark.createDataFrame(rows, "id long, key long, t long"), "key", F.col("t"), ["id"], 25)
    assert {r["id"]: r["allowed"] for r in got.collect()} == brute_throttle(rows, 25)


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sessions_in_batch_and_stream(spark):
    t0, folder = datetime.datetime(2024, 1, 1), tempfile.mkdtemp(prefix="spark-stream-")
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    batches = [[(1, at(0)), (1, at(4)), (2, at(1))], [(1, at(30)), (2, at(4))], [(1, at(100)), (2, at(101))], [(1, at(3)), (2, at(200))]]  # the last (1, at(3)) is late
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "user long, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in{k:02d}")
    schema = "user long, at timestamp"
    paths = spark.createDataFrame([r for b in batches[:-1] for r in b] + [(2, at(200))], schema)
    want = sorted(tuple(r) for r in intervals.sessions(paths, "user", "at", "10 minutes").collect())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*").withWatermark("at", "5 minutes")
    query = intervals.sessions(stream, "user", "at", "10 minutes").writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("sessions").collect())
    closed = [w for w in want if w[2] < at(195)]  # what the watermark has closed
    assert got == closed and len(closed) >= 4


def brute_registry(events):
    current = target = None
    n = r = 0
    for event, version in events:
        if event == "promote":
            current, target, n = version, current, n + 1
        elif event == "rollback" and target is not None:
            current, target = target, current
        r += event == "reject"
    return current, target, n, r


def logs(seed):
    rng, rows = random.Random(seed), []
    for name in range(60):
        for k in range(rng.randrange(0, 25)):
            rows.append((name, k, rng.choice(["promote", "rollback", "rollback", "reject", "add"]), name * 100 + k))
    return rows


def test_registry_state_equals_a_loop_and_the_stream(spark):
    rows = logs(5)
    schema = "name long, k long, event string, version long"
    got = {r["name"]: tuple(r)[1:] for r in ledger.registry_state(spark.createDataFrame(rows, schema), "name", ["k"]).collect()}
    by = {}
    for name, _, event, version in rows:
        by.setdefault(name, []).append((event, version))
    want = {name: brute_registry(events) for name, events in by.items()}
    assert got == want
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 7 == part], schema).coalesce(1).write.mode("append").parquet(folder)
    query = ledger.registry_stream(streamed(spark, folder, schema), "name", "k").writeStream.outputMode("update").format("memory").queryName("registry").trigger(availableNow=True).start()
    query.awaitTermination(180)
    seen = {}
    for r in spark.table("registry").collect():
        if r["name"] not in seen or r["n_promoted"] >= seen[r["name"]][2]:
            seen[r["name"]] = tuple(r)[1:]
    assert seen == {k: v[:3] for k, v in want.items()}
