import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import evidence
from tessella.operators import audit, holdout, metrics, ordering
from tessella.plans import evidence as plans
from tessella.sources import jsonl


def test_evidence_of_every_combination(spark):
    rows = [(c, s, z, u) for c in (*plans.CONTEXTS, None) for s in (["a", "b"], [], None) for z in (*plans.SANITIZERS, None) for u in (True, False, None)]
    df = spark.createDataFrame(rows, "context string, sources array<string>, sanitizer string, unknown boolean")
    got = df.select("*", evidence.sink_evidence(*[F.col(c) for c in ("context", "sources", "sanitizer", "unknown")]).alias("e")).collect()
    for r in got:
        fits = r["sanitizer"] in evidence.COMPATIBLE.get(r["context"], ())
        verdict = "INCONCLUSIVE" if r["unknown"] in (True, None) else "CANDIDATE" if r["context"] != "text" and r["sources"] and not fits else "SAFE"
        relation = "UNKNOWN" if verdict == "INCONCLUSIVE" else "CONNECTED" if r["sources"] else "DISCONNECTED"
        known = r["context"] in evidence.SINK_KINDS
        if r["context"] == "text":
            rule = "SAFE_TEXT_OUTPUT"
        elif fits:
            rule = evidence.PROTECTIONS[r["sanitizer"]][1]
        else:
            rule = "UNPROTECTED_CONNECTED_SINK" if relation == "CONNECTED" and known else "DISCONNECTED" if relation == "DISCONNECTED" else "UNRESOLVED"
        status = "CANDIDATE" if rule == "UNPROTECTED_CONNECTED_SINK" else "INCONCLUSIVE" if relation == "UNKNOWN" else "BOUNDED_SAFE"
        e = r["e"]
        assert (e["verdict"], e["relation"], e["rule"], e["status"]) == (verdict, relation, rule, status), r
        assert e["source"] == ("OBSERVED" if r["sources"] else "UNKNOWN" if relation == "UNKNOWN" else "NONE_ON_THIS_PATH")


def test_role_texts(spark):
    rows = [("a.b", "a", "a = a.b"), ("a", "a.b", "a = a.b"), ("x", "y", "y=x;x"), ("same", "same", "same"), (" ", "y", "y"), ("x", None, "x"), ("x", "y", "\n")]
    got = spark.createDataFrame(rows, "a string, b string, t string").select(evidence.role_text(F.col("a"), F.col("b"), F.col("t"))).collect()
    flows = [r[0] and r[0].split("[FLOW]\n")[1] for r in got]
    assert flows == ["__SINK__ = __SOURCE__", "__SOURCE__ = __SINK__", "__SINK__=__SOURCE__;__SOURCE__", "__SOURCE__", None, None, None]


def test_annotations_tell_of_the_next_line_with_words(spark):
    rng = random.Random(1)
    lines = [(f, i, rng.choice(["", " \t", "code", "// ruleid: a-xss", "# ok : B.xss", "ok:x", "token: y", " "])) for f in range(40) for i in range(rng.randrange(1, 12))]
    got = {(r["f"], r["i"]): (r["rule"], r["label"], r["target"]) for r in audit.annotated(spark.createDataFrame(lines, "f int, i int, t string").repartition(3), "f", "i", "t").collect()}
    want = {}
    for f, i, t in lines:
        m = re.search(r"(?:ruleid|ok)\s*:\s*([\w.-]+)", t)
        target = next((j for g, j, u in lines if g == f and j > i and u.strip(" \t\r\n\f")), None)
        if m and target is not None:
            want[f, i] = (m[1].lower(), "SAFE" if re.search(r"\bok\s*:", t) else "UNSAFE", target)
    assert got == want


def test_every_relation_reason_occurs_once_each(spark):
    good = {"n": 0, "split": "a", "id": "i", "content": "c", "label": "UNKNOWN", "status": "REVIEWED", "native": True, "reviewer": "r", "rationale": "r", "reference": "r", "repository": "x", "framework": "f", "template": "not-applicable", "generator": "g"}
    faults = [{}, {"label": None}, {"id": " "}, {"status": "OPEN"}, {"reference": None}, {"generator": ""}, {"native": None}, {"framework": "not-applicable"}, {"content": "c1", "id": "i"}, {"content": "c", "id": "i9"}, {"split": "b"}]
    rows = [good | {"n": k, "id": f"i{k}", "content": f"c{k}"} | f for k, f in enumerate(faults)]
    rows[0] |= {"id": "i", "content": "c"}
    rows[10] |= {"id": "i", "content": "c", "repository": " x "}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'int' if k == 'n' else 'boolean' if k == 'native' else 'string'}" for k in good))
    got = {r["n"]: r["reason"] for r in audit.relation_reasons(df, "n").collect()}
    assert [got[k] for k in range(11)] == ["ok", "label", "id", "review", "review", "provenance", "not_applicable", "not_applicable", "duplicate", "duplicate", "ok"]
    assert {r["key"]: r["n"] for r in audit.relation_overlap(df).collect()} == {"repository": 1, "framework": 1, "generator": 1, "content": 1, "id": 1}


def brute_bootstrap(values, reps, seed):
    import hashlib

    ordered, n = sorted(values), len(values)
    means = [np.mean([ordered[int(hashlib.sha256(f"{seed}:{r}:{i}".encode()).hexdigest()[:15], 16) % n] for i in range(n)]) for r in range(reps)]
    return [np.mean(values), *np.percentile(means, [2.5, 97.5])]


def test_bootstrap_of_few_and_of_many_differences(spark, monkeypatch):
    rng = random.Random(2)
    few, many = [rng.choice([-1, 0, 0, 1]) for _ in range(60)], [round(rng.gauss(0, 1), 3) for _ in range(90)]
    for values in (few, many):
        for bound in (64, 2):
            monkeypatch.setattr(metrics, "FEW_VALUES", bound)
            got = metrics.bootstrap(spark.createDataFrame([(float(v),) for v in values], "d double"), "d", "d", 40, 3).first()
            assert np.allclose(list(got), brute_bootstrap([float(v) for v in values], 40, 3))
    assert list(metrics.bootstrap(spark.createDataFrame([], "d double"), "d", "d", 5, 3).first()) == [None, None, None]


def test_running_sums(spark):
    rows = [(k, k % 7) for k in range(500)]
    got = ordering.with_running(spark.createDataFrame(rows, "k int, v long").repartition(6), F.col("v"), "k", name="s").collect()
    assert {r["k"]: r["s"] for r in got} == dict(enumerate(np.cumsum([v for _, v in rows]).tolist()))


CASE = {"n": 0, "id": "i", "code": "x = 1", "label": "safe", "repository": "ext/a", "revision": "a" * 40, "path": "p", "family": "f", "reviewer": "r", "evidence_ref": "e", "semantic_reason": "s", "safe_by_nonexecution_only": False, "executed": None}
CASE_SCHEMA = "n int, id string, code string, label string, repository string, revision string, path string, family string, reviewer string, evidence_ref string, semantic_reason string, safe_by_nonexecution_only boolean, executed boolean"


def test_holdout_codes_one_by_one(spark):
    faults = [
        ({}, []), ({"id": None}, ["missing_or_duplicate_case_id"]), ({"id": "", "code": None}, ["missing_or_duplicate_case_id", "source_code_missing"]), ({"code": "", "label": "none"}, ["source_code_missing"]), ({"code": "d e\nv"}, ["development_code_overlap"]),
        ({"code": "x\t=  0;"}, ["repeated_holdout_code"]), ({"label": None}, ["label_not_adjudicated"]), ({"revision": "a" * 39}, ["immutable_external_source_missing"]), ({"path": None}, ["immutable_external_source_missing"]), ({"repository": None}, ["immutable_external_source_missing"]),
        ({"repository": "dev/repo"}, ["development_repository_overlap"]), ({"family": ""}, ["source_family_missing"]), ({"evidence_ref": None}, ["independent_label_review_missing"]), ({"reviewer": "me"}, ["reviewer_is_engine_author"]),
        ({"safe_by_nonexecution_only": True}, ["negative_browser_result_is_not_safe_ground_truth"]), ({"safe_by_nonexecution_only": None}, ["negative_browser_result_is_not_safe_ground_truth"]), ({"label": "unsafe"}, ["positive_execution_evidence_missing"]), ({"label": "unsafe", "executed": True}, []), ({"id": "i0"}, ["missing_or_duplicate_case_id"]),
    ]
    rows = [CASE | {"n": k, "id": f"i{k}", "code": f"x = {k};"} | f for k, (f, _) in enumerate(faults)]
    cases = spark.createDataFrame([tuple(r.values()) for r in rows], CASE_SCHEMA).repartition(3)
    development = spark.createDataFrame([("dev", "dev/repo"), (None, None)], "code string, repository string")
    judged = holdout.case_reasons(cases, development, "n", ("me",))
    got = {r["n"]: r["reasons"] for r in judged.collect()}
    assert [got[k] for k in range(len(faults))] == [want for _, want in faults]
    good = {"evaluation_kind": "external_holdout", "exposure_status": "unseen", "frozen_before_engine_changes": True, "development_inventory_complete": True, "sampling_plan_ref": "plan"}
    whole = lambda m, **k: {r["reason"] for r in holdout.report(judged, m, **k).collect()} - {x for _, want in faults for x in want}
    assert whole(good, per_class=2, repositories=2, families=1) == set()
    assert whole({"frozen_before_engine_changes": 1}) == {*holdout.DECLARED, "representative_sampling_plan_missing", "insufficient_cases_per_class", "insufficient_disjoint_source_repositories", "insufficient_source_families"}
    empty = holdout.case_reasons(cases.limit(0), development, "n")
    assert {r["reason"] for r in holdout.report(empty, good).collect()} == {"insufficient_cases_per_class", "insufficient_disjoint_source_repositories", "insufficient_source_families"}


def test_pins_and_identities(spark):
    rows = [(0, "a", "r1", "p", "MIT"), (1, "a", "r1", "p", "MIT"), (2, "a", "r2", "p", "MIT"), (3, "a", "r1", "q", None), (4, "b", "r1", "p", "MIT"), (5, None, None, None, None), (6, "a", None, "p", "MIT")]
    df, pins = spark.createDataFrame(rows, "n int, repository string, revision string, path string, license string"), spark.createDataFrame([("a", "r1", "MIT")], "repository string, revision string, license string")
    got = {r["n"]: r["reason"] for r in audit.pinned(df, pins, "n").collect()}
    assert got == {0: "ok", 1: "duplicate_identity", 2: "wrong_revision", 3: "wrong_license", 4: "unpinned", 5: "unpinned", 6: "wrong_revision"}
    with pytest.raises(ValueError):
        audit.pinned(df, pins.union(pins), "n")


def test_only_training_folders_may_be_read_for_training():
    for path in ("data/training/x.jsonl", "/srv/data/training/a/b.jsonl", "s3://bucket/data/training/x"):
        assert jsonl.training_input(path) == path
    for path in ("data/training", "data/training2/x", "data/training/frozen/x", "data/evaluation/x", "data/training/../frozen/x", "reports/data/training/x", "x.jsonl"):
        with pytest.raises(jsonl.LockedSourceError):
            jsonl.training_input(path)
