import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import context
from tessella.operators import flow
from tessella.plans import context as plans


def brute_context(text):
    """The same rules by a walk over the parsed value."""
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return "evidence_ref"
    ident = lambda s: isinstance(s, str) and re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", s)
    if not isinstance(v, dict) or not isinstance(v.get("evidence_ref"), str) or not v["evidence_ref"].strip(" "):
        return "evidence_ref"
    if set(v) - set(context.FIELDS):
        return "unknown_fields"
    receivers, names, inputs, bindings = v.get("receivers", []), v.get("jquery_globals", []), v.get("inputs", {}), v.get("bindings", {})
    if not isinstance(receivers, list) or not all(isinstance(x, str) and x for x in receivers):
        return "receivers"
    if not isinstance(names, list) or not all(ident(x) for x in names) or len(set(names)) < len(names):
        return "globals"
    if not isinstance(inputs, dict) or not isinstance(bindings, dict):
        return "maps"
    if any(not k or not isinstance(x, list) or not x for k, x in inputs.items()):
        return "input_reads"
    if any(not isinstance(f, str) or not (f in context.READS or re.fullmatch(r"attribute:[A-Za-z_:][A-Za-z0-9_:.-]*", f)) for x in inputs.values() for f in x):
        return "read_operation"
    if any(not ident(k) or not isinstance(b, dict) or set(b) - set(context.BINDING_FIELDS) for k, b in bindings.items()):
        return "binding"
    if any(not isinstance(b.get("selector"), str) or not b["selector"] or b.get("kind") not in context.KINDS or not isinstance(b.get("inert_node", False), bool) for b in bindings.values()):
        return "typed_binding"
    return "ok"


def made_contexts(n, seed):
    rng, texts = random.Random(seed), [None, "", "[]", "3", '"x"', "{", "{}", "null", '{"evidence_ref":null}', '{"evidence_ref":"r"}']
    pick = lambda *xs: rng.choice(xs)
    for _ in range(n):
        v = {"evidence_ref": pick("r", "r", "r", " ", 1, None)}
        if rng.random() < 0.8:
            v["receivers"] = pick([], ["a"], ["a", ""], ["a", 1], "a", {"a": 1}, None)
        if rng.random() < 0.8:
            v["jquery_globals"] = pick([], ["$", "_a1"], ["$", "$"], ["a b"], [1], ["a\n"], "a", None)
        if rng.random() < 0.8:
            v["inputs"] = pick({}, {"#a": ["value"]}, {"#a": []}, {"": ["value"]}, {"#a": ["attribute:x-y.z"], "b": ["attribute:1"]}, {"#a": "value"}, {"#a": [1]}, [], None)
        if rng.random() < 0.8:
            v["bindings"] = pick({}, {"el": {"selector": "#a", "kind": "dom"}}, {"el": {"selector": "#a", "kind": "jquery", "inert_node": True}}, {"el": {"selector": "", "kind": "dom"}}, {"el": {"kind": "dom"}}, {"el": {"selector": "a", "kind": "x"}}, {"1": {"selector": "a", "kind": "dom"}}, {"el": {"selector": "a", "kind": "dom", "inert_node": 1}}, {"el": {"selector": "a", "kind": "dom", "x": 1}}, {"el": "x"}, "x", None)
        if rng.random() < 0.1:
            v["more"] = None
        texts.append(json.dumps(v))
    return texts


def test_context_rules_equal_a_walk(spark):
    texts = made_contexts(900, 1)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", context.context_failure(F.col("t")).alias("reason")).collect()
    assert {r["reason"] for r in rows} == {"evidence_ref", "unknown_fields", "receivers", "globals", "maps", "input_reads", "read_operation", "binding", "typed_binding", "ok"}
    for r in rows:
        assert r["reason"] == brute_context(r["t"]), r["t"]


def test_every_reason_occurs_in_the_queries(spark):
    found = {r["reason"] for r in plans.context_rules(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) >= 9 and "ok" in found
    shown = plans.focus_order(spark, "/root/testdata/sf0.001")
    assert {r["reason"] for r in shown.collect()} == {"unsupported_model_schema", "unsupported_schema_version", "snippet_hash_mismatch", "invalid_path_id_list", "duplicate_path_ids", "unsupported_path_id", "existing_path_ids_only"}


def test_mandatory_paths_come_first_whatever_is_proposed(spark):
    paths = [("c", "SAFE_OBSERVED"), ("b", "INCONCLUSIVE"), ("d", "CANDIDATE"), ("a", "SAFE_OBSERVED"), ("e", "of no list")]
    proposals = {"no json": None, json.dumps({"schema_version": "focus-v1", "snippet_sha256": "h", "focus_path_ids": ["a", "d"]}): ["b", "d", "a"], json.dumps({"schema_version": "focus-v1", "snippet_sha256": "h", "focus_path_ids": []}): ["b", "d"], json.dumps({"schema_version": "focus-v1", "snippet_sha256": "h", "focus_path_ids": ["a"] * 9}): None}
    df = spark.createDataFrame([(p, paths) for p in proposals], "p string, paths array<struct<path_id:string,status:string>>")
    chosen = df.withColumn("chosen", context.focus(F.col("p"), F.lit("h"), F.col("paths")))
    for r in chosen.select("p", context.shown(F.col("chosen"), F.col("paths")).alias("ids")).collect():
        assert r["ids"] == (proposals[r["p"]] or ["d", "b", "a", "c", "e"])


def brute_reached(edges, source, sinks):
    depth, front = {source: 0}, [source]
    while front:
        front = [d for s in front for d, x in edges if x == s and d not in depth and not depth.update({d: depth[s] + 1})]
    return {s: depth[s] for s in sinks if s in depth}


def test_reached_sinks_equal_a_search_and_cycles_end(spark):
    rng, scripts = random.Random(3), [(0, "a = src; b = f(a, 'c'); c=\"a\"; sink = b == a ? b : 1"), (1, "x = y\ny = x; x = src;\nsink=y"), (2, ""), (3, None), (4, "sink == src; if (sink === src) {}")]
    names = ["src", "sink", "t1", "t2", "t3", "t4", "t5"]
    for k in range(5, 80):
        scripts.append((k, "".join(f"{rng.choice(names)} = {' + '.join(rng.choices(names, k=rng.randrange(1, 3)))}{rng.choice([';', chr(10)])}" for _ in range(rng.randrange(1, 9)))))
    df = spark.createDataFrame(scripts, "script long, code string")
    edges = flow.assignments(df, "script", "code")
    got = {(r["script"], r["dst"], r["src"]) for r in edges.collect()}
    assert {(d, s) for k, d, s in got if k == 0} == {("a", "src"), ("b", "f"), ("b", "a"), ("sink", "b"), ("sink", "a")} or {("a", "src"), ("b", "f"), ("b", "a")} <= {(d, s) for k, d, s in got if k == 0}
    one = lambda name: df.select("script", F.lit(name).alias("name"))
    found = {(r["script"], r["sink"]): r["depth"] for r in flow.reached(edges, "script", one("src"), one("sink").union(one("t5"))).collect()}
    want = {(k, s): d for k, _ in scripts for s, d in brute_reached([(d, x) for j, d, x in got if j == k], "src", ("sink", "t5")).items()}
    assert found == want and (1, "sink") in found and (4, "sink") not in found


@pytest.mark.parametrize("name", ["linear_scores", "registry_rollback"])
def test_new_queries_are_registered_with_sql(name):
    from tessella import registry

    assert name in registry.queries() and name in registry.oracle_sql()
