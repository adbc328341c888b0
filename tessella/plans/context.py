"""Queries on nested contexts, proposals on what to show first, and value flow over scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import context
from tessella.operators import flow
from tessella.registry import query
from tessella.tables import load

#: The parts of a context, each with faults: of a page's id by 16 the fault with that number applies.
PARTS = {
    "evidence_ref": ('"page {n}"', {0: '"  "', 1: "{n}"}),
    "receivers": ('["#a","b"]', {3: '["#a",""]', 4: '"#a"'}),
    "jquery_globals": ('["$","jQuery"]', {5: '["$","$"]', 6: '["$","1x"]'}),
    "inputs": ('{"#q":["value","attribute:data-x"],".r":["name"]}', {7: '["#q"]', 8: '{"#q":[]}', 9: '{"#q":["value","inner HTML"]}', 15: "{}"}),
    "bindings": ('{"el":{"selector":"#q","kind":"dom","inert_node":false},"$b":{"kind":"jquery","selector":".x"}}', {10: '{"e l":{"selector":"#q","kind":"dom"}}', 11: '{"el":{"selector":"#q","kind":"dom","more":1}}', 12: '{"el":{"selector":"","kind":"dom"}}', 13: '{"el":{"selector":"#q","kind":"dom","inert_node":0}}'}),
}


def sql_context() -> str:
    parts = []
    for name, (good, faults) in PARTS.items():
        quoted = lambda x: "replace('" + x + "', '{n}', page_id::VARCHAR)"
        cases = " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in faults.items())
        parts.append(f"""'"{name}":' || CASE page_id % 16 {cases} ELSE {quoted(good)} END""")
    return "'{' || " + " || ',' || ".join(parts) + """ || CASE page_id % 16 WHEN 2 THEN ',"more":null' ELSE '' END || '}'"""


def made_context() -> Column:
    k, n = F.col("page_id") % 16, F.col("page_id").cast("string")
    of = lambda x: F.replace(F.lit(x), F.lit("{n}"), n)
    parts = []
    for name, (good, faults) in PARTS.items():
        value = of(good)
        for at, fault in faults.items():
            value = F.when(k == at, of(fault)).otherwise(value)
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(k == 2, ',"more":null').otherwise(""), F.lit("}"))


@query(rf"""
WITH c AS (SELECT page_id, ({sql_context()})::JSON AS j FROM pages),
k AS (SELECT page_id, j, json_keys(j) AS keys, CASE WHEN json_type(j, '$.inputs') = 'OBJECT' THEN list_transform(json_keys(j, '$.inputs'), lambda k: json_extract(j, '$.inputs."' || k || '"')) ELSE [] END AS reads,
 CASE WHEN json_type(j, '$.bindings') = 'OBJECT' THEN json_keys(j, '$.bindings') ELSE [] END AS names FROM c),
b AS (SELECT *, list_transform(names, lambda n: json_extract(j, '$.bindings."' || n || '"')) AS bound FROM k)
SELECT page_id, CASE WHEN json_type(j, '$.evidence_ref') <> 'VARCHAR' OR trim(j->>'$.evidence_ref') = '' THEN 'evidence_ref' WHEN len(list_filter(keys, lambda k: k NOT IN ('evidence_ref', 'jquery_globals', 'inputs', 'bindings', 'receivers'))) > 0 THEN 'unknown_fields'
 WHEN json_type(j, '$.receivers') <> 'ARRAY' OR list_contains(json_extract_string(j, '$.receivers[*]'), '') THEN 'receivers'
 WHEN len(list_distinct(json_extract_string(j, '$.jquery_globals[*]'))) < json_array_length(j, '$.jquery_globals') OR len(list_filter(json_extract_string(j, '$.jquery_globals[*]'), lambda g: NOT regexp_full_match(g, '[A-Za-z_$][A-Za-z0-9_$]*'))) > 0 THEN 'globals'
 WHEN json_type(j, '$.inputs') <> 'OBJECT' THEN 'maps' WHEN len(list_filter(reads, lambda r: json_array_length(r) = 0)) > 0 THEN 'input_reads'
 WHEN len(list_filter(flatten(list_transform(reads, lambda r: json_extract_string(r, '$[*]'))), lambda o: NOT (o IN ('value', 'text', 'textContent', 'innerText', 'html', 'name') OR regexp_full_match(o, 'attribute:[A-Za-z_:][A-Za-z0-9_:.-]*')))) > 0 THEN 'read_operation'
 WHEN len(list_filter(names, lambda n: NOT regexp_full_match(n, '[A-Za-z_$][A-Za-z0-9_$]*'))) > 0 OR len(list_filter(bound, lambda x: len(list_filter(json_keys(x), lambda k: k NOT IN ('selector', 'kind', 'inert_node'))) > 0)) > 0 THEN 'binding'
 WHEN len(list_filter(bound, lambda x: (x->>'$.selector') = '' OR (x->>'$.kind') NOT IN ('dom', 'jquery') OR coalesce(json_type(x, '$.inert_node'), 'BOOLEAN') <> 'BOOLEAN')) > 0 THEN 'typed_binding' ELSE 'ok' END AS reason FROM b""")
def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each page's context breaks; faults of every kind are put in by the page's id."""
    return load(spark, sf_dir, "pages").select("page_id", context.context_failure(made_context()).alias("reason"))


@query("""
WITH p AS (SELECT l_orderkey, 'p' || lpad(l_linenumber::VARCHAR, 2, '0') AS id, CASE WHEN min(l_returnflag) = 'R' THEN 'CANDIDATE' WHEN min(l_quantity) < 10 THEN 'INCONCLUSIVE' WHEN min(l_linestatus) = 'O' THEN 'UNREACHABLE' ELSE 'SAFE_OBSERVED' END AS status FROM lineitem GROUP BY ALL),
o AS (SELECT l_orderkey, l_orderkey % 9 AS k, list(id ORDER BY id) AS ids, list(id ORDER BY id) FILTER (status IN ('CANDIDATE', 'INCONCLUSIVE')) AS must, list(id ORDER BY CASE status WHEN 'CANDIDATE' THEN 0 WHEN 'INCONCLUSIVE' THEN 1 WHEN 'SAFE_OBSERVED' THEN 2 ELSE 3 END, id) AS ranked FROM p GROUP BY l_orderkey)
SELECT l_orderkey, CASE k WHEN 0 THEN 'unsupported_model_schema' WHEN 1 THEN 'unsupported_schema_version' WHEN 2 THEN 'snippet_hash_mismatch' WHEN 3 THEN 'invalid_path_id_list' WHEN 4 THEN 'duplicate_path_ids' WHEN 5 THEN 'unsupported_path_id' ELSE 'existing_path_ids_only' END AS reason,
 array_to_string(CASE WHEN k < 6 THEN ranked WHEN k = 8 THEN coalesce(must, []) ELSE list_concat(coalesce(must, []), list_filter([ids[-1]], lambda x: NOT list_contains(coalesce(must, []), x))) END, ',') AS shown FROM o""")
def focus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's paths are shown in: mandatory ones first, then an accepted proposal; else by priority."""
    line = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("p"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("path_id")).agg(
        F.when(F.min("l_returnflag") == "R", "CANDIDATE").when(F.min("l_quantity") < 10, "INCONCLUSIVE").when(F.min("l_linestatus") == "O", "UNREACHABLE").otherwise("SAFE_OBSERVED").alias("status")
    )
    own = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("path_id", "status"))).alias("paths"))
    k, sha = F.col("l_orderkey") % 9, F.sha2(F.col("l_orderkey").cast("string").cast("binary"), 256)
    last = F.element_at("paths", -1)["path_id"]
    listed = F.concat(F.lit('["'), last, F.lit('"]'))
    listed = F.when(k == 3, F.lit('["p01",2]')).when(k == 4, F.concat(F.lit('["'), last, F.lit('","'), last, F.lit('"]'))).when(k == 5, F.lit('["p99"]')).when(k == 8, F.lit("[]")).otherwise(listed)
    proposal = F.concat(F.lit('{"schema_version":"'), F.when(k == 1, "focus-v0").otherwise(context.SCHEMA), F.lit('","snippet_sha256":"'), F.when(k == 2, "0").otherwise(sha), F.lit('","focus_path_ids":'), listed, F.when(k == 0, ',"score":1').otherwise(""), F.lit("}"))
    chosen = own.withColumn("chosen", context.focus(proposal, sha, F.col("paths")))
    return chosen.select("l_orderkey", F.col("chosen.reason").alias("reason"), F.array_join(context.shown(F.col("chosen"), F.col("paths")), ",").alias("shown"))


@query(r"""
WITH RECURSIVE s AS (SELECT l_orderkey AS script, string_agg('v' || l_partkey % 9 || ' = f(v' || l_suppkey % 9 || ', "v8") + v' || l_linenumber % 9 || ';', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS code FROM lineitem GROUP BY 1),
a AS (SELECT script, unnest(regexp_extract_all(regexp_replace(code, '''[^''\n]*''|"[^"\n]*"', '0', 'g'), '([A-Za-z_$][\w$]*)\s*=\s*([^;=\n][^;\n]*)')) AS said FROM s),
e AS (SELECT DISTINCT script, regexp_extract(said, '([A-Za-z_$][\w$]*)\s*=', 1) AS dst, unnest(regexp_extract_all(regexp_replace(said, '^[^=]*=', ''), '[A-Za-z_$][\w$]*')) AS src FROM a),
w(script, name, depth) AS (SELECT script, 'v1', 0 FROM s UNION SELECT e.script, e.dst, depth + 1 FROM w JOIN e ON e.script = w.script AND e.src = w.name WHERE depth < 10)
SELECT script, name AS sink, min(depth) AS depth FROM w WHERE name IN ('v5', 'v6', 'v7') GROUP BY script, name""")
def script_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a script of assignments; which of three names the value of ``v1`` reaches."""
    said = F.concat(F.lit("v"), F.col("l_partkey") % 9, F.lit(" = f(v"), F.col("l_suppkey") % 9, F.lit(', "v8") + v'), F.col("l_linenumber") % 9, F.lit(";"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("script")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", said.alias("said")))).alias("lines"))
    scripts = lines.select("script", F.array_join(F.transform("lines", lambda x: x["said"]), "\n").alias("code"))
    names = lambda *each: scripts.select("script", F.explode(F.array(*map(F.lit, each))).alias("name"))
    return flow.reached(flow.assignments(scripts, "script", "code"), "script", names("v1"), names("v5", "v6", "v7"))
