import json
import math
import os
import random
import tempfile
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import canonical, provenance, url
from tessella.plans import provenance as plans
from tessella.sources import sidecar, sinks
from tessella.sources.jsonl import LockedSourceError

SF = "/root/testdata/sf0.001"

# the examples of the URL standard's section on resolution, against http://a/b/c/d;p?q
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_resolve_as_the_standard_says(spark):
    rows = spark.createDataFrame([("http://a/b/c/d;p?q", r) for r in EXAMPLES], "base string, ref string")
    got = {r["ref"]: r["to"] for r in rows.select("ref", url.joined(F.col("base"), F.col("ref")).alias("to")).collect()}
    assert got == EXAMPLES


def test_references_resolve_as_the_library_does(spark):
    rng, parts = random.Random(1), ["..", ".", "a", "b c", "é", "", "x.y"]
    rows = [("http://h.example/" + "/".join(rng.choices(parts[2:5], k=rng.randrange(4))) + rng.choice(["", "?q=1"]), "/".join(rng.choices(parts, k=rng.randrange(1, 5))) + rng.choice(["", "?z", "#f"])) for _ in range(300)]
    rows = [(b, r) for b, r in rows if "//" not in r] + [("http://h.example", "g"), ("http://h.example?x", "g"), (None, "g"), ("http://h/", None)]
    got = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", url.joined(F.col("base"), F.col("ref")).alias("to")).collect()
    for r in got:
        assert r["to"] == (None if r["base"] is None or r["ref"] is None else urljoin(r["base"], r["ref"])), r


def test_anchors_of_every_form_and_the_base_element(spark):
    html = """<a href="/one">1</a><A class=x\nHREF='two '>2</A><a data-href="no" href=three>3</a><abbr href="no"></abbr><a data-href="no">x</a><a\thref = "#f">4</a>"""
    page = spark.createDataFrame([("http://h/x/y", html, '<base target="_top" href="../z/">'), ("http://h/x/y", None, "<p>")], "url string, html string, head string")
    got = page.select(url.anchors(F.col("html")).alias("a"), url.base_of(F.col("url"), F.col("head")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(["/one", "two", "three", "#f"], "http://h/z/"), (None, "http://h/x/y")]


SCHEMA = T.StructType([
    T.StructField("z", T.StringType()), T.StructField("a", T.MapType(T.StringType(), T.ArrayType(T.LongType()))), T.StructField("n", T.StructType([T.StructField("y", T.DoubleType()), T.StructField("b", T.BooleanType())])), T.StructField("d", T.DateType()), T.StructField("raw", T.BinaryType()),
])


def test_canonical_json_is_the_librarys_sorted_form(spark):
    values = [
        ('q"\\\n\t\x01\x1f/é🎈', {"b": [1, None], "a": [], 'k"': None}, (0.25, True), None, bytearray(b"ab")), (None, None, None, None, None), ("", {}, (-1e9, None), None, None), ("x", {"é": [2]}, (0.0, False), None, None),
    ]
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", SCHEMA)]))
    got = [r[0] for r in df.select(canonical.canonical(F.col("v"), SCHEMA)).collect()]
    for text, (z, a, n, _, raw) in zip(got, values, strict=True):
        want = {"z": z, "a": a, "n": None if n is None else {"y": n[0], "b": n[1]}, "d": None, "raw": "YWI=" if raw else None}
        assert text == json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    odd = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), 1e30, -0.0, 1 / 3, 5e-10, None)], "v double")
    assert [r[0] for r in odd.select(canonical.canonical(F.col("v"), T.DoubleType())).collect()] == ["null", "null", "null", "0.0", "0.333333333", "0.000000001", "null"]


def test_every_order_of_keys_gives_one_hash(spark):
    rng, value = random.Random(2), {"b": {"y": [1, {"q": None, "p": "é"}], "x": 1.5}, "a": True, "c": "t"}

    def turned(v):
        if isinstance(v, dict):
            return {k: turned(v[k]) for k in rng.sample(list(v), len(v))}
        return [turned(x) for x in v] if isinstance(v, list) else v

    texts = [json.dumps(turned(value), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) for _ in range(30)]
    assert len(set(texts)) > 10
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical_text(F.col("t")).alias("c")).distinct().collect()
    assert [r["c"] for r in got] == [json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))]
    assert spark.createDataFrame([("{no json",)], "t string").select(canonical.canonical_text(F.col("t"))).first()[0] is None


def test_every_provenance_reason_occurs_and_the_blob_is_gits(spark):
    rows = plans.provenance_reasons(spark, "/root/testdata/sf0.01").collect()
    assert {r["reason"] for r in rows} == {"ok", "duplicate_identity", "missing_original", "source_hash", "blob_identity", "fragment_outside", "fragment_hash", "static_input"}
    known = spark.createDataFrame([("test content\n",)], "t string").select(provenance.git_blob(provenance.bytes_of(F.col("t")))).first()[0]
    assert known == "d670460b4b4aece5915caf5c68d12f560a9fe3e4"


def test_runs_with_side_files_markers_and_malformed_ones(spark):
    base = tempfile.mkdtemp(prefix="spark-runs-")
    files = {
        "r1/summary.json": {"target": "t1", "requests": 3}, "r1/authorization.json": {"operator": "o"}, "r1/REVIEW.txt": "", "deep é +/r5/REVIEW.txt": "", "r2/summary.json": {"target": "t2"}, "r3/summary.json": "{broken", "r3/authorization.json": {"operator": "p"},
        "r4/authorization.json": {"operator": "alone"}, "deep é +/r5/summary.json": {"target": "t5", "requests": "no number"}, "r6/summary.json": {"target": "t6"}, "r6/authorization.json": "[", "r6/other.json": {"target": "x"},
    }
    for name, content in files.items():
        os.makedirs(f"{base}/{os.path.dirname(name)}", exist_ok=True)
        with open(f"{base}/{name}", "w") as f:
            f.write(content if isinstance(content, str) else json.dumps(content, indent=1))
    summary, side = T.StructType().add("target", "string").add("requests", "long"), T.StructType().add("operator", "string")
    got = sidecar.runs(spark, base, ("summary.json", summary), {"authorization": ("authorization.json", side)}, {"reviewed": "REVIEW.txt"})
    rows = {r["run"]: (r["summary"] and r["summary"]["target"], r["authorization"] and r["authorization"]["operator"], r["reviewed"], r["corrupt"]) for r in got.collect()}
    assert rows == {"r1": ("t1", "o", True, 0), "r2": ("t2", None, False, 0), "r3": (None, "p", False, 1), "r5": (None, None, True, 1), "r6": ("t6", None, False, 1)}


def test_manifest_is_observed_in_one_pass_and_nothing_is_overwritten(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, "é").alias("t"))
    folder, counters = tempfile.mkdtemp(prefix="spark-sink-"), {"total": F.sum("k")}
    one = sinks.write_observed(df, f"{folder}/a", counters)
    other = sinks.write_observed(df.repartition(7).orderBy(F.desc("id")), f"{folder}/b", counters)
    assert one == other == {"n_rows": 1000, "row_hash": one["row_hash"], "total": sum(i % 7 for i in range(1000))}
    assert sinks.write_observed(df.union(df.limit(1)), f"{folder}/c", {})["row_hash"] != one["row_hash"]
    assert sinks.write_observed(df.limit(0), f"{folder}/d", {}) == {"n_rows": 0, "row_hash": 0}
    with pytest.raises(Exception, match="already exists"):
        sinks.write_observed(df, f"{folder}/a", {})
    with pytest.raises(LockedSourceError):
        sinks.write_observed(df, f"{folder}/frozen/x", {})
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    made = sinks.fan_out(df.mapInArrow(counted, df.schema), f"{folder}/out", {"even": F.col("id") % 2 == 0, "odd": F.col("id") % 2 == 1, "all": F.lit(True)}, counters)
    assert reads.value == 1000  # the source is computed once for three outputs
    assert (made["even"]["n_rows"], made["odd"]["n_rows"], made["all"]) == (500, 500, one)
    assert made["even"]["row_hash"] + made["odd"]["row_hash"] == one["row_hash"]
    read = {r["name"]: json.loads(r["content"]) for r in spark.read.json(f"{folder}/out/manifest").collect()}
    assert read == made and spark.read.parquet(f"{folder}/out/odd").count() == 500
    assert math.log2(one["row_hash"]) < 48 + 10


def test_queries_on_the_smallest_tables(spark):
    assert plans.build_with_manifest(spark, SF).count() >= 2
    kinds = {r["form"] for r in plans.resolved_links(spark, SF).collect()}
    assert kinds == set(range(len(plans.FORMS)))
