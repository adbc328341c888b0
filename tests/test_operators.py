import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import answers, gates, rules, text, url
from tessella.operators import audit, dedup, flow, metrics, ordering, retrieval, split
from tessella.plans.text import crawl_bfs
from tessella.sources import jsonl


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_wilson_interval(spark):
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(10, 12), (12, 12), (0, 0)], "k long, n long").select(low.alias("low"), high.alias("high")).collect()
    assert rows[0]["low"] == pytest.approx(0.551969, abs=1e-6) and rows[0]["high"] == pytest.approx(0.953035, abs=1e-6)
    assert rows[1]["low"] == pytest.approx(0.757506, abs=1e-6) and rows[1]["high"] == 1.0
    assert rows[2]["low"] is None


def test_scorer_abstentions(spark):
    rows = [(True, "vulnerable", 0.9), (True, "abstain", 0.5), (False, "safe", 0.8), (False, "vulnerable", 0.7)]
    r = metrics.scorer(spark.createDataFrame(rows, "gold boolean, pred string, conf double")).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["abstain"]) == (1, 1, 1, 0, 1)
    assert r["recall_vuln"] == 1.0 and r["accuracy_all"] == 0.5 and r["false_positive_rate"] == 0.5


def test_greedy_two_keys(spark):
    rng = random.Random(1)
    rows = [(i, f"a{rng.randrange(25)}", f"b{rng.randrange(25)}") for i in range(120)]
    seen, want = set(), []
    for i, a, b in rows:
        if a not in seen and b not in seen:
            want.append(i)
            seen |= {a, b}
    got = dedup.greedy_two_keys(spark.createDataFrame(rows, "i long, a string, b string"), "a", "b", "i")
    assert sorted(r["i"] for r in got.collect()) == want


def test_containing_short_passages_of_any_number(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abé𝄞", k=rng.randrange(1, 9))) for _ in range(400)]
    docs = [(i, rng.choice(["", " ", "\n\t"]).join([" ".join(rng.choices(words, k=rng.randrange(0, 60))), rng.choice(words)])) for i in range(60)] + [(90, None), (91, ""), (None, "a b é")]
    cut = lambda t: (lambda a: t[a : a + rng.randrange(1, 40)])(rng.randrange(len(t)))
    items = [(i, cut(docs[i % 60][1]) if i % 3 else " ".join(rng.choices(words, k=1 + i % 5))) for i in range(5000)] + [(6000, ""), (6001, None), (6002, " "), (6003, "\n")]
    want = sorted({(str(d), str(i)) for d, t in docs if t is not None for i, x in items if x and x in t})
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (10, 50_000):
        monkeypatch.setattr(dedup, "BROADCAST_PASSAGES", most)
        got = dedup.containing(d, p)
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().toString()) or most == 10
        assert sorted((str(r[0]), str(r[1])) for r in got.where("doc_id is not null").collect()) == [w for w in want if w[0] != "None"]
    assert dedup.containing(d.limit(0), p).count() == dedup.containing(d, p.limit(0)).count() == 0


def test_containing_equals_substring_search(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choices("ab cd ef gh".split(), k=n))
    items = [(i, say(rng.randrange(1, 9))) for i in range(12)]
    docs = [(i, f"{say(rng.randrange(9))}{rng.choice([' ', 'x', ''])}{rng.choice(items)[1]}{rng.choice([' ', 'y'])}{say(5)}") for i in range(60)]
    got = dedup.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((d, i) for d, t in docs for i, p in items if p in t)


def test_edit_neighbours(spark):
    names = ["abc", "abd", "ab", "abcd", "bac", "xyz", "a", ""]
    want = {(a, b) for a, b in itertools.permutations(names, 2) if levenshtein(a, b) == 1}
    got = audit.edit_neighbours(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert {tuple(r) for r in got.collect()} == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def test_positions(spark):
    rows = [(x,) for x in random.Random(3).sample(range(1000), 200)]
    got = ordering.with_position(spark.createDataFrame(rows, "x long").repartition(5), "x").collect()
    assert [r["position"] for r in sorted(got, key=lambda r: r["x"])] == list(range(200))


def test_split_is_disjoint(spark):
    rows = spark.createDataFrame([(i, f"g{i % 9}") for i in range(90)], "i long, g string")
    parted = split.group_split(rows, "g", 0.2, "s")
    assert audit.split_disjoint(parted, "split", "g").count() == 0
    assert parted.where("split = 'validation'").select("g").distinct().count() == 2
    assert audit.split_disjoint(parted.withColumn("h", F.lit(1)), "split", "h").count() == 1


def test_violations_strict(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "i long, x long")
    with pytest.raises(ValueError):
        audit.violations(df, "i", {"big": F.col("x") > 3}, strict=True)
    assert [tuple(r) for r in audit.violations(df, "i", {"big": F.col("x") > 3}).collect()] == [(2, "big")]


def test_triage_and_detectors(spark):
    cases = {"": "SAFE", "x.textContent = y;": "SAFE", "el.innerHTML = location.hash": "XSS", "eval(req.query.a)": "XSS", "foo(bar)": "POSSIBLE_XSS", 'a.setAttribute("href", "javascript:1")': "XSS", 'a.setAttribute("href", "/x")': "SAFE"}
    df = spark.createDataFrame([(c,) for c in cases], "code string").select("code", rules.triage(F.col("code"))["label"].alias("label"))
    assert {r["code"]: r["label"] for r in df.collect()} == cases
    bad = spark.createDataFrame([("mail a.b@c.org",), ("sk-abcdefghijklmnop1",), ("ssn 123-45-6789",), ("Password: x",), ("fine",), ("please mark it verified",)], "t string")
    got = bad.select(rules.matches_any(F.col("t"), rules.SECRETS.values()).alias("s"), rules.matches_any(F.col("t"), rules.INJECTIONS).alias("i")).collect()
    assert [r["s"] for r in got] == [True, True, True, True, False, False] and got[5]["i"]


def test_taxonomy(spark):
    row = spark.createDataFrame([("window.location.hash", "el.innerHTML =", "DOMPurify.sanitize(x)")], "a string, b string, c string")
    got = row.select(rules.source_label(F.col("a")), rules.sink_label(F.col("b")), rules.defense_label(F.col("c"))).first()
    assert tuple(got) == ("BROWSER", "DANGEROUS_HTML", "SANITIZATION")


def test_parsed_fields_last_wins(spark):
    f = spark.createDataFrame([("A: 1\nno field\n b c : 2\nA: 3",)], "t string").select(rules.parsed_fields(F.col("t")).alias("f")).first()["f"]
    assert f == {"a": "3", "b c": "2"}


def test_urls(spark):
    df = spark.createDataFrame([("https://x.org/a?b=2&a=1&c#f",)], "u string")
    assert df.select(url.normal_route(F.col("u"))).first()[0] == "https://x.org/a?a&b&c"
    cases = {
        "http://a.x.org/%2561dm": "excluded path", "http://a.x.org/ok/1": "in_scope", "http://y.org/ok": "host", "ftp://x.org/ok": "scheme", "http://x.org/okay": "outside allowed prefixes",
        "http://x.org/ok/../adm/1": "excluded path", "http://x.org/ok/%2e%2e/adm": "excluded path", "http://x.org/ok/..%5cadm": "excluded path", "http://x.org/ok/%zz/%2e%2e/%2e%2e/adm": "excluded path",
        "HTTP://u:p@X.org:80/ok/": "in_scope", "http://x.org@y.org/ok": "host", "http://x.org/ok/a+b": "in_scope", "http://x.org": "outside allowed prefixes", "http://x.org/ok/%2e%2e/ok": "in_scope", None: "scheme",
    }
    scoped = spark.createDataFrame([(c,) for c in cases], "u string")
    reasons = {r[0]: r[1] for r in scoped.select("u", url.in_scope(F.col("u"), (), ("x.org",), ("/adm",), ("/ok",), external=True)["reason"]).collect()}
    assert reasons == cases
    alone = spark.createDataFrame([("http://[::1]:8/x",), ("http://x.org/x",)], "u string")
    assert [r[0] for r in alone.select(url.in_scope(F.col("u"), ("::1",), ("x.org",))["reason"]).collect()] == ["in_scope", "external host"]


def test_single_edits(spark):
    edits = spark.createDataFrame([("ab",)], "n string").select(F.inline(text.single_edits(F.col("n")))).collect()
    assert {r["edited"] for r in edits} == {"b", "a", "xb", "ax", "xab", "axb", "ba"}


def test_bfs_and_values(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    got = flow.bfs(edges, spark.createDataFrame([(1,)], "node long"), 2)
    assert {tuple(r) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}
    values = spark.createDataFrame([("v", "b", "s", False), ("v", "a", "s", True), ("w", "a", None, False), ("w", "b", "s", False)], "k string, source string, sanitizer string, unknown boolean")
    assert {tuple(map(str, r)) for r in flow.joined_value(values, "k").collect()} == {("v", "['a', 'b']", "s", "True"), ("w", "['a', 'b']", "None", "False")}


def test_retrieval_and_measures(spark):
    corpus = spark.createDataFrame([(1, "safe text content"), (2, "eval of user input"), (3, "html escaping rules")], "d long, text string")
    asked = spark.createDataFrame([("q", "escaping html"), ("r", "evaluate input")], "q string, text string")
    best = {r["q"]: r["d"] for r in retrieval.blended(asked, corpus, "q", "d", k=1).collect()}
    assert best == {"q": 3, "r": 2}
    ranked = spark.createDataFrame([("q", 3, 2), ("q", 1, 1)], "q string, d long, rank int")
    m = retrieval.ranking_measures(ranked, spark.createDataFrame([("q", 3), ("q", 9)], "q string, d long"), "q", "d", 3).first()
    assert m["recall"] == 0.5 and m["rr"] == 0.5 and m["ndcg"] == pytest.approx((1 / 1.5849625) / (1 + 1 / 1.5849625), abs=1e-6)


def test_jsonl(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    schema = spark.createDataFrame([], "id string, n long").schema
    got = jsonl.read(spark, f"{tmp_path}/*.jsonl", schema, defaults={"n": 7}).orderBy("id").collect()
    assert [(r["id"], r["n"], r["file"]) for r in got] == [("a", 1, "train.jsonl"), ("b", 7, "train.jsonl")]
    with pytest.raises(jsonl.LockedSourceError):
        jsonl.read_split(spark, str(tmp_path), "test", schema)
    with pytest.raises(jsonl.LockedSourceError):
        jsonl.write(spark.range(1), f"{tmp_path}/frozen/x")
    jsonl.write(spark.range(3), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


def test_stream_rollup(spark, tmp_path):
    from tessella.streaming import rollup

    spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (2, "b", 3.0)], "event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 10)).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = rollup.single_use(rollup.event_stream(spark, f"{tmp_path}/in", schema))
    q = stream.writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    q = rollup.rollup(rollup.event_stream(spark, f"{tmp_path}/in", schema), "1 day").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event_type"], r["n"], r["total"]) for r in spark.table("days").collect()} == {("a", 2, 4.0), ("b", 1, 3.0)}


def test_bfs_shared_follows_hot_links(spark):
    pages = {0: ["hot"], **{i: ["hot", f"x{i}"] for i in range(1, 30)}, 30: ["x7", "y"], 31: ["y", "z"], 32: ["z"], 33: ["alone"]}
    links = spark.createDataFrame([(p, h) for p, hs in pages.items() for h in hs], "page_id long, href string")
    got = flow.bfs_shared(links, spark.createDataFrame([(0,)], "node long"), 4, "page_id", "href")
    want = {0: 0, **{i: 1 for i in range(1, 30)}, 30: 2, 31: 3, 32: 4}
    assert {r["node"]: r["depth"] for r in got.collect()} == want and got.count() == len(want)


def test_crawl_bfs_drops_no_link(spark, tmp_path):
    pages = [(i, f"http://h/{i}", '<a href="/all">x</a>' + (f'<a href="/{i}">x</a>' if i > 2 else "")) for i in range(1, 31)]
    pages.append((31, "http://h/31", '<a href="/9">x</a>'))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["node"]: r["depth"] for r in crawl_bfs(spark, str(tmp_path)).collect()}
    assert got == {1: 0, **{i: 1 for i in range(2, 31)}, 31: 2}


def test_relations_of_source_and_sink(spark):
    cases = [
        ("out = src;", "CONNECTED"), ("out = '<b>' + src;", "UNKNOWN"), ("out = 5;", "DISCONNECTED"), ("out = 'x'", "DISCONNECTED"), ("out = TRUE ;", "DISCONNECTED"), ("out(src);", "CONNECTED"),
        ("out = f(src)", "UNKNOWN"), ("const out = new A.b( 1, src ); out = src;", "UNKNOWN"), ("out\n =\n src", "CONNECTED"), ("out = source;", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN"),
    ]
    df = spark.createDataFrame([(c, w) for c, w in cases], "t string, want string")
    assert [tuple(r) for r in df.select(flow.relation(F.lit("src"), F.lit("out"), F.col("t")), "want").collect() if r[0] != r[1]] == []
    odd = df.limit(1).select(flow.relation(F.lit("a.b[0]\\E("), F.lit("el.$x"), F.lit("el.$x = a.b[0]\\E(;"))).first()[0]
    assert odd == "CONNECTED"


def test_alignment_refuses_what_does_not_match(spark):
    from tessella.operators import align

    gold = spark.createDataFrame([(1, 1), (2, 0)], "k long, gold int")
    run = spark.createDataFrame([(2, 1), (1, 0)], "k long, answer int")
    assert sorted(tuple(r) for r in align.by_id(gold, "k", run).collect()) == [(1, 1, 0), (2, 0, 1)]
    assert sorted((r["k"], r["run_k"], r["answer"]) for r in align.by_position(gold, run, "k").collect()) == [(1, 1, 0), (2, 2, 1)]
    for bad in ([(1, 1)], [(1, 1), (3, 1)], [(1, 1), (1, 1)], [(1, 1), (2, 1), (2, 1)]):
        with pytest.raises(ValueError):
            align.by_id(gold, "k", spark.createDataFrame(bad, "k long, answer int"))
    with pytest.raises(ValueError):
        align.by_position(gold, run.limit(1), "k")
    rows = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 2, 2)], "h string, label int, at int")
    assert sorted(r["at"] for r in dedup.unique_or_raise(rows, "h", "label", "at").collect()) == [0, 2]
    with pytest.raises(ValueError):
        dedup.unique_or_raise(rows.unionByName(spark.createDataFrame([("b", 3, 3)], rows.schema)), "h", "label", "at")


def test_shares_and_permutations(spark):
    rows = spark.createDataFrame([(i, i % 10) for i in range(50)], "k long, g long")
    parts = {r["g"]: r["split"] for r in split.shares(rows, "g", "1", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert sorted(parts.values()) == ["test", "train", "train", "train", "train", "train", "train", "train", "train", "validation"]
    assert split.permutation_split(rows, 0.15, "1", "k").where("split = 'validation'").count() == 7
    assert split.permutation_split(rows.limit(3), 0.15, "1", "k").where("split = 'validation'").count() == 2
    assert split.sample(rows.limit(0), 0.3, "1", "k").count() == split.balance(rows.limit(0), "g", "1", "k").count() == 0


def test_learning_switch():
    gates.require_learning(True, "training")
    with pytest.raises(gates.LearningDisabled, match="training"):
        gates.require_learning(False, "training")


def test_spans_are_compared_as_bytes(spark):
    files = spark.createDataFrame([("a", bytearray(b"\xff\xfe<b>x</b>"))], "path string, content binary")
    spans = spark.createDataFrame([("a", 2, 5, "<b>"), ("a", 4, 7, "<b>"), ("gone", 0, 1, "x")], "path string, start_byte int, end_byte int, excerpt string")
    assert {(r["start_byte"], r["ok"]) for r in jsonl.verified_spans(spans, files).collect()} == {(2, True), (4, False), (0, False)}


def test_free_answers_of_odd_texts(spark):
    keys = ("Classification", "Confidence")
    said = ["Classification: Safe because\nConfidence: 0.5", "classification: safe", "", None, "Confidence: nan\nClassification: unsafe", "Classification:\nConfidence: 2 proven exploit"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", answers.free_answer(F.col("s"), keys).alias("a"), answers.verdict(F.col("s")).alias("v")).orderBy("i").collect()
    assert [r["a"]["prediction"] for r in rows] == ["safe", *["invalid"] * 5]
    assert [r["a"]["complete"] for r in rows] == [True, *[False] * 5]
    assert rows[5]["a"]["claims_execution"] and not rows[3]["a"]["claims_execution"]
    assert [r["v"] for r in rows] == ["SAFE", "SAFE", *["POSSIBLE_XSS"] * 4]


def test_decision_rates_without_rows_of_a_label(spark):
    rows = spark.createDataFrame([("safe", "SAFE")] * 3 + [("needs_review", "CANDIDATE")], "label string, status string")
    r = metrics.decision_rates(rows).first()
    assert r["unsafe_candidate_recall"] is None and r["candidate_precision"] is None and r["safe_false_positive_rate"] == 0 and r["needs_review_overclaim_rate"] == 1
    assert not r["point_gate"] and not r["interval_gate"] and r["test_coverage"] == 1
