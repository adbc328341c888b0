import os

import duckdb

from tessella import registry


def test_acceptance_gate_judges_the_prediction_of_every_source(spark, tmp_path):
    # (source, n_chars, quality, toxic): a rest of 30 or more is called vulnerable
    good = [(95, 1, 1), (90, 1, 0), (10, 0, 0)]
    false_alarm = [(95, 1, 1), (90, 0, 0), (10, 0, 0)]
    unsure = [(35, 1, 1), (36, 1, 0), (10, 0, 0)]
    missed = [(95, 1, 1), (1, 1, 0), (10, 0, 0)]
    cases = {f"{kind}{k}": rows for kind, rows in {"good": good, "false_alarm": false_alarm, "unsure": unsure, "missed": missed}.items() for k in range(10)}
    rows = [(i, source, *r) for i, (source, r) in enumerate((s, r) for s, own in cases.items() for r in own)]
    docs = spark.createDataFrame([(i, "", "en", s, n) for i, s, n, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {s: s.startswith("good") for s in cases}
    assert {r["source"]: r["accepted"] for r in registry.queries()["acceptance_gate"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    for name in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    assert dict(con.execute(registry.oracle_sql()["acceptance_gate"]).fetchall()) == want


def test_acceptance_gate_takes_no_label_for_an_answer_and_counts_the_missed(spark, tmp_path):
    # (n_chars, quality, toxic): 30 or more is called vulnerable, 40 or more confirmed
    safe = [(10, 0, 0)]
    cases = {
        "missed_a_quarter": [(95, 1, 1), (96, 1, 0), (97, 1, 0), (5, 1, 0), *safe],
        "missed_the_near_miss": [(95, 1, 0)] * 9 + [(5, 1, 1), *safe],
        "confirmed_13_of_20": [(95, 1, 1)] * 13 + [(35, 1, 0)] * 5 + [(1, 1, 0)] * 2 + safe,
        "confirmed_14_of_20": [(95, 1, 1)] * 14 + [(35, 1, 0)] * 4 + [(1, 1, 0)] * 2 + safe,
    }
    rows = [(i, source, *r) for i, (source, r) in enumerate((s, r) for s, own in cases.items() for r in own)]
    docs = spark.createDataFrame([(i, "", "en", s, n) for i, s, n, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {s: s == "confirmed_14_of_20" for s in cases}
    assert {r["source"]: r["accepted"] for r in registry.queries()["acceptance_gate"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    for name in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    assert dict(con.execute(registry.oracle_sql()["acceptance_gate"]).fetchall()) == want
