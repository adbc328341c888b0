"""Each stage of the pipeline against a brute-force version, on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import simhash
from tessella.llm.common import WordIds, load, word_pieces
from tessella.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, seen = load(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        seen.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return seen


def test_all_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(before == after for *_, before, after in stages[:-1])


def test_toxicity_drops_what_scores_as_toxic(spark, stages):
    before, after, *_ = stages[0]
    bad = {r["doc_id"] for r in QUERIES["op2_compression_toxicity"](spark, SF).where(F.col("predicted") == 1).collect()}
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == bad


def test_line_dedup(stages):
    from test_text_ops import brute_lines

    before, after, *_ = stages[1]
    want = brute_lines([(r["doc_id"], r["text"]) for r in sorted(before, key=lambda r: r["doc_id"])])
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    from test_core_ops import jaccard_components

    before, after, *_ = stages[2]
    root = jaccard_components({r["doc_id"]: r["text"] for r in before}, simhash.SIMILARITY)
    kept, want = {r["doc_id"] for r in after}, {i for i, r in root.items() if i == r}
    assert want <= kept and len(kept - want) <= 0.1 * (len(root) - len(want)) + 1


def test_decontamination(spark, stages):
    before, after, *_ = stages[3]
    words = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    items = [words(r["text"]) for r in load(spark, SF, "benchmark").collect()]
    held = {r["doc_id"] for r in before if any(i in words(r["text"]) for i in items)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert held <= gone and len(gone - held) <= 2


def test_packing(stages):
    before, after, *_ = stages[4]
    ids, got = WordIds(tokenizer("word_bpe_49k.json"), word_pieces), {}
    for r in after:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {r["doc_id"]: len(x) // 4 + 1 for r, x in zip(before, ids.encoded([r["text"] for r in before]), strict=True)}
    by_sequence = {}
    for r in after:
        by_sequence[r["sequence_id"]] = by_sequence.get(r["sequence_id"], 0) + r["length"]
    assert max(by_sequence.values()) <= 4096 and sum(by_sequence.values()) > 0.9 * 4096 * (len(by_sequence) - 1)


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in rows) == sorted((r["doc_id"], r["start"], r["length"]) for r in stages[4][1])
