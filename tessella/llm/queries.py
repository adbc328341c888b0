"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, fill_middle, langid, line_dedup, packing, pii, prefix_trie, secret_scan, simhash, token_files, topk, toxicity, url_filter
from tessella.llm.common import held_out, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def tokenizer(name: str) -> str:
    """The content of a public tokenizer's file, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query()
def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def piece_vocabulary() -> list[str]:
    """The pieces of the public vocabulary, without its control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(toxicity.sample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ~held_out()))


@query()
def op2_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(load(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query()
def op3_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: The queries' key; a corpus that is handed on has a secret one.
SURROGATE_KEY = b"a key for the registered query"


@query()
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace(load(spark, sf_dir, "documents"), SURROGATE_KEY)
    return replaced.select("row.doc_id", "text", "n_entities")


@query()
def op5_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query(line_dedup.ORACLE)
def op6_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_runs(load(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "removed_lines")


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs, ~held_out()), piece_vocabulary())
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query(topk.ORACLE)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    files = token_files.write_tokens(docs, tokenizer("byte_bpe_50k.json"), end_id=0, path=token_files.token_folder(docs))
    return token_files.read_tokens(files)


@query()
def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def ranks() -> tuple[str, str]:
    """A public vocabulary of ranks and the pattern that goes with it, read where the driver runs."""
    import public_tokenizers

    return tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query()
def op11_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(load(spark, sf_dir, "documents"), *ranks(), keep=["doc_id"])
    counts = [F.size(F.filter("spans", secret_scan.of_kind(k))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = secret_scan.written(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("row.doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


@query(fill_middle.ORACLE)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(load(spark, sf_dir, "documents"), keep=["doc_id"])
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    cuts = [F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars")]
    restored = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select("row.doc_id", "n", "form", *cuts, sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


@query(prefix_trie.ORACLE)
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie.conversation_trie(load(spark, sf_dir, "conversations"), base=conv - conv % 100, head=head)
