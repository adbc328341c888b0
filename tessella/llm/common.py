"""What the operators share: tables in the shared folder, tokenizers, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, as in tests on one machine, a fresh local folder is set; a cluster's
    executors would not share that, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    It cuts the lineage and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root the smallest node.

    Alternates large-star and small-star steps. Every step is a join and an aggregate, and its
    edges, never more than those before, are stored in the shared folder, so that no lineage
    grows and no node's neighbours are gathered in one task. Nodes without an edge do not appear.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e, before = stored(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(low, "u")
        e = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


#: White space as the tokenizers' patterns know it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers below U+0250; all others there are marks and signs.
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
#: Texts with none of these are cut finer: every character's kind is known and no contraction occurs.
INTRICATE = re.compile("['\u0250-\U0010ffff]")
#: A text's pieces that the byte-level tokenizer never joins: a word with the space before it,
#: white space that another one follows, a single white space.
BYTE_PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
BYTE_FINER = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: The same for the tokenizer that drops white space and lower-cases.
WORD_PIECES = re.compile(f"[^{WHITE}]+")
WORD_FINER = re.compile(f"[{LETTERS}]+|[^{WHITE}{LETTERS}]+")


def byte_pieces(text: str) -> list[str]:
    return (BYTE_PIECES if INTRICATE.search(text) else BYTE_FINER).findall(text)


def word_pieces(text: str) -> list[str]:
    return WORD_PIECES.findall(text) if INTRICATE.search(text) else WORD_FINER.findall(text.lower())


class WordIds(dict):
    """The token ids of text pieces as little-endian unsigned 32-bit bytes.

    ``encoded(texts)`` gives each text's ids. Pieces not seen yet are encoded by the tokenizer,
    all at once: words as one text, cut again where the vocabulary marks a word's beginning or
    end, other pieces each for itself. A text that contains an added token, which no piece may cut,
    is encoded whole by ``tokenizer``, as it was loaded. The memory is emptied beyond ``most`` pieces, and a piece
    of over ``LONG`` characters is forgotten with the next that is new.
    """

    LONG = 200

    def __init__(self, tokenizer_json: str, cut: Callable[[str], list[str]], most: int = 800_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.cut, self.most, self.long = Tokenizer.from_str(tokenizer_json), cut, most, []
        self.plain = Tokenizer.from_str(tokenizer_json)
        self.plain.encode_special_tokens = True  # words are learnt side by side: "<|", "end", "|>" in a row are no token
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)", re.IGNORECASE)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.marks = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.marks[[k for t, k in vocabulary.items() if (t.endswith(suffix) if suffix else t.startswith("\u0120"))]] = True
        self.at_end, self.word = bool(suffix), re.compile(f"[{LETTERS}]+" if suffix else f" [{LETTERS}]+")

    def learn(self, keys: set[str]) -> None:
        for key in self.long:
            self.pop(key, None)
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(keys)
        self.long = [k for k in new if len(k) > self.LONG]
        words = [k for k in new if self.word.fullmatch(k)]
        rest = [k for k in new if not self.word.fullmatch(k)]
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.plain.encode_batch_fast([(" " if self.at_end else "").join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            marked = np.flatnonzero(self.marks[ids])
            if len(marked) != len(part):
                rest += part
                continue
            ends = (marked + 1 if self.at_end else np.r_[marked[1:], len(ids)]) * 4
            whole, start = ids.tobytes(), 0
            for key, end in zip(part, ends.tolist(), strict=True):
                self[key] = whole[start:end]
                start = end
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for key, code in zip(part, self.plain.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[key] = np.array(code.ids, dtype="<u4").tobytes()

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        for run in batches_of(texts, 2_000_000):
            cut = [None if self.added.search(t) else self.cut(t) for t in run]
            self.learn(set().union(*filter(None, cut)))
            for text, keys in zip(run, cut, strict=True):
                if keys is None:
                    yield np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
                else:
                    yield b"".join(map(self.__getitem__, keys))


_WORD_IDS: dict[int, WordIds] = {}


def word_ids(tokenizer_json: str, cut: Callable[[str], list[str]]) -> WordIds:
    """One ``WordIds`` for each tokenizer and Python worker."""
    key = hash(tokenizer_json)
    if key not in _WORD_IDS:
        _WORD_IDS[key] = WordIds(tokenizer_json, cut)
    return _WORD_IDS[key]


def batches_of(texts: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """``texts`` in runs of about ``chars`` characters, one text at least."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
