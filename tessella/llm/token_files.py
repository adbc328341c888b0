"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each of whole documents, then two skippable frames that
any zstandard reader passes over: the document table (for each frame the number of documents
and of ids, and the smallest and largest document id) and the seek table in the public seekable
layout (compressed size, size and checksum of each frame, then count, flags and magic number).
A reader takes the file's tail, picks the frames that can hold the documents asked for and
decompresses only those. A frame's checksum is the low half of the XXH64 of its content.

A frame's content: count of documents (u32), width of an id (u32, 2 or 4), document ids (i64
each), a byte each that is 1 if the document id is null, number of ids of each document (u64),
and the ids, little-endian.

Writing tasks name their files anew at every attempt and return the name, so a task that runs
twice leaves at most a file that no table names.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import byte_pieces, shared_dir, stored, word_ids

SKIPPABLE_DOCS, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
DOC_ENTRY = np.dtype([("n_docs", "<u4"), ("n_ids", "<u8"), ("low", "<i8"), ("high", "<i8")])
SEEK_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
#: A frame is closed once it holds so many bytes of ids; a longer document has its own.
FRAME_BYTES = 1 << 20
_TAIL = struct.Struct("<IBI")


def _checksum(content: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(content) & 0xFFFFFFFF


@dataclass
class FrameWriter:
    """Writes documents to an open binary file; ``close`` adds the tables."""

    out: object
    width: int = 4
    level: int = 1
    docs: list = field(default_factory=list)
    held: int = 0
    doc_table: list = field(default_factory=list)
    seek_table: list = field(default_factory=list)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian, ``width`` bytes each."""
        self.docs.append((doc_id, ids))
        self.held += len(ids)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import zstandard

        if not self.docs:
            return
        keys = np.array([d or 0 for d, _ in self.docs], dtype="<i8")
        none = np.array([d is None for d, _ in self.docs], dtype="u1")
        counts = np.array([len(x) // self.width for _, x in self.docs], dtype="<u8")
        content = b"".join([struct.pack("<II", len(self.docs), self.width), keys.tobytes(), none.tobytes(), counts.tobytes(), *(x for _, x in self.docs)])
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(content)
        self.out.write(packed)
        self.seek_table.append((len(packed), len(content), _checksum(content)))
        self.doc_table.append((len(self.docs), int(counts.sum()), int(keys.min()), int(keys.max())))
        self.docs, self.held = [], 0

    def close(self) -> None:
        self.flush()
        docs = np.array(self.doc_table, dtype=DOC_ENTRY).tobytes()
        seek = np.array(self.seek_table, dtype=SEEK_ENTRY).tobytes() + _TAIL.pack(len(self.seek_table), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _whole(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without lies in Spark's default file system, not on a worker's disk."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return ("file://" if default.startswith("file:") else default.rstrip("/")) + path


class FrameReader:
    """Reads a file by its tables; ``source`` is a seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _TAIL.size)
        n, _, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        tables = 16 + n * (SEEK_ENTRY.itemsize + DOC_ENTRY.itemsize) + _TAIL.size
        source.seek(size - tables)
        tail = source.read(tables)
        at = 8 + n * DOC_ENTRY.itemsize
        self.docs = np.frombuffer(tail[8:at], dtype=DOC_ENTRY)
        self.seek = np.frombuffer(tail[at + 8 : at + 8 + n * SEEK_ENTRY.itemsize], dtype=SEEK_ENTRY)
        self.offsets = np.r_[0, np.cumsum(self.seek["packed"], dtype=np.int64)[:-1]] if n else np.zeros(0, dtype=np.int64)

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        """The documents of one frame, each with its ids."""
        return read_frame(self.source, int(self.offsets[k]), *(int(self.seek[c][k]) for c in ("packed", "size", "checksum")))

    def document(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document; only frames whose ids reach around ``doc_id`` are opened."""
        for k in np.flatnonzero((self.docs["low"] <= doc_id) & (self.docs["high"] >= doc_id)):
            for key, ids in self.frame(k):
                if key == doc_id:
                    return ids
        return None


def read_frame(source, offset: int, packed: int, size: int, checksum: int) -> list[tuple[int | None, np.ndarray]]:
    import zstandard

    source.seek(offset)
    content = zstandard.ZstdDecompressor().decompress(source.read(packed))
    if len(content) != size or _checksum(content) != checksum:
        raise ValueError(f"the frame at {offset} does not match its checksum")
    n, width = struct.unpack_from("<II", content)
    keys = np.frombuffer(content, dtype="<i8", count=n, offset=8)
    none = np.frombuffer(content, dtype="u1", count=n, offset=8 + 8 * n)
    ends = np.cumsum(np.frombuffer(content, dtype="<u8", count=n, offset=8 + 9 * n).astype(np.int64))
    ids = np.frombuffer(content, dtype=f"<u{width}", offset=8 + 17 * n)
    return [(None if x else int(k), part) for k, x, part in zip(keys, none, np.split(ids, ends[:-1]), strict=True)]


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, path: str, pieces: Callable[[str], list[str]] = byte_pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes ``text``, ends each document with ``end_id`` and writes files under ``path``.

    Documents lie in ascending order of their ids, nulls first, ties by the text's hash; file
    numbers ascend with them. Returns the stored table (shard, file, size), a row per file.
    A null text counts as empty: its end id alone. Rows that repeat are written each for itself. An empty
    table gives no file. Ids take two bytes where the tokenizer and ``end_id`` allow it.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = _whole(spark, path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    code = spark.sparkContext.broadcast(tokenizer_json)  # one tokenizer's file: its size is fixed
    width = 2 if max(end_id, *Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = word_ids(code.value, pieces), np.array([end_id], dtype="<u4").tobytes()
        shard, name = TaskContext.get().partitionId(), ""
        writer = stream = None
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            for key, ids in zip(b.column("doc_id").to_pylist(), encode.encoded(texts), strict=True):
                if writer is None:
                    name = f"{path}/{shard:06d}-{uuid.uuid4().hex}.zst"
                    system, at = _opened(name)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(at, compression=None)
                    writer = FrameWriter(stream, width)
                ids += end
                writer.add(key, ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes())
        if writer:
            writer.close()
            size = stream.tell()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "size": [size]})

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("tie"))
    dealt = own.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stored(dealt.mapInArrow(run, "shard int, file string, size long"), "token-files")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each frame, from the tables at the end of each file."""
    for b in batches:
        for shard, file, size in zip(*(b.column(c).to_pylist() for c in ("shard", "file", "size")), strict=True):
            system, at = _opened(file)
            with system.open_input_file(at) as source:
                r = FrameReader(source, size)
            n = len(r.seek)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard] * n, pa.int32()), "file": [file] * n, "frame": pa.array(range(n), pa.int32()), "offset": r.offsets}
                | {k: r.seek[k].astype(np.int64) for k in ("packed", "size", "checksum")}
                | {"n_ids": r.docs["n_ids"].astype(np.int64)}
            )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of each frame, with the checksum of its ids."""
    for b in batches:
        for x in b.to_pylist():
            system, at = _opened(x["file"])
            with system.open_input_file(at) as source:
                found = read_frame(source, x["offset"], x["packed"], x["size"], x["checksum"])
            counts = np.array([len(ids) for _, ids in found], dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([k for k, _ in found], pa.int64()),
                    "start": x["start"] + np.cumsum(counts) - counts,
                    "n_tokens": counts,
                    "ids_crc32": pa.array([crc32(ids.astype("<u4").tobytes()) for _, ids in found], pa.int64()),
                }
            )


def read_tokens(files: DataFrame) -> DataFrame:
    """Reads files back: a row (doc_id, start, n_tokens, ids_crc32) for each document.

    ``start`` counts the ids of all documents before it, over all files.
    """
    frames = stored(files.repartition("shard").mapInArrow(_frames, "shard int, file string, frame int, offset long, packed long, size long, checksum long, n_ids long"), "token-frames")
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # a row per file
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_ids")
    placed = frames.withColumn("before", before).join(base, "shard").withColumn("start", F.col("base") + F.col("before"))
    return placed.repartition("shard", "frame").select("file", "offset", "packed", "size", "checksum", "start").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(docs: DataFrame) -> str:
    return f"{shared_dir(docs.sparkSession)}/tokens/{uuid.uuid4().hex}"
