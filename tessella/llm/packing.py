"""Packing by cutting stock with column generation.

Documents become token ids, are cut at multiples of the sequence length, and the rests, in
length classes of ``GRAIN`` tokens, are packed: a linear program chooses how often to use each
pattern of classes that fits a sequence; a knapsack by dynamic programming prices new patterns
until none helps. Its size follows the number of classes, not of documents. Counts are rounded
down, and the few pieces left over, at most one pattern's worth for each class, are placed
first-fit. Patterns then give out slots, and the pieces, ranked in their class, take them.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored, word_ids, word_pieces

LENGTH, GRAIN = 4096, 8
#: Pieces of a part: a class is ranked in as many parts as its pieces ask for, so that no class meets in one task.
PART_PIECES = 100_000


def pieces_of(docs: DataFrame, tokenizer_json: str, end_id: int, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): documents cut at multiples of ``length``."""
    code = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one tokenizer's file: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(code.value, word_pieces), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            texts = [x or "" for x in b.column("text").to_pylist()]
            for key, ids in zip(b.column("doc_id").to_pylist(), encode.encoded(texts), strict=True):
                ids += end
                total = len(ids) // 4
                rows += [(key, at, min(length, total - at), crc32(ids[4 * at : 4 * (at + length)]), total) for at in range(0, total, length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=names)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _best_pattern(sizes: np.ndarray, price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` within ``room`` (unbounded knapsack)."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        value[c], choice[c] = value[c - 1], -1
        if k := upto[c]:
            got = value[c - sizes[:k]] + price[:k]
            best = int(got.argmax())
            if got[best] > value[c] + 1e-12:
                value[c], choice[c] = got[best], best
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return value[room], pattern


def cutting_stock(sizes: np.ndarray, counts: np.ndarray, room: int, gap: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size) and how often to use each, covering ``counts`` exactly.

    The linear program is solved to within ``gap`` of its optimum by the revised simplex method.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(room // sizes).astype(float)
    inverse, x = np.diag(1 / np.diag(basis)), counts / np.diag(basis)
    for _ in range(20 * m):
        price = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = _best_pattern(sizes, price, room)
        if value <= 1 + gap:
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        np.maximum(x, 0, out=x)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = pattern
    patterns = [(basis[:, k].astype(int), int(x[k] + 1e-7)) for k in range(m)]
    rest = counts.astype(np.int64).copy()
    used = []
    for p, times in patterns:
        have = p > 0
        times = min(times, int((rest[have] // p[have]).min())) if have.any() else 0
        if times > 0:
            used.append((p, times))
            rest -= p * times
    return used + [(p, 1) for p in _first_fit(sizes, rest, room)]


def _first_fit(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[np.ndarray]:
    """Packs pieces, longest first, each sequence filled with the longest pieces that still fit."""
    counts, found = counts.copy(), []
    while counts.any():
        pattern, left = np.zeros(len(sizes), dtype=int), room
        for k in range(len(sizes) - 1, -1, -1):
            if take := min(int(counts[k]), int(left // sizes[k])):
                pattern[k] += take
                left -= take * sizes[k]
        counts -= pattern
        found.append(pattern)
    return found


def _slots(histogram: dict[int, int], room: int) -> dict[str, np.ndarray]:
    """Runs of slots: from rank ``rank`` on, the class's pieces go ``each`` to a sequence from ``sequence`` on."""
    sizes = np.array(sorted(k for k in histogram if k < room), dtype=np.int64)
    plan = cutting_stock(sizes, np.array([histogram[int(k)] for k in sizes], dtype=np.int64), room)
    runs, given, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan:
        for k in np.flatnonzero(pattern):
            size = int(sizes[k])
            runs.append((size, given[size], sequence, int(pattern[k])))
            given[size] += int(pattern[k]) * times
        sequence += times
    if room in histogram:
        runs.append((room, 0, sequence, 1))
    runs.sort()
    return dict(zip(("size", "rank", "sequence", "each"), np.array(runs, dtype=np.int64).reshape(-1, 4).T, strict=True))


def pack(pieces: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Gives every piece its ``sequence_id`` and ``offset``; ``pieces`` has doc_id, start and length.

    ``pieces`` should be a stored table: it is read twice. An empty table stays empty.
    """
    room = length // grain
    own = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("piece"), F.ceil(F.col("length") / grain).cast("long").alias("class"))
    # at most room rows, however many documents there are
    histogram = {r["class"]: r["count"] for r in own.groupBy("class").count().collect()}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    slots = _slots(histogram, room)
    parts = F.create_map(*[F.lit(x) for k, n in histogram.items() for x in (k, -(-n // PART_PIECES))])[F.col("class")]
    own = own.withColumn("part", F.pmod(F.xxhash64("piece.doc_id", "piece.start"), parts).cast("int"))
    counts = stored(own.groupBy("class", "part").count(), "piece-counts")
    before = counts.select("class", "part", (F.sum("count").over(Window.partitionBy("class").orderBy("part")) - F.col("count")).alias("before"))
    order = Window.partitionBy("class", "part").orderBy(F.desc("piece.length"), "piece.doc_id", "piece.start", *([F.col("piece.ids_crc32")] if "ids_crc32" in pieces.columns else []))
    ranked = own.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(before, ["class", "part"])
    ranked = ranked.select("piece", "class", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots["size"] << 44 | slots["rank"]
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("class", "rank"))
            run = np.searchsorted(keys, size << 44 | rank, side="right") - 1
            inner = rank - slots["rank"][run]
            sequence = slots["sequence"][run] + inner // slots["each"][run]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(inner % slots["each"][run])], names=[*b.schema.names, "sequence_id", "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot")
    offset = F.sum("piece.length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("piece.length")
    return placed.select("piece.*", "sequence_id", offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_json: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Tokenizes, cuts and packs ``docs``: a row per piece.

    A null text counts as empty: its end id alone. Repeated rows are packed each for itself, and so are
    rows without an id; an empty table stays empty, and other columns of ``docs`` are not read.
    """
    return pack(stored(pieces_of(docs, tokenizer_json, end_id, length), "pieces"), length)
