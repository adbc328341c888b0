"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(256 x). All candidates are scored against all queries, slice by
slice. First for histograms of the scores: the bin that holds each query's k-th highest score is
found from the counts of all slices, and becomes the next pass's range, until a range is one
score wide. A histogram is sent as the few bins that have a score. Then, once more, for the rows at or above the k-th score, ties by smaller id. A
slice never reports more than k rows for a query: what lies below a slice's own k best cannot
be among the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored

K, SCALE, BINS = 5, 256, 1 << 18
#: Components of a slice's candidates, at most on average, and, so that small tables are spread too, its least rows.
SLICE_CELLS, LEAST_ROWS = 1 << 24, 2048
#: Queries scored at once.
QUERY_ROWS = 64
#: Scores beyond 64-bit integers count as the nearest of them.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, dim, v, norm): valid vectors in the least of 2, 4 or 8 bytes a component, with their length.

    Vectors that are null, or hold a null, infinite or not-a-number component, take no part, nor
    do rows without an id. In 2 and 4 bytes lie the integers; 8 bytes hold the components as they came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, packed, norms = [], [], [], []
            for key, x in zip(b.column("vec_id").to_pylist(), b.column("e"), strict=True):
                values = x.values
                if values is None or values.null_count:
                    continue
                given = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(given).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(SCALE * given)
                    most, norm = np.abs(v).max(initial=0), float(np.sqrt((v * v).sum()))
                ids.append(key)
                dims.append(len(v))
                packed.append(v.astype("<i2").tobytes() if most < 1 << 15 else v.astype("<i4").tobytes() if most < 1 << 31 else given.astype("<f8").tobytes())
                norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "dim", "v", "norm"])

    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    return own.where("vec_id is not null and e is not null").mapInArrow(run, "vec_id long, dim int, v binary, norm double")


class Vectors:
    """Packed vectors of one dimension: as floating-point numbers, and the few large ones as exact integers."""

    def __init__(self, packed: list[bytes], dim: int):
        self.large = [k for k, v in enumerate(packed) if dim and len(v) == 8 * dim]
        zero = bytes(2 * dim)
        small = [v if len(v) < 8 * dim or not dim else zero for v in packed]
        self.values = np.zeros((len(packed), dim))
        for width, kind in ((2, "<i2"), (4, "<i4")):
            rows = [k for k, v in enumerate(small) if len(v) == width * dim]
            if rows and dim:
                self.values[rows] = np.frombuffer(b"".join(small[k] for k in rows), dtype=kind).reshape(-1, dim)
        self.norm = float(np.sqrt((self.values * self.values).sum(axis=1).max(initial=0)))
        self.exact = {k: [int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(SCALE * x)) for x in np.frombuffer(packed[k], dtype="<f8").tolist()] for k in self.large}

    def row(self, k: int) -> list[int]:
        return self.exact[k] if k in self.exact else [int(x) for x in self.values[k].tolist()]

    @property
    def single(self) -> np.ndarray:
        if not hasattr(self, "_single"):
            self._single = np.ascontiguousarray(self.values.T.astype(np.float32))
        return self._single


def _scores(q: Vectors, c: Vectors) -> np.ndarray:
    """Integer inner products; through floating point where that is exact, which the lengths tell."""
    most = q.norm * c.norm * (1 + 1e-9)
    if most < 1 << 24:
        scores = (q.values.astype(np.float32) @ c.single).astype(np.int64)
    elif most < 1 << 53:
        scores = (q.values @ c.values.T).astype(np.int64)
    else:
        scores = np.array([[_clamped(q.row(i), c.row(j)) for j in range(len(c.values))] for i in range(len(q.values))], dtype=np.int64)
    for i in q.large:
        scores[i] = [_clamped(q.row(i), c.row(j)) for j in range(len(c.values))]
    for j in c.large:
        scores[:, j] = [_clamped(q.row(i), c.row(j)) for i in range(len(q.values))]
    return scores


def _clamped(a: list[int], b: list[int]) -> int:
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), LOW), HIGH)


def _by_slice(report):
    """Reads rows by slice and dimension, candidates first, and reports for runs of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, cands, waiting = None, [], [], None, []

        def done():
            nonlocal waiting
            asked, waiting = waiting, []
            if not asked or not len(cands[0]):
                return None
            return report(asked, _scores(Vectors([w["v"] for w in asked], key[1]), cands[1]), cands[0])

        for b in batches:
            for row in b.to_pylist():
                if (row["slice"], row["dim"]) != key:
                    if (made := done()) is not None:
                        yield made
                    key, ids, vectors, cands = (row["slice"], row["dim"]), [], [], None
                if not row["query"]:
                    ids.append(row["vec_id"])
                    vectors.append(row["v"])
                    continue
                if cands is None:
                    cands = np.array(ids, dtype=np.int64), Vectors(vectors, row["dim"])
                    vectors = []
                waiting.append(row)
                if len(waiting) == QUERY_ROWS and (made := done()) is not None:
                    yield made
        if (made := done()) is not None:
            yield made

    return run


def _own_out(scores: np.ndarray, queries: list[dict], ids: np.ndarray) -> np.ndarray:
    """True where a row is a candidate: not of the query's own id."""
    return ids[None, :] != np.array([q["vec_id"] for q in queries], dtype=np.int64)[:, None]


def _histogram(queries: list[dict], scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    rows, other = [], _own_out(scores, queries, ids)
    for q, s, ok in zip(queries, scores, other, strict=True):
        width = int(q["width"])
        low, high = q["low"], min(q["low"] + width * q["bins"] - 1, HIGH)
        s = s[ok & (s >= low) & (s <= high)]
        if len(s) > q["need"]:
            s = np.partition(s, len(s) - q["need"])[len(s) - q["need"] :]
        # as unsigned numbers a difference from ``low`` is right even where it exceeds a signed one
        bins, counts = np.unique((s.view(np.uint64) - np.int64(low).view(np.uint64)) // np.uint64(width), return_counts=True)
        rows += [(q["vec_id"], int(x), int(n)) for x, n in zip(bins, counts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["query_id", "bin", "n"])


def _best(queries: list[dict], scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    rows, other = [], _own_out(scores, queries, ids)
    for q, s, ok in zip(queries, scores, other, strict=True):
        above = np.flatnonzero(ok & (s > q["low"]))
        ties = np.flatnonzero(ok & (s == q["low"]))
        if len(ties) > q["need"]:
            ties = ties[np.argpartition(ids[ties], q["need"] - 1)[: q["need"]]]
        rows += [(q["vec_id"], int(ids[i]), int(s[i])) for i in np.r_[above, ties]]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` highest of every query, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``. Rows of a query's own id are not among its
    candidates; where rows repeat a query's id, the one with the smallest vector asks. Vectors
    of another dimension than the query's take no part. A query without candidates has no row. Scores beyond
    the 64-bit integers count as the nearest of them, so that among them ids decide.
    """
    own = stored(integers(vectors, vec_id, embedding), "vectors")
    n, longest, dims = own.agg(F.count("*"), F.max("norm"), F.max("dim")).first()
    if not n:
        return own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    slices = max(-(-n * max(dims, 1) // SLICE_CELLS), min(64, -(-n // LEAST_ROWS)))
    bound = HIGH if longest > 3e9 else min(int(longest * longest * (1 + 1e-9)) + 1, HIGH)  # no inner product is larger
    low, width = -bound - 1, 1
    while width * BINS < bound - low + 1:
        width *= BINS
    asks = own.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    asks = stored(asks.withColumns({"low": F.lit(low).cast("long"), "need": F.lit(k)}), "queries")
    rest = {"low": F.lit(0).cast("long"), "need": F.lit(0)}
    cands = own.select(F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("query"), "vec_id", "dim", "v").withColumns(rest)

    def scored(queries: DataFrame, report, width: int, schema: str) -> DataFrame:
        each = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("query"), "vec_id", "dim", "v", "low", "need")
        both = cands.unionByName(each).withColumns({"width": F.lit(str(width)), "bins": F.lit(BINS)})
        return both.repartition("slice").sortWithinPartitions("slice", "dim", "query").mapInArrow(_by_slice(report), schema)

    while True:
        counts = scored(asks, _histogram, width, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = counts.withColumn("upto", F.sum("n").over(down)).join(asks.select(F.col("vec_id").alias("query_id"), "low", "need"), "query_id")
        # the bin that holds the k-th score; the lowest one that has a score where there are fewer than k
        reached = reached.withColumn("hit", F.col("upto") >= F.col("need"))
        chosen = reached.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("hit"), F.struct("bin", "upto", "n"))), F.min(F.struct("bin", "upto", "n"))).alias("c"), F.first("low").alias("low"), F.first("need").alias("need"))
        state = chosen.select("query_id", (F.col("low").cast("decimal(38,0)") + F.col("c.bin").cast("decimal(19,0)") * F.lit(width).cast("decimal(19,0)")).cast("long").alias("low"), (F.col("need") - F.col("c.upto") + F.col("c.n")).cast("int").alias("need"))
        asks = stored(asks.drop("low", "need").join(state.withColumnRenamed("query_id", "vec_id"), "vec_id"), "queries")
        if width == 1:
            break
        width //= BINS
    best = scored(asks, _best, 1, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
