"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items.

The index holds the benchmark, and every passage of the training documents is a query against
it. A score is BM25 over the passage's distinct terms, divided by the item's score for itself,
so that one threshold serves all items. Passages overlap by half and are at least twice the
longest item, so that a whole item always lies in one of them. A passage retrieves every item
above the threshold; each is then verified: five-word shingles of the item's question (all but
its last sentence) and of its answer (the last sentence) must be found in the passage.

Only passages that can reach the threshold are searched at all, so WAND sees few of them: most of the
work is this bound, which a WAND over all passages would take eight times as long for. The commonest terms are set
aside as long as they give no item more than a share of its score; for the others, each half
passage's weights are summed by item, for a document's passages at once. An item's sums in two
halves and what the common terms give it at most bound its score in the passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Share of an item's own score from which a passage is retrieved, and shingle overlap from which it counts.
RETRIEVE, OVERLAP, SHINGLE = 0.55, 0.8, 5
#: Share of an item's score that common terms may give.
SET_ASIDE = 0.3
#: Postings of a block, items of an index (more items make more indexes), words of a passage at least.
BLOCK, SHARD_ITEMS, PASSAGE = 64, 20_000, 128

_TERM = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The terms of all sentences but the last, and of the last that has any."""
    parts = [t for s in _SENTENCE.findall(text) if (t := terms_of(s))]
    return [t for p in parts[:-1] for t in p], parts[-1] if parts else []


class ItemIndex:
    """The inverted index of up to ``SHARD_ITEMS`` items; ``n``, ``df``, ``mean`` and ``longest`` (in terms) are over all items."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, df: dict[str, int], mean: float, longest: int):
        self.ids = [i for i, _ in items]
        words = [terms_of(t) for _, t in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.passage = max(PASSAGE, 2 * longest)
        idf = {t: log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, w in enumerate(words):
            tf = Counter(w)
            weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            own = sum(weight.values())
            for t, x in weight.items():
                postings.setdefault(t, []).append((k, x / own))
        order = sorted(postings, key=lambda t: (-len(postings[t]), t))
        self.term = {t: i for i, t in enumerate(order)}
        self.docs = [[k for k, _ in postings[t]] for t in order]
        self.weights = [[x for _, x in postings[t]] for t in order]
        self.block_max = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]
        self.greatest = [max(w) for w in self.weights]
        reach, self.common = np.zeros(len(items)), 0
        for t in range(len(order)):
            more = reach.copy()
            more[self.docs[t]] += self.weights[t]
            if more.max() > SET_ASIDE:
                break
            reach, self.common = more, t + 1
        self.reach = reach
        self.ends = np.r_[0, np.cumsum([len(d) for d in self.docs], dtype=np.int64)].astype(np.int64)
        self.flat_docs = np.array([k for d in self.docs for k in d], dtype=np.int64)
        self.flat_weights = np.array([x for w in self.weights for x in w])

    def passages(self, found: np.ndarray) -> list[int]:
        """Starts of the passages that may reach the threshold; ``found``: the words' term numbers.

        For every half passage the weights of its rarer terms are summed by item; two halves, and
        what the common terms can give that item at most, bound its score.
        """
        half, n_items, n_terms = self.passage // 2, len(self.ids), len(self.term)
        blocks = -(-len(found) // half)
        step, starts = max(2, 4_000_000 // n_items), []
        for first in range(0, max(blocks - 1, 1), step - 1):
            part = found[first * half : (first + step) * half]
            block = np.arange(len(part)) // half
            rare = (part >= self.common) & (part < n_terms)
            keys = np.unique(block[rare] * n_terms + part[rare])
            b, t = keys // n_terms, keys % n_terms
            size = self.ends[t + 1] - self.ends[t]
            at = np.repeat(self.ends[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
            n = min(step, blocks - first)
            sums = np.bincount(np.repeat(b, size) * n_items + self.flat_docs[at], weights=self.flat_weights[at], minlength=n * n_items).reshape(n, n_items)
            both = sums[:-1] + sums[1:] if n > 1 else sums
            starts += [(first + k) * half for k in np.flatnonzero((both + self.reach >= RETRIEVE - 1e-9).any(axis=1)).tolist()]
        return starts

    def search(self, terms: list[int], least: float = RETRIEVE) -> list[tuple[int, float]]:
        """Block-max WAND: all items (by position) that score ``least`` or more."""
        at = {t: 0 for t in terms}
        found = []
        while True:
            live = sorted((self.docs[t][at[t]], t) for t in at if at[t] < len(self.docs[t]))
            total, pivot = 0.0, None
            for k, (doc, t) in enumerate(live):
                total += self.greatest[t]
                if total >= least - 1e-9:
                    pivot = doc
                    break
            if pivot is None:
                return found
            while k + 1 < len(live) and live[k + 1][0] == pivot:
                k += 1
            ahead = [t for _, t in live[: k + 1]]
            # the blocks that would hold the pivot
            blocks = {t: bisect_left(self.docs[t], pivot, at[t]) for t in ahead}
            bound = sum(self.block_max[t][p // BLOCK] for t, p in blocks.items() if p < len(self.docs[t]))
            if bound >= least - 1e-9:
                score = sum(self.weights[t][p] for t, p in blocks.items() if p < len(self.docs[t]) and self.docs[t][p] == pivot)
                if score >= least - 1e-9:
                    found.append((pivot, score))
                to = pivot + 1
            else:
                # nothing up to the end of the nearest of these blocks, or to the next term's item
                ends = [self.docs[t][min((p // BLOCK + 1) * BLOCK, len(self.docs[t])) - 1] + 1 for t, p in blocks.items() if p < len(self.docs[t])]
                to = max(min([*ends, *([live[k + 1][0]] if k + 1 < len(live) else [])], default=pivot + 1), pivot + 1)
            for t in ahead:
                at[t] = bisect_left(self.docs[t], to, at[t])

    def overlaps(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the shingles of the item's question and answer that ``words`` hold."""
        shares = []
        for part in self.parts[item]:
            if not part:
                shares.append(1.0)
                continue
            size = min(SHINGLE, len(part))
            have = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            own = shingles(part)
            shares.append(len(own & have) / len(own))
        return shares[0], shares[1]

    def hits(self, text: str) -> list[dict]:
        """The items that a text holds, each with its best passage."""
        words = terms_of(text)
        get, none = self.term.get, len(self.term)
        found = np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))
        best: dict[int, dict] = {}
        for start in self.passages(found) if len(words) else []:
            terms = sorted(set(found[start : start + self.passage].tolist()) - {none})
            for item, score in self.search(terms):
                q, a = self.overlaps(item, words[start : start + self.passage])
                if q >= OVERLAP and a >= OVERLAP and score > best.get(item, {"score": 0})["score"]:
                    best[item] = {"item_id": self.ids[item], "score": float(score), "question_overlap": q, "answer_overlap": a}
        return [best[k] for k in sorted(best)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = [(t, len(w)) for x in b.column("text") for w in [terms_of(x.as_py())] for t in set(w)]
        yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in each], pa.string())})


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(terms_of(x.as_py())) for x in b.column("text")], pa.int64())], names=["item_id", "text", "words"])


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[ItemIndex]:
    """The index, or beyond ``SHARD_ITEMS`` items one for each share of them, with statistics over all.

    Items without a term are left out, and of rows alike in id and text one counts.
    """
    own = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    own = own.mapInArrow(_lengths, "item_id long, text string, words long").where("words > 0")
    n, mean, longest = own.agg(F.count("*"), F.avg("words"), F.max("words")).first()
    shards = -(-n // SHARD_ITEMS)
    for k in range(shards):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k) if shards > 1 else own
        items = sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if not items:  # a share that no item's hash falls into
            continue
        df = Counter(t for _, x in items for t in set(terms_of(x)))
        if shards > 1:
            mine = part.mapInArrow(_terms, "term string").distinct()
            df = {r["term"]: r["n"] for r in own.mapInArrow(_terms, "term string").join(mine, "term").groupBy("term").agg(F.count("*").alias("n")).collect()}
        yield ItemIndex([(i, x) for i, x in items if terms_of(x)], n, df, mean, longest)


HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def with_hits(docs: DataFrame, index: ItemIndex, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``hits``: the items of ``index`` that each whole text holds; none for a null text."""
    held = docs.sparkSession.sparkContext.broadcast(index)  # at most SHARD_ITEMS items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
        for b in batches:
            hits = pa.array([held.value.hits(x.as_py() or "") for x in b.column("_text")], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], hits], names=[*keep, "hits"])

    taken = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(run, f"{fields}, hits {HITS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap), one for each item that a document holds.

    Clean documents have no row; an empty table on either side gives none. A null or empty text holds
    none; texts of any length are searched whole, and rows that repeat give their rows each for itself. Of passages
    with one score the first tells an item's overlaps. Columns of other names are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = [with_hits(own, x, "text", ("doc_id",)).select("doc_id", F.inline("hits")) for x in indexes(benchmark)]
    if not found:
        return own.limit(0).select("doc_id", F.inline(F.lit(None).cast(HITS)))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``text`` holds a benchmark item.

    Null and empty texts stay, rows that repeat stay or go together, and columns of any name stay as they are.
    """
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    for index in indexes(benchmark):
        left = with_hits(left, index, "text", ("row", "text")).where(F.size("hits") == 0).select("row", "text")
    return left.select("row.*")
