"""Language identification by unigrams, with all segmentations of a word summed.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities: a forward pass over its characters, in logarithms, gives it for words of any length.
The probabilities are trained by expectation maximisation, forward and backward, on a bounded
sample of labelled texts. A text's score for a language is the sum of its words'
log-probabilities, over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, stored

#: Most texts of a language in the sample; each is read whole.
SAMPLE_TEXTS = 300
ROUNDS, SMOOTH, UNKNOWN = 4, 0.1, 1e-7
#: Words whose scores a worker keeps, letters of words handled at once, languages up to which their counts are broadcast.
KEPT_WORDS, BATCH_LETTERS, BROADCAST_LANGUAGES = 400_000, 100_000, 10_000

_WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lattice:
    """The pieces of the vocabulary as a trie, and where they lie in words."""

    def __init__(self, pieces: list[str]):
        self.symbol = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.longest, self.width = max(map(len, pieces), default=1), len(self.symbol) + 1
        steps: dict[int, int] = {}  # state * width + symbol -> state; state 0 is the root
        ends = [-1]
        for k, p in enumerate(pieces):
            at = 0
            for c in p:
                key = at * self.width + self.symbol[c]
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                at = steps[key]
            ends[at] = k
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.states = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int64)
        self.piece = np.array(ends, dtype=np.int64)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which walks go on, and the states of those."""
        key = state * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        on = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.zeros(0, dtype=np.int64)
        return on, self.states[at[on]]

    def batches(self, words: list[str]) -> Iterator[list[int]]:
        """Positions of words in runs of like length and of about ``BATCH_LETTERS`` letters, one word at least."""
        order, run, cells = sorted(range(len(words)), key=lambda k: len(words[k])), [], 0
        for k in order:
            size = len(words[k]) + 1
            if run and (len(run) + 1) * size > BATCH_LETTERS:
                yield run
                run = []
            run.append(k)
        if run:
            yield run

    def arcs(self, words: list[str]) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """The words' lengths with the mark, and for each start (start, rows, sizes, pieces).

        Piece -1 stands for a symbol that is no piece. A word is a row; (row, size) are distinct.
        """
        marked = [MARK + w for w in words]
        lengths = np.array([len(m) for m in marked], dtype=np.int64)
        offsets, get = np.cumsum(lengths) - lengths, self.symbol.get
        flat = np.fromiter((get(c, 0) for m in marked for c in m), dtype=np.int64, count=int(lengths.sum()))

        def found() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            span = max(1, BATCH_LETTERS // len(words))
            for first in range(0, int(lengths.max()), span):
                many = np.clip(lengths - first, 0, span)
                row = np.repeat(np.arange(len(words)), many)
                start = first + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                cell, state = offsets[row] + start, np.zeros(len(row), dtype=np.int64)
                parts = []
                for size in range(1, self.longest + 1):
                    on, after = self._step(state, flat[cell + size - 1])
                    if size == 1:
                        piece = np.full(len(row), -1)
                        piece[on] = self.piece[after]
                        parts.append((start, row, np.ones_like(row), piece))
                    row, start, cell, state = row[on], start[on], cell[on], after
                    if size > 1:
                        has = np.flatnonzero(self.piece[state] >= 0)
                        parts.append((start[has], row[has], np.full(len(has), size), self.piece[state[has]]))
                    room = np.flatnonzero(start + size < lengths[row])
                    row, start, cell, state = row[room], start[room], cell[room], state[room]
                    if not len(row):
                        break
                start, row, size, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(start, kind="stable")
                row, size, piece = row[order], size[order], piece[order]
                ends = np.cumsum(np.bincount(start - first, minlength=min(span, int(lengths.max()) - first)))
                for k, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                    yield first + k, row[a:b], size[a:b], piece[a:b]

        return lengths, found()


def totals(lattice: Lattice, words: list[str], log_prob: np.ndarray) -> np.ndarray:
    """Log-probabilities (word, language): all segmentations summed; ``log_prob`` has a row per piece, the last for unknown symbols.

    Only the sums that a piece can still reach are held, whatever a word's length.
    """
    lengths, arcs = lattice.arcs(words)
    ring = lattice.longest + 1
    alpha = np.full((ring, len(words), log_prob.shape[1]), -np.inf)
    alpha[0], out = 0.0, np.empty((len(words), log_prob.shape[1]))
    for start, row, size, piece in arcs:
        at, now = (start + size) % ring, alpha[start % ring]
        alpha[at, row] = np.logaddexp(alpha[at, row], now[row] + log_prob[piece])
        now[:] = -np.inf
        done = np.flatnonzero(lengths == start + 1)
        out[done] = alpha[(start + 1) % ring, done]
    return out


def train(lattice: Lattice, n_pieces: int, counts: Counter) -> np.ndarray:
    """Log-probabilities of one language's pieces by expectation maximisation."""
    words = sorted(counts)
    made = []
    for run in lattice.batches(words):
        lengths, arcs = lattice.arcs([words[k] for k in run])
        made.append((lengths, np.array([counts[words[k]] for k in run], dtype=float), list(arcs)))
    logs = np.full(n_pieces + 1, -np.log(max(n_pieces, 1)))
    logs[-1] = np.log(UNKNOWN)
    for _ in range(ROUNDS):
        expected = np.zeros(n_pieces + 1)
        for lengths, weight, arcs in made:
            n, longest = len(lengths), int(lengths.max())
            alpha = np.full((longest + 1, n), -np.inf)
            beta = alpha.copy()
            alpha[0], beta[lengths, np.arange(n)] = 0.0, 0.0
            for start, row, size, piece in arcs:
                alpha[start + size, row] = np.logaddexp(alpha[start + size, row], alpha[start, row] + logs[piece])
            total = alpha[lengths, np.arange(n)]
            for start, row, size, piece in reversed(arcs):
                gain = logs[piece] + beta[start + size, row]
                np.logaddexp.at(beta, (start, row), gain)
                gain = weight[row] * np.exp(alpha[start, row] + gain - total[row])
                expected += np.bincount(np.where(piece < 0, n_pieces, piece), weights=gain, minlength=n_pieces + 1)
        logs[:-1] = np.log((expected[:-1] + SMOOTH) / (expected[:-1].sum() + SMOOTH * n_pieces))
    return logs


@dataclass
class LanguageModel:
    """The vocabulary's pieces, the languages, and the pieces' log-probabilities (pieces + 1, languages)."""

    pieces: list[str]
    languages: list[str]
    log_prob: np.ndarray

    def scorer(self) -> Scorer:
        """The worker's scorer of this model: made once, with the words it remembers."""
        if not hasattr(self, "_scorer"):
            self._scorer = Scorer(self)
        return self._scorer


class Scorer:
    """Scores texts with a model, remembering words."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, self.scores, new = {}, self.scores[:0], list(words)
        found = np.zeros((len(new), self.scores.shape[1]))
        for run in self.lattice.batches(new):
            found[run] = totals(self.lattice, [new[k] for k in run], self.model.log_prob)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, found])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior; ``und`` and 0 without a letter."""
        names, sure = [], []
        for run in batches_of(texts, 2_000_000):
            cut = [words_of(t) for t in run]
            if self.model.languages:
                self.learn({w for words in cut for w in words})
            for words in cut:
                if not self.model.languages or not any(c.isalpha() for w in words for c in w):
                    names.append("und")
                    sure.append(0.0)
                    continue
                total = self.scores[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                best = int(total.argmax())
                names.append(self.model.languages[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
        return names, sure


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text))
        rows = list(counts.items())
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k for (k, _), _ in rows], pa.string()), "word": pa.array([w for (_, w), _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})


def sample(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, Counter]:
    """Word counts of each language over a bounded sample of the texts where ``learn`` holds of the id.

    Languages are counted first. A share of each language's rows, by hash and about three times
    ``SAMPLE_TEXTS``, is ranked, and the first ``SAMPLE_TEXTS`` in hashed order are taken, each as a
    whole. Null texts and languages are left out.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    counts = stored(known.groupBy("lang").agg((3.0 * SAMPLE_TEXTS / F.count("*")).alias("share")), "language-shares")
    side = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    ranks = known.withColumn("h", F.xxhash64("doc_id", "text")).join(side, "lang").where(F.pmod("h", F.lit(1 << 31)) / (1 << 31) < F.col("share"))
    ranked = ranks.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h", "text")))
    words = ranked.where(F.col("r") <= SAMPLE_TEXTS).select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
    found: dict[str, Counter] = {}
    for r in words.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return found


def fit(counts: dict[str, Counter], vocabulary: list[str]) -> LanguageModel:
    """``counts``: the sample's words by language; ``vocabulary``: the pieces of a fixed public vocabulary, of which all are kept."""
    pieces = sorted({p.lower() for p in vocabulary if p} | {MARK})
    languages = sorted(k for k, c in counts.items() if c)
    lattice = Lattice(pieces)
    logs = [train(lattice, len(pieces), counts[k]) for k in languages]
    return LanguageModel(pieces, languages, np.stack(logs, axis=1) if logs else np.zeros((len(pieces) + 1, 0)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every whole text; ``und`` for one that is null or has no letter.

    Of languages with equal scores the first by name is given. Rows that repeat stay as they are, an
    empty table stays empty, and columns not in ``keep`` are not read; ``keep`` must not name the new columns.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("keep names a column that predict adds")
    held = docs.sparkSession.sparkContext.broadcast(model)  # pieces of one vocabulary for each language that has labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        for b in batches:
            names, sure = scorer.predict([x.as_py() or "" for x in b.column("_text")])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*keep, "lang_pred", "score"])

    taken = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(run, f"{fields}, lang_pred string, score double")
