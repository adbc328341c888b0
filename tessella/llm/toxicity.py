"""Toxicity by compression distance: two zstandard dictionaries, two lengths for each window.

A bounded sample of labelled documents trains the dictionaries. The ordinary one is trained on all windows
of the sample's ordinary texts. The toxic one is trained on the toxic texts, each cut down to what tells it from ordinary
text, and is followed by the ordinary one, so that the two differ only in what is toxic: trained
on whole toxic texts, nearly all of a dictionary is ordinary text, and what it happens to hold of that drowns the rest.
A window, a few words long, is compressed with either; the bytes that the toxic dictionary saves over the
ordinary one are its distance. Thresholds are calibrated on documents that the dictionaries used for
them have not seen: a logistic model of how many windows of a document save at least so many bytes, and
of how many windows there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents of either class that the model is fitted on; each is read whole.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000
#: Texts of the sample are copies, and stay in one half of it, if earlier ones hold this share of a text's shingles of so many words.
COPY_SHARE, COPY_WORDS = 0.5, 5
#: Words of a window.
WINDOW_WORDS = 8
#: Bytes saved at which a window counts, one feature for each.
SAVED = (1, 2, 3, 4, 6, 8)
#: Bytes of the ordinary dictionary and of what the toxic one has before it.
BASE_BYTES, OWN_BYTES, LEVEL = 65536, 16384, 3
#: Shorter matches than six bytes, with the space before a word, are chance; 4 is zstandard's lazy strategy.
MIN_MATCH, STRATEGY = 6, 4
#: Every window begins with this, and both dictionaries end with it, so that no window is without a match:
#: what a first match costs would else hide a short one.
MARK = "<|window|>"
THRESHOLD = 0.7


def windows_of(text: str) -> list[bytes]:
    """The text lower-cased, in runs of ``WINDOW_WORDS`` words; every word lies in one."""
    words = text.lower().split()
    return [f"{MARK} {' '.join(words[i : i + WINDOW_WORDS])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW_WORDS)]


@dataclass
class ToxicityModel:
    """What a fit leaves: two dictionaries and the weights of the logistic model."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]

    def compressors(self):
        import zstandard as z

        made = []
        for content in (self.ordinary + MARK.encode(), self.toxic + MARK.encode()):
            own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, strategy=STRATEGY, write_content_size=False, write_checksum=False, write_dict_id=False)
            own.precompute_compress(compression_params=how)
            made.append(z.ZstdCompressor(dict_data=own, compression_params=how).compress)
        return made

    def features(self, text: str, compressors) -> np.ndarray:
        ordinary, toxic = compressors
        pieces = windows_of(text)
        saved = np.fromiter((len(ordinary(x)) - len(toxic(x)) for x in pieces), dtype=np.int64, count=len(pieces))
        return np.array([1.0, *(np.log1p((saved >= s).sum()) for s in SAVED), np.log1p(len(pieces))])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's content; samples too few to train on serve as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()")


def _words(text: str) -> list[str]:
    return [_bare(w) for w in text.lower().split()]


def _keys(word: str) -> list[str]:
    """What may tell a word: itself and its beginnings."""
    return [word + " ", *(word[:k] for k in (4, 5, 6) if len(word) > k)]


def _new_words(texts: list[str]) -> list[list[str]]:
    """Each text's words that lie in no shingle of an earlier text: a copy has those that were changed, a header counts once."""
    seen: set[int] = set()
    found = []
    for text in texts:
        words = text.lower().split()
        hashes = [crc32(" ".join(words[i : i + COPY_WORDS]).encode("utf-8", "replace")) for i in range(max(1, len(words) - COPY_WORDS + 1))] if words else []
        old = np.zeros(len(words) + 1, dtype=np.int64)
        for i, h in enumerate(hashes):
            if h in seen:
                old[i] += 1
                old[min(i + COPY_WORDS, len(words))] -= 1
        seen.update(hashes)
        found.append([w for w, k in zip(words, np.cumsum(old).tolist(), strict=False) if not k])
    return found


def _telling(own: list[list[str]], other: list[list[str]]) -> set[str]:
    """Words and word beginnings that far more texts of ``own`` have, by the likelihood ratio; texts as their new words.

    The bound rises with how many are tried, so that chance passes for about one of them.
    """

    def counted(texts: list[list[str]]) -> Counter:
        found: Counter = Counter()
        for t in texts:
            found.update({k for w in set(map(_bare, t)) if w for k in _keys(w)})
        return found

    own, other = [t for t in own if t], [t for t in other if t]
    mine, others = counted(own), counted(other)
    n, m = len(own), max(len(other), 1)

    def ratio(key: str) -> float:
        a, b = mine[key], others[key]
        if a / n <= b / m:
            return 0.0
        p = (a + b) / (n + m)
        part = lambda k, of, q: k * np.log(max(q, 1e-12)) + (of - k) * np.log(max(1 - q, 1e-12))
        return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))

    least = 2 * np.log(max(len(mine), 2)) + 2
    return {k for k, c in mine.items() if c >= 3 and ratio(k) > least}


def _told(text: str, telling: set[str]) -> bytes:
    """A text cut down to what tells: of each word the longest beginning that does, or the word itself."""
    found = []
    for w in _words(text):
        if w and (keys := [k for k in _keys(w) if k in telling]):
            found.append(max(keys, key=len).strip())
    return f" {' '.join(found)} ".encode("utf-8", "replace") if found else b""


def _copy_groups(texts: list[str]) -> list[int]:
    """A group for each text: one that holds half of its shingles with earlier texts is in a group with all that share them.

    Of a text's shingles those with a hash divisible by 4 are compared, or all of few. Texts of one header may
    fall into one group: groups only deal the sample into halves and drop nothing.
    """
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    holder: dict[int, int] = {}
    for i, text in enumerate(texts):
        words = text.lower().split()
        own = {crc32(" ".join(words[k : k + COPY_WORDS]).encode("utf-8", "replace")) for k in range(max(1, len(words) - COPY_WORDS + 1))}
        own = {h for h in own if h % 4 == 0} if len(own) >= 64 else own
        met = Counter(top(holder[h]) for h in own if h in holder)
        if sum(met.values()) >= COPY_SHARE * len(own) > 0:
            for other in met:
                root[top(other)] = i
        for h in own:
            holder.setdefault(h, i)
    return [top(i) for i in range(len(texts))]


def _halves(rows: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
    """The rows in two halves, copies on one side, for what one half's dictionaries have seen of the other would pass for what tells.

    Groups go, the largest first, to the half with fewer rows of their labels. Where a half would lack a label, as when
    all texts share one header, rows are dealt one by one.
    """
    groups: dict[int, list[tuple[str, int]]] = {}
    for row, group in zip(rows, _copy_groups([t for t, _ in rows]), strict=True):
        groups.setdefault(group, []).append(row)
    halves, counts = ([], []), [Counter(), Counter()]
    for group in sorted(groups.values(), key=len, reverse=True):
        own = Counter(y for _, y in group)
        to = min((0, 1), key=lambda k: sum(counts[k][y] * n for y, n in own.items()))
        halves[to].extend(group)
        counts[to] += own
    if all(set(c) == {0, 1} for c in counts):
        return list(halves)
    by_label = [[r for r in rows if r[1] == k] for k in (0, 1)]
    return [by_label[0][k::2] + by_label[1][k::2] for k in (0, 1)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _dictionaries(rows: list[tuple[str, int]]) -> ToxicityModel:
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    base = _dictionary(list(dict.fromkeys(w for t in ordinary for w in windows_of(t))), BASE_BYTES)[-BASE_BYTES:]
    telling = _telling(_new_words(toxic), _new_words(ordinary))
    own = _dictionary([x for t in toxic if (x := _told(t, telling))] or [b" "], OWN_BYTES)
    return ToxicityModel(base, own + base, [])


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """``rows``: (text, label) of the bounded sample.

    Rows alike in text and label count once, all others count; what tells is sought in what is new in a near copy, so
    that what only a document's many copies hold does not pass for it. Each half's features,
    from the other half's dictionaries, calibrate the thresholds; the dictionaries kept come from all
    rows. Without both labels in either half the score is the share of label 1.
    """
    rows = list(dict.fromkeys(rows))
    halves = _halves(rows)
    if any({y for _, y in half} != {0, 1} for half in halves):
        share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
        return ToxicityModel(b"", b"", [float(np.log(share / (1 - share)))] + [0.0] * (len(SAVED) + 1))
    x = []
    for train, check in (halves, halves[::-1]):
        part = _dictionaries(train)
        pack = part.compressors()
        x += [part.features(t, pack) for t, _ in check]
    y = np.array([y for _, y in halves[1] + halves[0]], dtype=float)
    model = _dictionaries(rows)
    model.weights = _logistic(np.array(x), y).tolist()
    return model


def sample(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[str, int]]:
    """The bounded sample: labelled documents where ``learn`` holds of the id, in a hashed order.

    Ids with both labels, null labels and null texts are left out.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = [known.where(F.col("label") == k).orderBy(*order).limit(n).select("doc_id", "label") for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    chosen = F.broadcast(taken[0].unionByName(taken[1]))  # at most the two bounds
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(chosen, "doc_id").where("text is not null")
    rows = found.orderBy(*order, F.xxhash64("text")).limit(SAMPLE_TOXIC + SAMPLE_ORDINARY).collect()
    return [(r["text"], r["label"]) for r in rows]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of every whole text; a null text scores as an empty one.

    Rows that repeat stay as they are, an empty table stays empty, and columns not in ``keep`` are
    not read; ``keep`` must not name ``score``.
    """
    if "score" in keep:
        raise ValueError("keep names the column that score adds")
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        pack = own.compressors()
        for b in (b for b in batches if b.num_rows):
            x = np.array([own.features(t.as_py() or "", pack) for t in b.column("_text")])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own.score(x))], names=[*keep, "score"])

    taken = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(run, f"{fields}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows whose ``text`` scores ``THRESHOLD`` or more; null and empty texts score alike.

    Rows that repeat stay or go together, and columns of any name stay as they are, ``score`` and ``row`` included.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return score(rows, model, keep=("row",)).where(F.col("score") < THRESHOLD).select("row.*")
