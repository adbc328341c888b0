"""Fill-in-middle rewriting: texts cut at allowed places and put in another order.

The places where a text may be cut (before any code point, word or line, and at its end) are byte
offsets of its UTF-8 form, held as a compressed set: the offsets are split by their high 16 bits into
containers, and each container is an array, a bitmap or a list of runs, whichever is smallest. The
containers' cumulative cardinalities find the one that holds the k-th place, a select inside it
gives the offset, so both cuts of a text cost two searches and no list of all its characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offsets of one container, and the bytes of a bitmap container.
SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8
UNITS = ("char", "word", "line")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass
class ArrayContainer:
    """Few places: their low 16 bits, ascending."""

    low: np.ndarray

    def select(self, k: int) -> int:
        return int(self.low[k])

    def rank(self, low: int) -> int:
        return int(np.searchsorted(self.low, low))


@dataclass
class BitmapContainer:
    """Many scattered places: a bit for each, and the places before each of its 1,024 words."""

    words: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word, k = int(self.words[at]), k - int(self.before[at])
        for _ in range(k):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1

    def rank(self, low: int) -> int:
        at, bit = divmod(low, 64)
        return int(self.before[at]) + (int(self.words[at]) & ((1 << bit) - 1)).bit_count()


@dataclass
class RunContainer:
    """Places in a row: each run's first one, and the places before each run."""

    starts: np.ndarray
    before: np.ndarray
    size: int

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])

    def rank(self, low: int) -> int:
        at = int(np.searchsorted(self.starts, low, side="right")) - 1
        if at < 0:
            return 0
        end = int(self.before[at + 1]) if at + 1 < len(self.before) else self.size
        return min(int(self.before[at]) + low - int(self.starts[at]), end)


def container(marks: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of the places that ``marks`` (at most ``SPAN`` booleans) is true at."""
    edges = np.flatnonzero(np.diff(marks, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    size = int((ends - starts).sum())
    by_runs, by_places = 4 * len(starts), 2 * size
    if by_runs <= min(by_places, BITMAP_BYTES):
        return RunContainer(starts, np.cumsum(ends - starts) - (ends - starts), size)
    if by_places <= BITMAP_BYTES:
        return ArrayContainer(np.flatnonzero(marks).astype(np.uint16))
    bits = np.zeros(BITMAP_BYTES, dtype=np.uint8)
    packed = np.packbits(marks, bitorder="little")
    bits[: len(packed)] = packed
    words = bits.view("<u8")
    counts = np.bitwise_count(words).astype(np.int64)
    return BitmapContainer(words, np.cumsum(counts) - counts)


def _marks(chunk: np.ndarray, last: int, unit: str) -> np.ndarray:
    """Where a unit begins in ``chunk``; ``last`` is the byte before it, a line feed before the first."""
    if unit == "char":
        return (chunk & 0xC0) != 0x80
    earlier = np.concatenate([np.array([last], dtype=np.uint8), chunk])[: len(chunk)]
    if unit == "line":
        return earlier == 10
    white = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    return ~white(chunk) & white(earlier)


class BoundarySet:
    """The places where ``text`` (UTF-8) may be cut: before each unit, and at its end.

    Words are runs without ASCII white space, lines end with a line feed; a word's white space
    belongs to the unit before it, and what precedes the first word to a unit of its own.
    """

    def __init__(self, text: bytes | np.ndarray, unit: str = "char"):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}: {unit}")
        data, self.keys, self.containers, counts = np.frombuffer(text, dtype=np.uint8), [], [], []
        for key in range(len(data) // SPAN + 1):
            chunk = data[key * SPAN : (key + 1) * SPAN]
            marks = _marks(chunk, int(data[key * SPAN - 1]) if key else 10, unit)
            if not key and len(marks):
                marks[0] = True
            if len(chunk) < SPAN:
                marks = np.append(marks, True)  # the end
            if marks.any():
                self.keys.append(key)
                self.containers.append(container(marks))
                counts.append(int(marks.sum()))
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The byte offset of place ``k``, counted from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.keys[at] * SPAN + self.containers[at].select(k - int(self.before[at]))

    def rank(self, offset: int) -> int:
        """The number of places before byte ``offset``."""
        key, low = divmod(offset, SPAN)
        at = int(np.searchsorted(self.keys, key))
        if at == len(self.keys) or self.keys[at] != key:
            return int(self.before[at])
        return int(self.before[at]) + self.containers[at].rank(low)


def transform(text: bytes, digest: str, unit: str = "char", plain_percent: int = 10, spm_percent: int = 20) -> tuple:
    """(units, form, prefix's and middle's units, prefix's and middle's bytes, output) of one text; ``digest`` (hex) decides.

    Its first four groups of eight digits choose two cuts and the form: ``plain`` (the text as it
    is), ``psm`` or ``spm`` (prefix, suffix and middle in that order, each after its mark). An
    empty text and one that holds a mark stay plain, so every output can be undone.
    """
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    places = BoundarySet(text, unit)
    n = len(places) - 1
    if not text or h[2] % 100 >= 100 - plain_percent or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, None, text
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = places.select(one), places.select(two)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < spm_percent
    parts = [SUFFIX.encode(), suffix, PREFIX.encode(), prefix] if spm else [PREFIX.encode(), prefix, SUFFIX.encode(), suffix]
    return n, "spm" if spm else "psm", one, two - one, a, b - a, b"".join([*parts, MIDDLE.encode(), middle])


def _rewritten(unit: str, plain_percent: int, spm_percent: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").cast(pa.binary()).to_pylist()  # bytes: nothing is decoded
            made = [transform(t or b"", d, unit, plain_percent, spm_percent) for t, d in zip(texts, b.column("_digest").to_pylist(), strict=True)]
            n, forms, *cuts, output = zip(*made, strict=True) if made else [()] * 7
            longs = [pa.array(x, pa.int64()) for x in cuts]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *longs, pa.array(output, pa.binary()).cast(pa.string(), safe=False)], names=names)

    return run


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, keep: Sequence[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, n, form, prefix_units, middle_units, prefix_bytes, middle_bytes, output): each row's columns ``keep`` (all, if None) as they came, its ``text`` rewritten.

    The choices of a row follow from the SHA-256 of ``seed``, a colon and its id, so a task that
    runs again gives the same rows, and repeated rows change alike. A null id counts as no digits, a
    null text as empty; an empty table gives no rows, and columns of any name stay in ``row``. One pass
    without a shuffle; memory is a batch and the containers of one text, however long.
    ``unit`` names where texts may be cut (char, word or line); ``n`` counts such units. The cuts of a plain row are null.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}: {unit}")
    if not (0 <= plain_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("percentages lie between 0 and 100")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"), F.col(f"`{text}`").cast("string").alias("_text"), digest.alias("_digest"))
    schema = T.StructType([own.schema["row"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType())])
    for name in ("prefix_units", "middle_units", "prefix_bytes", "middle_bytes"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("output", T.StringType())
    return own.mapInArrow(_rewritten(unit, plain_percent, spm_percent, schema.names), schema)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from, from it and its form alone: no part holds a mark, so each mark occurs once."""

    def undone(first: str, second: str, turned: bool) -> Column:
        rest = F.substring_index(output, second, -1)
        one = F.substring(F.substring_index(output, second, 1), len(first) + 1, 2**31 - 1)
        two, middle = F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
        return F.concat(two, middle, one) if turned else F.concat(one, middle, two)

    return F.when(form == "plain", output).when(form == "psm", undone(PREFIX, SUFFIX, False)).when(form == "spm", undone(SUFFIX, PREFIX, True))


#: DuckDB SQL of the query: the same cuts by character functions on whole strings.
ORACLE = """
with h as (
    select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents
), k as (
    select doc_id, text, n, ('0x' || d[1:8])::bigint % (n + 1) as one, ('0x' || d[9:16])::bigint % (n + 1) as two,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || d[17:24])::bigint % 100 >= 90 then 'plain'
            when ('0x' || d[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
    from h
), c as (
    select doc_id, text, n, form, least(one, two) as a, greatest(one, two) as b from k
), p as (
    select *, substring(text, 1, a) as prefix, substring(text, a + 1, b - a) as middle, substring(text, b + 1) as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from p
"""
