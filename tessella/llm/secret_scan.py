"""Secrets in texts: assignments, access keys, hex strings, and strings that a tokenizer finds random.

A tokenizer's vocabulary holds what people write often, so words take few tokens, while random
strings fall apart: a string with few characters per token is unlikely to be language. Digests and
identifiers of known forms, which look as random but are no secrets, are taken out before the test.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of spans in the order that ties in their start follow.
KINDS = ("assign", "access", "hex", "random")
#: Fixed values of the base kinds; the keywords' letters count in either case, ASCII only.
KEYWORDS = "password passwd secret token api_?key".split()
ASSIGN = re.compile("(" + "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", k) for k in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")  # of whole runs: greedy, so the length can stand in the pattern
ASSIGN_CHARS = 12

#: What may be a random string: a run of these characters, with padding at its end.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST_CHARS = 16
#: At most so many characters per token count as random. Words of 16 letters and more have two and
#: over, random letters and digits in either case 1.3 on average and 1.7 at their hundredth.
MOST_PER_TOKEN = 1.8
#: A longer candidate is tokenised in blocks of so many characters, since a merge of one piece costs more than its length.
BLOCK = 1000

#: Known forms that are no secrets: UUIDs, integrity digests, hex of a digest's length.
KNOWN = re.compile(
    r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)"
    r"|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})(?![0-9A-Za-z])"
)
#: Names and paths: words in one case, capitalised or short numbers, joined by separators.
NAME = re.compile(r"[/_+-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/_+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+[/_+-]*")
#: What lies between slashes, and such parts as only paths have.
PART, WORD = re.compile("[^/]+"), re.compile("[A-Z]?[a-z]{2,}|[A-Z]{3,}")
NUMBER = re.compile(r"[0-9+/_-]+=*")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base kinds: leftmost matches of each, those too short left out."""
    found = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


class TokenEfficiency:
    """Characters per token under a public vocabulary of ranks (``ranks_file``: its file's content)."""

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, string: str) -> float:
        blocks = [string[i : i + BLOCK] for i in range(0, len(string), BLOCK)]
        return len(string) / sum(len(self.encoding.encode_ordinary(b)) for b in blocks)


def pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What is left of a candidate without known forms, if long enough, no name and no number."""
    at, cuts = start, [m.span() for m in KNOWN.finditer(text, start, end)]
    for a, b in [*cuts, (end, end)]:
        if a - at >= LEAST_CHARS and not NAME.fullmatch(text, at, a) and not NUMBER.fullmatch(text, at, a):
            yield at, a
        at = b


def random_spans(text: str, base: Sequence[Span], efficiency: TokenEfficiency, most: float = MOST_PER_TOKEN, allowed: frozenset[str] = frozenset()) -> list[Span]:
    """Spans of random strings that touch no base span.

    A string counts as a whole, but a path (a word stands between its slashes) by its parts: it may hold a token.
    """
    covered, ends = sorted((a, b) for _, a, b in base), []
    for _, b in covered:
        ends.append(max(b, ends[-1] if ends else 0))
    starts = [a for a, _ in covered]

    def touches(a: int, b: int) -> bool:
        at = bisect_right(starts, b - 1)
        return at > 0 and ends[at - 1] > a

    def exposed(a: int, b: int) -> bool:
        return not touches(a, b) and text[a:b] not in allowed and efficiency(text[a:b]) <= most

    found = []
    for m in CANDIDATE.finditer(text):
        for a, b in pieces(text, *m.span()):
            parts = [m.span() for m in PART.finditer(text, a, b)]
            if len(parts) > 1 and any(WORD.fullmatch(text, *p) for p in parts):
                found += [("random", *p) for part in parts for p in pieces(text, *part) if exposed(*p)]
            elif exposed(a, b):
                found.append(("random", a, b))
    return found


def spans_of(text: str, efficiency: TokenEfficiency, most: float = MOST_PER_TOKEN, allowed: frozenset[str] = frozenset()) -> list[Span]:
    """All spans of a text by start, then by kind as ``KINDS`` lists them."""
    base = base_spans(text)
    return sorted(base + random_spans(text, base, efficiency, most, allowed), key=lambda s: (s[1], KINDS.index(s[0])))


_EFFICIENCY: dict[int, TokenEfficiency] = {}

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, ranks_file: str, pattern: str, most: float = MOST_PER_TOKEN, allowed: Iterable[str] = (), keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Rows (row, spans): each row's columns ``keep`` (all, if None) as they came, and what looks secret in ``text``.

    Spans are (kind, start, end), in code points, end exclusive, by start and then kind. A null or
    empty text has none; rows that repeat are scanned each for itself; an empty table gives no rows; columns of
    any name stay inside ``row``. Strings in ``allowed`` are never taken for random. Texts are read whole, however long:
    one pass without a shuffle, its memory one batch and the vocabulary (``ranks_file``, one public file, so of fixed size).
    """
    code, known = docs.sparkSession.sparkContext.broadcast((ranks_file, pattern)), frozenset(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(code.value)
        if key not in _EFFICIENCY:
            _EFFICIENCY[key] = TokenEfficiency(*code.value)
        for b in batches:
            spans = [spans_of(t or "", _EFFICIENCY[key], most, known) for t in b.column("_text").to_pylist()]
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(rows, kind)], names=["row", "spans"])

    columns = docs.columns if keep is None else keep
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("_text"))
    return own.mapInArrow(run, T.StructType([own.schema["row"], T.StructField("spans", SPANS)]))


def written(spans: F.Column) -> F.Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str) -> Callable[[F.Column], F.Column]:
    """The test of a span for ``kind``, for ``F.filter``."""
    return lambda s: s["kind"] == kind
