"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def single_edits(name: Column, letter: str = "x") -> Column:
    """All strings one edit away: array of (kind, pos, edited), edits with ``letter``."""
    n = F.length(name)
    head = lambda i: F.substring(name, F.lit(1), i - 1)
    tail = lambda i: F.substring(name, i, F.greatest(n - i + 1, F.lit(0)))

    def made(kind: str, last: Column, build) -> Column:
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), build(i).alias("edited")))

    swaps = made("transposition", n - 1, lambda i: F.concat(head(i), F.substring(name, i + 1, F.lit(1)), F.substring(name, i, F.lit(1)), tail(i + 2)))
    return F.concat(
        made("deletion", n, lambda i: F.concat(head(i), tail(i + 1))),
        made("substitution", n, lambda i: F.concat(head(i), F.lit(letter), tail(i + 1))),
        made("insertion", n, lambda i: F.concat(head(i), F.lit(letter), tail(i))),
        F.when(n > 1, swaps).otherwise(F.slice(swaps, 1, 0)),
    )
