"""Identities of a record: content hashes and composite ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(text: Column) -> Column:
    """SHA-256 of the text as it is."""
    return F.sha2(text, 256)


def stripped(text: Column) -> Column:
    """SHA-256 of the text without white space at its ends."""
    return F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256)


def squeezed(text: Column) -> Column:
    """SHA-256 of the text without any white space."""
    return F.sha2(F.regexp_replace(text, r"\s+", ""), 256)


def composite(*parts: Column, length: int = 20) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, length)


def number(key: Column, digits: int = 8, hashed: bool = False) -> Column:
    """The first hex digits of a SHA-256 (of ``key``, or ``key`` itself) as a number: the same in every engine."""
    return F.conv(F.substring(key if hashed else F.sha2(key, 256), 1, digits), 16, 10).cast("long")


def stream(master: int | str, component: str, key: Column) -> Column:
    """A key's hash in a named stream: streams of different components are independent."""
    return F.sha2(F.concat(F.lit(f"{master}:{component}:"), key.cast("string")), 256)
