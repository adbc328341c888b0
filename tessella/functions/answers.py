"""Column functions that read what a model answered: fields, verdicts, tags, fences, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and tags in the order tried, and words that claim an execution.
VERDICTS = ("POSSIBLE_XSS", "XSS", "SAFE")
TAGS = {"NOT_ESTABLISHED": "not_established", "NOT ESTABLISHED": "not_established", "INFERRED": "inferred", "OBSERVED": "observed"}
CLAIM = r"(?i)(confirmed xss|confirmed execution|proven exploit|runtime[- ]confirmed|executed in (the )?browser)"
FENCE = "```[A-Za-z]*\\n([^`]*)```"


def field(text: Column, key: str) -> Column:
    """What follows ``key:`` at the beginning of a line, trimmed; empty if there is none. White space before the value may span lines."""
    return F.btrim(F.regexp_extract(text, rf"(?m)^{key}:\s*([^\n]+)$", 1))


def free_answer(text: Column, keys: tuple[str, ...]) -> Column:
    """prediction, confidence, fields_present, complete and claims_execution of an answer in free text.

    ``keys`` should hold Classification and Confidence. A prediction that is neither safe nor vulnerable is invalid;
    a confidence outside 0 to 1 counts as absent. A null text has no fields.
    """
    text = F.coalesce(text, F.lit(""))
    found = {k: field(text, k) for k in keys}
    said = F.regexp_extract(F.lower(found["Classification"]), r"^(safe|vulnerable)(?:\s|$)", 1)
    conf = found["Confidence"].try_cast("double")
    conf = F.when(conf.between(0, 1), conf)
    present = sum((F.when(v != "", 1).otherwise(0) for v in found.values()), F.lit(0))
    return F.struct(
        F.when(said != "", said).otherwise("invalid").alias("prediction"), conf.alias("confidence"), present.cast("int").alias("fields_present"),
        ((present == len(keys)) & conf.isNotNull()).alias("complete"), text.rlike(CLAIM).alias("claims_execution"),
    )


def verdict(text: Column) -> Column:
    """The first of the ordered labels that the text states as its classification or verdict; POSSIBLE_XSS if none."""
    up, out = F.upper(text), F
    for label in VERDICTS:
        out = out.when(F.contains(up, F.lit(f"CLASSIFICATION: {label}")) | F.contains(up, F.lit(f"VERDICT: {label}")), label)
    return out.otherwise("POSSIBLE_XSS")


def evidence_tag(evidence: Column) -> Column:
    """The first tag that an evidence field mentions; null if none."""
    up, out = F.upper(evidence), F
    for said, tag in TAGS.items():
        out = out.when(F.contains(up, F.lit(said)), tag)
    return out


def fenced(text: Column) -> Column:
    """The first fenced block's code; null without one."""
    return F.nullif(F.regexp_extract(text, FENCE, 1), F.lit(""))


def has_exact_keys(raw: Column, keys: tuple[str, ...]) -> Column:
    """Whether a text is a JSON object with these keys and no other; a repeated key is refused."""
    held = F.array_sort(F.json_object_keys(raw))
    return F.coalesce(F.try_parse_json(raw).isNotNull() & (held == F.array(*map(F.lit, sorted(keys)))), F.lit(False))
