"""Column functions on records: choices among scores, keys, gates, affixes, contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_first(scores: dict[str, Column]) -> Column:
    """The name with the highest score; of equals the one named first."""
    ranked = F.array(*[F.struct(c.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, c) in enumerate(scores.items())])
    return F.array_max(ranked)["k"]


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def first_of(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def last_of(items: Column, test) -> Column:
    kept = F.filter(items, test)
    return F.when(F.size(kept) > 0, F.element_at(kept, -1))


def first_filled(*parts: Column, default: str = "unknown") -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(default))


def routed(verdict: Column, confidence: Column, direct: float = 0.90, confirm: float = 0.85) -> Column:
    """Where a fast verdict goes: accepted, to confirmation, or to the slow path."""
    return F.when((verdict == "SAFE") & (confidence >= direct), "encoder").when((verdict == "XSS") & (confidence >= confirm), "browser_required").otherwise("escalate")


def abstaining(p: Column, against: Column, threshold: float, margin: float) -> Column:
    return F.when((p < threshold) | (p - against < margin), "POSSIBLE_XSS").otherwise("XSS")


def shared_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings share at their beginning."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: (i <= F.least(F.length(a), F.length(b))) & (F.left(a, i) == F.left(b, i))))


def shared_suffix(a: Column, b: Column) -> Column:
    return shared_prefix(F.reverse(a), F.reverse(b))


def reflection_context(html: Column, needle: str, back: int = 80) -> Column:
    """Where the first mention of ``needle`` stands, by the characters before it; dom_html if it is absent."""
    at = F.instr(html, needle)
    before = F.substring(html, F.greatest(at - back, F.lit(1)), at - F.greatest(at - back, F.lit(1)))
    last = lambda x: F.when(F.instr(before, x) == 0, 0).otherwise(F.length(before) - F.instr(F.reverse(before), x[::-1]) - len(x) + 2)
    tag = F.substring(before, last("<"), F.length(before))
    return (
        F.when(at == 0, "dom_html").when(last("<script") > last("</script>"), "js_string")
        .when((last("<") > last(">")) & tag.rlike("=\\s*(\"[^\"]*|'[^']*)$"), "html_attr").when(last("<") > last(">"), "html_attr_unquoted")
        .when(last("<!--") > last("-->"), "html_comment").otherwise("html_text")
    )


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def tokens(c: Column) -> Column:
    """The number of runs without white space."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def risk(source: Column, sink: Column, defended: Column, flow: Column) -> Column:
    """Advisory risk: source and sink weights, lowered by a defense, scaled by the flow."""
    return F.round(source * sink * (1 - defended) * flow, 6)
