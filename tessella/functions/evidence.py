"""Evidence for each output operation: what reaches it, what protects it, and what follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what an output's context is, which sanitizers fit which context, and what each is called
SINK_KINDS = {"html": "HTML_PARSER", "javascript": "SCRIPT_EXECUTION", "url": "POTENTIAL_SCRIPT_URL", "remote_script": "REMOTE_SCRIPT_URL", "text": "TEXT_ONLY"}
COMPATIBLE = {"html": ("dompurify:default-html", "encodeURIComponent:html-markup"), "url": ("fixed-relative-url", "fixed-navigation-url")}
PROTECTIONS = {
    "encodeURIComponent:html-markup": ("CONTEXTUAL_HTML_ENCODING", "ENCODED_HTML_MARKUP"), "dompurify:default-html": ("VERIFIED_CONTEXTUAL_SANITIZATION", "SANITIZED_HTML"),
    "fixed-relative-url": ("VERIFIED_RELATIVE_URL_PREFIX", "SAFE_RELATIVE_URL"), "fixed-navigation-url": ("VERIFIED_NAVIGATION_URL_PREFIX", "SAFE_NAVIGATION_URL"),
}


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def compatible(context: Column, sanitizer: Column) -> Column:
    """Whether a sanitizer's identity means anything in this context."""
    found = F.lit(False)
    for name, fit in COMPATIBLE.items():
        found = found | ((context == name) & sanitizer.isin(*fit))
    return F.coalesce(found, F.lit(False))


def sink_verdict(context: Column, sources: Column, sanitizer: Column, unknown: Column) -> Column:
    """INCONCLUSIVE for an unknown value, SAFE for text, CANDIDATE for a source without a fitting sanitizer."""
    reached = (F.size(sources) > 0) & ~compatible(context, sanitizer)
    return F.when(F.coalesce(unknown, F.lit(True)), "INCONCLUSIVE").when(context.eqNullSafe(F.lit("text")) | ~reached, "SAFE").otherwise("CANDIDATE")


def sink_evidence(context: Column, sources: Column, sanitizer: Column, unknown: Column) -> Column:
    """verdict, kind, relation, source, protection, rule and status of an output; null sources are none."""
    have = F.coalesce(F.size(F.array_distinct(sources)) > 0, F.lit(False))
    verdict = sink_verdict(context, F.coalesce(sources, F.array().cast("array<string>")), sanitizer, unknown)
    kind = F.coalesce(looked_up(SINK_KINDS, context), F.lit("UNKNOWN"))
    relation = F.when(verdict == "INCONCLUSIVE", "UNKNOWN").when(have, "CONNECTED").otherwise("DISCONNECTED")
    text, fits = kind == "TEXT_ONLY", compatible(context, sanitizer)
    named = [looked_up({k: v[i] for k, v in PROTECTIONS.items()}, sanitizer) for i in (0, 1)]
    bare = (relation == "CONNECTED") & ~kind.isin("TEXT_ONLY", "UNKNOWN")
    protection = (
        F.when(text, "SAFE_OUTPUT_API").when(fits, named[0]).when(bare, "NONE").when(relation == "UNKNOWN", "UNKNOWN").otherwise("NOT_REQUIRED_FOR_THIS_FLOW")
    )
    rule = F.when(text, "SAFE_TEXT_OUTPUT").when(fits, named[1]).when(bare, "UNPROTECTED_CONNECTED_SINK").when(relation == "DISCONNECTED", "DISCONNECTED").otherwise("UNRESOLVED")
    status = F.when(rule == "UNPROTECTED_CONNECTED_SINK", "CANDIDATE").when(relation == "UNKNOWN", "INCONCLUSIVE").otherwise("BOUNDED_SAFE")
    source = F.when(have, "OBSERVED").when(relation == "UNKNOWN", "UNKNOWN").otherwise("NONE_ON_THIS_PATH")
    return F.struct(verdict.alias("verdict"), kind.alias("kind"), relation.alias("relation"), source.alias("source"), protection.alias("protection"), rule.alias("rule"), status.alias("status"))


def role_text(source: Column, sink: Column, excerpt: Column) -> Column:
    """The excerpt with both expressions replaced by their roles, the longer one first, the source first of two as long; null if one is blank."""
    first = F.length(source) >= F.length(sink)
    one = lambda t, what, role: F.replace(t, what, F.lit(role))
    ordered = F.when(first, one(one(excerpt, source, "__SOURCE__"), sink, "__SINK__")).otherwise(one(one(excerpt, sink, "__SINK__"), source, "__SOURCE__"))
    whole = F.concat(F.lit("[SOURCE]\n__SOURCE__\n[SINK]\n__SINK__\n[FLOW]\n"), ordered)
    said = lambda t: F.btrim(t, F.lit(" \t\r\n\f\v")) != ""
    return F.when(said(source) & said(sink) & said(excerpt), whole)
