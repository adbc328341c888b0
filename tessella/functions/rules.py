"""Rule-based classifiers and detectors as column expressions.

The patterns and word lists are fixed values: results follow from them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a secret or personal data.
SECRETS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "api_token": r"\b(?:sk|pk|ghp|xox[baprs])[-_][A-Za-z0-9]{16,}\b",
    "private_key": r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "password": r"(?i)password\s*[:=]\s*\S+",
}
# Further shapes of our own, reported apart.
EXTRA_SECRETS = {
    "hex_token": r"token\s*=\s*\"[0-9a-f]{40}\"",
    "card": r"\b4[0-9]{15}\b",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}
# Phrases that try to steer a reader.
INJECTIONS = (
    r"(?i)mark (?:this|it) (?:as )?verified",
    r"(?i)ignore (?:previous|prior|the) (?:instructions|verification)",
    r"(?i)add (?:this )?to (?:the )?training",
    r"(?i)\bsystem prompt\b",
)
# References that are trusted.
TRUSTED = ("https://cheatsheetseries.owasp.org", "https://cwe.mitre.org", "https://developer.mozilla.org", "cheatsheetseries.owasp.org", "cwe.mitre.org")

# Code triage.
TAINTED = r"(?i)(location\.(?:search|hash|href)|document\.(?:URL|documentURI|cookie|referrer)|window\.name|req\.(?:body|query|params)|URLSearchParams|formData|\.value\b)"
HTML_SINK = r"\b(innerHTML|outerHTML|insertAdjacentHTML|document\.write|document\.writeln)\b"
JS_SINK = r"\b(eval|Function)\s*\("
EVENT_SINK = r"(?i)setAttribute\s*\(\s*['\"]on[a-z]+['\"]\s*,"
URL_LITERAL = r"(?i)setAttribute\s*\(\s*['\"](?:src|href|action|data)['\"]\s*,\s*['\"]\s*(?:javascript:|data:text/html)"
SAFE_TEXT = r"(?i)^\s*\w+\.textContent\s*=\s*[^;\n]+;?\s*$"
SAFE_NAME = r"(?i)^\s*\w+\.setAttribute\s*\(\s*['\"](?:class|id|aria-[a-z-]+)['\"]\s*,\s*['\"][^'\"]*['\"]\s*\)\s*;?\s*$"
SAFE_URL = r"(?i)^\s*\w+\.setAttribute\s*\(\s*['\"](?:src|href|action|data)['\"]\s*,\s*['\"](?!\s*(?:javascript:|data:text/html))[^'\"]*['\"]\s*\)\s*;?\s*$"

# The taxonomy of sources, sinks and defenses, in the order tried.
SOURCES = {
    "BROWSER": ("location.hash", "location.search", "window.location.hash", "window.location.search", "document.referrer", "document.url", "document.documenturi", "document.cookie", "window.name", "localstorage", "sessionstorage", "event.data", "evt.data", "message.data"),
    "SERVER": ("req.query", "req.body", "req.params", "request.query", "request.body", "request.params", "$_get", "$_post"),
    "FRAMEWORK": ("props.", "route.params", "router.query", "parammap", "ctx.params", "pageprops", "params.", "_ctx."),
}
LITERAL = r"^(?:['\"].*['\"]|\d+(?:\.\d+)?|true|false|null|undefined)$"
STATIC = ("static_", "default_", "config.", "settings.")
SINKS = {
    "DANGEROUS_HTML": ("innerhtml", "outerhtml", "document.write", "document.writeln", "insertadjacenthtml", ".html(", "dangerouslysetinnerhtml", "res.send(", "v-html=", "x-html", "unsafehtml("),
    "DANGEROUS_JS": ("eval(", "function(", "new function(", "settimeout(", "setinterval("),
    "DANGEROUS_URL": (".href =", ".src =", ".action =", ".formaction =", "object.data =", "res.redirect("),
    "SAFE_OUTPUT": ("textcontent", "innertext", "insertadjacenttext", ".text(", "createtextnode", "nodevalue", "v-text=", "x-text"),
}
NO_SINK = ("return ", "json.parse(", "json.stringify(", "const ", "let ", "items.push(", "store.push(", "cache.set(")
NO_DEFENSE = ("[no_defense]", "[no_protection]", "direct_to_sink", "direct_use", "unsanitized", "no_transform", "raw_value")
DEFENSES = {
    "SANITIZATION": ("dompurify.sanitize", "sanitizehtml(", "purifier.sanitize", "htmlsanitizer.clean", "xssfilter.process", "sanitize("),
    "CONTEXTUAL_ENCODING": ("escapehtml", "htmlspecialchars", "encodeforhtml", "escapeattribute", "htmlencode", "encodeforattribute", "encodeuri(", "encodeuricomponent(", "escapeexpression("),
    "SAFE_DOM_API": ("textcontent", "innertext", "insertadjacenttext", ".text(", "createtextnode"),
    "INPUT_CONSTRAINT": ("allowedprotocol", "valid_schemes", "validator.isurl", "startswith('https://')", "protocol ===", "includes(new url", "match(/^https"),
}
ESCAPING = ("{{", "v-text=", "x-text", "safeinterpolation(", "rendertext(")


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def starts_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.startswith(p)
    return out


def matches_any(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def squeezed(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))


def triage(code: Column) -> Column:
    """label, rule and confidence of a snippet; a fixed order of rules, the first that fits."""
    t = code.rlike(TAINTED)
    of = lambda label, rule, conf: F.struct(F.lit(label).alias("label"), F.lit(rule).cast("string").alias("rule"), F.lit(conf).alias("confidence"))
    safe = code.rlike(SAFE_TEXT) | code.rlike(SAFE_NAME) | code.rlike(SAFE_URL)
    return (
        F.when(code.isNull() | code.rlike(r"^\s*$"), of("SAFE", "empty", 0.6))
        .when(safe, of("SAFE", "safe_static_shape", 0.9))
        .when(t & code.rlike(HTML_SINK), of("XSS", "tainted_html_sink", 0.95))
        .when(t & code.rlike(JS_SINK), of("XSS", "tainted_js_sink", 0.95))
        .when(t & code.rlike(EVENT_SINK), of("XSS", "tainted_event_handler", 0.95))
        .when(code.rlike(URL_LITERAL), of("XSS", "dangerous_url_literal", 0.95))
        .otherwise(of("POSSIBLE_XSS", None, 0.0))
    )


def source_label(c: Column) -> Column:
    low = squeezed(c)
    out = F.when(low == "", "NONE")
    for label, parts in SOURCES.items():
        out = out.when(any_of(low, parts), label)
    return out.when(low.rlike(LITERAL) | starts_any(low, STATIC), "NONE").otherwise("OTHER")


def sink_label(c: Column) -> Column:
    low, out = squeezed(c), F
    for label, parts in SINKS.items():
        out = out.when(any_of(low, parts), label)
    return out.when(starts_any(low, NO_SINK), "NONE").otherwise("OTHER")


def defense_label(c: Column) -> Column:
    low = squeezed(c)
    out = F.when(low.isin(*NO_DEFENSE), "NONE")
    for label, parts in DEFENSES.items():
        out = out.when(any_of(low, parts), label)
    braces = any_of(c, ("{",)) & any_of(c, ("}",)) & any_of(c, ("<",)) & any_of(c, (">",))
    return out.when(braces | any_of(low, ESCAPING), "FRAMEWORK_ESCAPING").otherwise("OTHER")


def poisoning_gate(text: Column, reference: Column) -> Column:
    """private, injected, trusted, and reaches: what passes every gate."""
    private, injected, trusted = matches_any(text, SECRETS.values()), matches_any(text, INJECTIONS), starts_any(reference, TRUSTED)
    return F.struct(private.alias("private"), injected.alias("injected"), trusted.alias("trusted"), (trusted & ~private & ~injected).alias("reaches"))


def knowledge_route(relevant: Column, volatile: Column, needs: Column, reusable: Column, verified: Column, at: float = 0.5, item_volatile: Column | None = None) -> Column:
    """The route of an item by its probabilities and, if given, its own mark as volatile; earlier gates win."""
    fleeting = volatile >= at if item_volatile is None else (volatile >= at) | item_volatile
    return F.when(relevant < at, "IGNORE").when(fleeting, "RAG_ONLY").when((needs >= at) & ~verified, "VERIFY").when(reusable >= at, "TRAINING_CANDIDATE").otherwise("RAG_ONLY")


def finding_state(executed: Column, raw: Column, sanitizer_safe: Column, blocked: Column, reflected: Column) -> Column:
    """status and confidence of a finding from its evidence."""
    of = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    return F.when(executed, of("CONFIRMED", 0.99)).when(raw & ~sanitizer_safe, of("LIKELY", 0.6)).when(blocked, of("INCONCLUSIVE", 0.2)).when(reflected & ~raw, of("NOT_VULNERABLE", 0.12)).otherwise(of("NOT_VULNERABLE", 0.1))


def parsed_fields(text: Column) -> Column:
    """Lines ``Key: value`` of an answer as a map; of repeated keys the last counts."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z ]+?)\s*:\s*(.*)$", 1)).alias("k"), F.btrim(F.regexp_extract(x, r"^\s*([A-Za-z ]+?)\s*:\s*(.*)$", 2)).alias("v")))
    named = F.filter(parts, lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda p: p["k"] == k), -1)["v"]))
