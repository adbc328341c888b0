"""Rules on nested values whose shape is not known beforehand, and the order in which findings are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a context may hold
FIELDS = ("evidence_ref", "jquery_globals", "inputs", "bindings", "receivers")
BINDING_FIELDS = ("selector", "kind", "inert_node")
READS = ("value", "text", "textContent", "innerText", "html", "name")
KINDS = ("dom", "jquery")
IDENTIFIER, ATTRIBUTE = r"^[A-Za-z_$][A-Za-z0-9_$]*\z", r"^attribute:[A-Za-z_:][A-Za-z0-9_:.\-]*\z"
# fixed values: what comes first, and what a proposal must hold
PRIORITY = {"CANDIDATE": 0, "INCONCLUSIVE": 1, "SAFE_OBSERVED": 2, "UNREACHABLE": 3}
PROPOSAL_FIELDS, SCHEMA, MOST_FOCUS = ("focus_path_ids", "schema_version", "snippet_sha256"), "focus-v1", 8


def kind_of(v: Column) -> Column:
    """The type's first word: STRING, BOOLEAN, ARRAY, OBJECT and so on; null for what is absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text(v: Column) -> Column:
    """The string that ``v`` is; null for anything else."""
    return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def items(v: Column) -> Column:
    """The elements of a list; null for anything else."""
    return F.when(kind_of(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def members(v: Column) -> Column:
    """The members of an object, as a map; null for anything else."""
    return F.when(kind_of(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))


def sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def strings(v: Column, test) -> Column:
    """True for a list of strings that all pass."""
    return sure(F.forall(items(v), lambda x: sure(test(text(x)))))


def context_failure(json: Column) -> Column:
    """The first rule that a context breaks, ``ok`` if none; what is absent but for the reference counts as empty."""
    v = F.try_parse_json(json)
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    absent = lambda name: ~sure(F.map_contains_key(members(v), name))
    listed = lambda name, test: absent(name) | strings(part(name), test)
    unique = lambda name: absent(name) | (F.size(F.array_distinct(F.transform(items(part(name)), text))) == F.size(items(part(name))))
    entries = lambda name: F.map_entries(members(part(name)))
    every = lambda name, test: absent(name) | sure(F.forall(entries(name), lambda e: sure(test(e["key"], e["value"]))))
    read = lambda t: t.isin(*READS) | t.rlike(ATTRIBUTE)
    field = lambda e, name: F.element_at(members(e), name)
    known = lambda e: F.forall(F.map_keys(members(e)), lambda k: k.isin(*BINDING_FIELDS))
    inert = lambda e: ~F.map_contains_key(members(e), "inert_node") | (kind_of(field(e, "inert_node")) == "BOOLEAN")
    typed = lambda e: (F.length(text(field(e, "selector"))) > 0) & text(field(e, "kind")).isin(*KINDS) & inert(e)
    rules = [
        ("evidence_ref", sure(F.length(F.btrim(text(part("evidence_ref")))) > 0)),
        ("unknown_fields", sure(F.forall(F.map_keys(members(v)), lambda k: k.isin(*FIELDS)))),
        ("receivers", listed("receivers", lambda t: F.length(t) > 0)),
        ("globals", listed("jquery_globals", lambda t: t.rlike(IDENTIFIER)) & sure(unique("jquery_globals"))),
        ("maps", (absent("inputs") | members(part("inputs")).isNotNull()) & (absent("bindings") | members(part("bindings")).isNotNull())),
        ("input_reads", every("inputs", lambda k, x: (F.length(k) > 0) & (F.size(items(x)) > 0))),
        ("read_operation", every("inputs", lambda k, x: strings(x, read))),
        ("binding", every("bindings", lambda k, x: k.rlike(IDENTIFIER) & members(x).isNotNull() & known(x))),
        ("typed_binding", every("bindings", lambda k, x: typed(x))),
    ]
    found = F.when(F.lit(False), F.lit(""))
    for name, holds in rules:
        found = found.when(~holds, name)
    return found.otherwise("ok")


def focus(proposal: Column, snippet: Column, paths: Column) -> Column:
    """accepted, reason and ids of a proposal (JSON) on which ``paths`` (path_id, status) to show first."""
    v = F.try_parse_json(proposal)
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    ids = F.transform(items(part("focus_path_ids")), text)
    known = F.transform(paths, lambda p: p["path_id"])
    of = lambda ok, why: F.struct(F.lit(ok).alias("accepted"), F.lit(why).alias("reason"), (ids if ok else F.slice(known, 1, 0)).alias("ids"))
    return (
        F.when(~sure(F.array_sort(F.map_keys(members(v))) == F.array(*map(F.lit, PROPOSAL_FIELDS))), of(False, "unsupported_model_schema"))
        .when(~sure(text(part("schema_version")) == SCHEMA), of(False, "unsupported_schema_version"))
        .when(~sure(text(part("snippet_sha256")) == snippet), of(False, "snippet_hash_mismatch"))
        .when(~sure((F.size(ids) <= MOST_FOCUS) & F.forall(ids, lambda x: x.isNotNull())), of(False, "invalid_path_id_list"))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), of(False, "duplicate_path_ids"))
        .when(~F.forall(ids, lambda x: F.array_contains(known, x)), of(False, "unsupported_path_id"))
        .otherwise(of(True, "existing_path_ids_only"))
    )


def shown(chosen: Column, paths: Column) -> Column:
    """The order of path ids: what must be seen first, then an accepted choice; without one all by priority and id."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    of = lambda p: F.coalesce(rank[p["status"]], F.lit(len(PRIORITY)))
    compared = lambda a, b: F.when(of(a) < of(b), -1).when(of(a) > of(b), 1).when(a["path_id"] < b["path_id"], -1).when(a["path_id"] > b["path_id"], 1).otherwise(0)
    ids = lambda xs: F.transform(xs, lambda p: p["path_id"])
    mandatory = ids(F.filter(paths, lambda p: p["status"].isin("CANDIDATE", "INCONCLUSIVE")))
    return F.when(chosen["accepted"], F.array_distinct(F.concat(mandatory, chosen["ids"]))).otherwise(ids(F.array_sort(paths, compared)))
