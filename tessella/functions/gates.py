"""Column functions that decide: verification, candidates, authority, advisories, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import answers
from tessella.functions.records import routed

# The fields of an advisory that must equal the evidence, in the order compared.
MATCHED = ("source", "flow", "sink", "defense", "limitations")
ALLOWED = ("snippet_sha256", *MATCHED, "decision")
CONFIRMING = ("XSS", "CONFIRMED")


class LearningDisabled(RuntimeError):
    """A learning stage was to run while the switch is off."""


def require_learning(enabled: bool, stage: str) -> None:
    """Stops consolidation, training and promotion while learning is off; inference never asks."""
    if not enabled:
        raise LearningDisabled(f"learning is switched off: {stage} may not run")


def verification(origin: Column, reference: Column) -> Column:
    """verified for what has a reference and is not synthetic."""
    sourced = F.coalesce(reference, F.lit("")) != ""
    return F.when(sourced & ~F.coalesce(origin == "synthetic", F.lit(False)), "verified").otherwise("unverified")


def authority(known: Column, model_confidence: Column) -> Column:
    """label, confidence and authority of a field: the rules' label is a fact, their OTHER keeps the model's confidence."""
    fact = known != "OTHER"
    return F.struct(known.alias("label"), F.when(fact, 1.0).otherwise(model_confidence).alias("confidence"), F.when(fact, "deterministic").otherwise("bounded_unknown").alias("authority"))


def advisory_reason(candidate: Column, evidence: Column) -> Column:
    """Why an advisory (a map of strings) is refused, the first reason that holds; evidence_match_only if it is accepted."""
    differs = lambda k: ~candidate[k].eqNullSafe(evidence[k])
    out = (
        F.when(candidate.isNull(), "advisory_not_object").when(differs("snippet_sha256"), "snippet_hash_mismatch")
        .when((candidate["confirmed"] == "true") | candidate["verdict"].isin(*CONFIRMING), "unverified_confirmation")
        .when(F.size(F.array_except(F.map_keys(candidate), F.array(*map(F.lit, ALLOWED)))) > 0, "unsupported_model_fields")
    )
    for k in MATCHED:
        out = out.when(differs(k), f"unsupported_{k}")
    return out.when(F.map_contains_key(candidate, "decision") & differs("decision"), "model_decision_disagrees").otherwise("evidence_match_only")


def two_stages(fast: Column, confidence: Column, analysis: Column) -> Column:
    """verdict, route and requires_oracle: a sure fast verdict stands, others follow the slower analysis."""
    first, slow = routed(fast, confidence), answers.verdict(analysis)
    escalated = first == "escalate"
    route = F.when(~escalated, first).when(slow == "XSS", "browser_required").when(slow == "SAFE", "heuristic").otherwise("abstain")
    return F.struct(F.when(escalated, slow).otherwise(fast).alias("verdict"), route.alias("route"), route.isin("browser_required", "abstain").alias("requires_oracle"))


def acceptance(precision: Column, recall: Column, fpr: Column, leakage: Column, executed: Column) -> Column:
    """The five frozen thresholds; a rate without a denominator does not pass."""
    return F.coalesce((precision >= 0.90) & (recall >= 0.85) & (fpr <= 0.10) & (leakage <= 0.0) & (executed >= 0.70), F.lit(False))
