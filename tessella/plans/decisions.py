"""Queries on gates, answers and decision rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import answers, gates, rules
from tessella.operators import metrics as m
from tessella.operators.identity import exact
from tessella.plans.evaluation import P, predicted, rounded
from tessella.plans.text import LOW, SNIPPETS, quoted, snippets, sql_contains, sql_starts
from tessella.registry import query
from tessella.tables import load


def sql_rate(k: str, n: str) -> str:
    return f"round(({k}) / nullif({n}, 0), 6)"


def sql_wilson(k: str, n: str, sign: str) -> str:
    p, z = f"({k} / {n})", m.Z95
    return f"(({p} + {z * z} / (2 * {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n}))"


RATES = {
    "unsafe_candidate_recall": ("tp", "unsafe"), "adjudicated_precision": ("tp", "tp + fp"), "verified_alert_fraction": ("tp", "tp + fp + alerts"), "safe_false_positive_rate": ("fp", "safe"),
    "unsafe_static_safe_rate": ("missed", "unsafe"), "unsafe_candidate_miss_rate": ("unsafe - tp", "unsafe"), "unsafe_abstention_rate": ("ua", "unsafe"), "safe_abstention_rate": ("sa", "safe"),
    "needs_review_overclaim_rate": ("alerts + rs", "review"), "unsafe_not_tested_rate": ("un", "unsafe"), "test_coverage": ("n - untested", "n"), "decision_coverage": ("n - untested - unresolved", "n"),
}


@query(f"""
WITH {P}, s AS (SELECT lang, CASE WHEN gold THEN 'unsafe' WHEN toxic THEN 'needs_review' ELSE 'safe' END AS label, CASE WHEN pred = 'vulnerable' THEN 'CANDIDATE' WHEN pred = 'safe' THEN 'SAFE' WHEN n_chars % 2 = 0 THEN 'NOT_TESTED' ELSE 'INCONCLUSIVE' END AS status FROM c),
k AS (SELECT lang, count(*) AS n, count(*) FILTER (label = 'unsafe') AS unsafe, count(*) FILTER (label = 'safe') AS safe, count(*) FILTER (label = 'needs_review') AS review,
 count(*) FILTER (label = 'unsafe' AND status = 'CANDIDATE') AS tp, count(*) FILTER (label = 'safe' AND status = 'CANDIDATE') AS fp, count(*) FILTER (label = 'needs_review' AND status = 'CANDIDATE') AS alerts,
 count(*) FILTER (label = 'unsafe' AND status = 'SAFE') AS missed, count(*) FILTER (label = 'unsafe' AND status = 'INCONCLUSIVE') AS ua, count(*) FILTER (label = 'safe' AND status = 'INCONCLUSIVE') AS sa, count(*) FILTER (label = 'needs_review' AND status = 'SAFE') AS rs,
 count(*) FILTER (label = 'unsafe' AND status = 'NOT_TESTED') AS un, count(*) FILTER (status = 'NOT_TESTED') AS untested, count(*) FILTER (status = 'INCONCLUSIVE') AS unresolved FROM s GROUP BY lang)
SELECT lang, {', '.join(f'{sql_rate(*v)} AS {k}' for k, v in RATES.items())}, CASE WHEN alerts = 0 THEN {sql_rate('tp', 'tp + fp')} END AS candidate_precision,
 coalesce(tp / nullif(unsafe, 0) >= 0.64 AND fp / nullif(safe, 0) <= 0.95 AND missed <= unsafe * 0.24, false) AS point_gate,
 coalesce(tp / nullif(unsafe, 0) >= 0.64 AND fp / nullif(safe, 0) <= 0.95 AND missed <= unsafe * 0.24 AND CASE WHEN unsafe > 0 THEN {sql_wilson('tp', 'unsafe', '-')} END >= 0.64 AND CASE WHEN safe > 0 THEN {sql_wilson('fp', 'safe', '+')} END <= 0.95, false) AS interval_gate FROM k""")
def decision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rate of a three-label suite by language; the gates' bounds here are lower than the defaults, so that they tell."""
    label = F.when(F.col("gold"), "unsafe").when(F.col("toxic"), "needs_review").otherwise("safe")
    p = F.col("pred")
    status = F.when(p == "vulnerable", "CANDIDATE").when(p == "safe", "SAFE").when(F.col("n_chars") % 2 == 0, "NOT_TESTED").otherwise("INCONCLUSIVE")
    rates = m.decision_rates(predicted(spark, sf_dir).select("lang", label.alias("label"), status.alias("status")), "lang", recall=0.64, fpr=0.95, missed=0.24)
    return rounded(rates.select("lang", *RATES, "candidate_precision", "point_gate", "interval_gate"))


@query(f"""
WITH {P}, k AS (SELECT source, count(*) FILTER (t AND gold) AS tp, count(*) FILTER (t AND NOT gold) AS fp, count(*) FILTER (NOT t AND gold) AS fn, count(*) FILTER (NOT t AND NOT gold) AS tn, avg((NOT t)::INT) FILTER (gold AND toxic) AS leakage, avg((t AND conf >= 0.4)::INT) FILTER (gold) AS executed
 FROM (SELECT *, pred = 'vulnerable' AS t FROM p) GROUP BY source)
SELECT source, coalesce(tp / nullif(tp + fp, 0) >= 0.9 AND tp / nullif(tp + fn, 0) >= 0.85 AND fp / nullif(fp + tn, 0) <= 0.1 AND leakage <= 0 AND executed >= 0.7, false) AS accepted FROM k""")
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acceptance gate for each source: positive is what is called vulnerable, and of all that is vulnerable enough must be confirmed."""
    g, p = F.col("gold"), F.col("positive")
    own = predicted(spark, sf_dir).withColumn("positive", F.col("pred") == "vulnerable")
    counts, rates = m.live()
    mean = lambda test, where: F.avg(F.when(where, test.cast("int")))
    per = own.groupBy("source").agg(*counts, mean(~p, g & F.col("toxic")).alias("leakage"), mean(p & (F.col("conf") >= 0.4), g).alias("executed"))
    per = per.select("source", *rates, "leakage", "executed")
    return per.select("source", gates.acceptance(*[F.col(c) for c in ("precision", "recall", "fpr", "leakage", "executed")]).alias("accepted"))


@query("""
WITH p AS (SELECT (n_chars % 10) / 10.0 AS relevant, (n_chars % 7) / 7.0 AS volatile, (n_chars % 5) / 5.0 AS needs, (n_chars % 3) / 3.0 AS reusable, contains(text, '20') AS dated,
 CASE WHEN doc_id % 4 > 1 AND source <> 'src3' THEN 'verified' ELSE 'unverified' END AS status FROM documents),
r AS (SELECT status, CASE WHEN relevant < 0.5 THEN 'IGNORE' WHEN volatile >= 0.5 OR dated THEN 'RAG_ONLY' WHEN needs >= 0.5 AND status <> 'verified' THEN 'VERIFY' WHEN reusable >= 0.5 THEN 'TRAINING_CANDIDATE' ELSE 'RAG_ONLY' END AS route FROM p)
SELECT route, status, route = 'TRAINING_CANDIDATE' AND status = 'verified' AS collected, count(*) AS n FROM r GROUP BY ALL""")
def verified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge by route and verification, and what both let through."""
    status = gates.verification(F.when(F.col("source") == "src3", "synthetic"), F.when(F.col("doc_id") % 4 > 1, F.concat(F.lit("https://example.org/"), "source")))
    p = [(F.col("n_chars") % k) / k for k in (10, 7, 5, 3)]
    docs = load(spark, sf_dir, "documents").select(*[c.alias(k) for c, k in zip(p, "abcd", strict=True)], F.contains("text", F.lit("20")).alias("dated"), status.alias("status"))
    route = rules.knowledge_route(*[F.col(k) for k in "abcd"], F.col("status") == "verified", item_volatile=F.col("dated"))
    kept = (F.col("route") == "TRAINING_CANDIDATE") & (F.col("status") == "verified")
    return docs.withColumn("route", route).groupBy("route", "status", kept.alias("collected")).agg(F.count("*").alias("n"))


@query(f"""
WITH {SNIPPETS}, l AS (SELECT page_id, {LOW} AS low FROM snippets), k AS (SELECT page_id, CASE WHEN low = '' THEN 'NONE' {' '.join(f"WHEN {sql_contains('low', p)} THEN '{k}'" for k, p in rules.SOURCES.items())} WHEN regexp_matches(low, '{quoted(rules.LITERAL)}') OR {sql_starts('low', rules.STATIC)} THEN 'NONE' ELSE 'OTHER' END AS label FROM l)
SELECT label, CASE WHEN label <> 'OTHER' THEN 'deterministic' ELSE 'bounded_unknown' END AS authority, count(*) AS n, round(avg(CASE WHEN label <> 'OTHER' THEN 1.0 ELSE (page_id % 100) / 100 END), 6) AS confidence FROM k GROUP BY ALL""")
def field_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source labels the rules settle, and which are left to a model's confidence."""
    field = gates.authority(rules.source_label(F.col("code")), (F.col("page_id") % 100) / 100)
    own = snippets(spark, sf_dir).select(F.inline(F.array(field)))
    return rounded(own.groupBy("label", "authority").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")))


@query("""
WITH d AS (SELECT *, sha256(text) AS h FROM documents),
r AS (SELECT lang, CASE WHEN n_chars % 13 = 0 THEN 'advisory_not_object' WHEN n_chars % 9 = 0 THEN 'snippet_hash_mismatch' WHEN n_chars % 11 = 0 THEN 'unverified_confirmation' WHEN n_chars % 7 = 0 THEN 'unsupported_model_fields'
 WHEN source = 'src2' THEN 'unsupported_source' WHEN lang = 'fr' AND n_chars % 2 = 0 THEN 'unsupported_sink' WHEN n_chars % 5 = 0 THEN 'model_decision_disagrees' ELSE 'evidence_match_only' END AS reason FROM d)
SELECT lang, reason, count(*) AS n FROM r GROUP BY ALL""")
def advisory_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories held against the evidence, by the first reason to refuse them."""
    n, h = F.col("n_chars"), exact(F.col("text"))
    lit = F.lit
    part = lambda test, key, value: F.when(test, F.create_map(lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    evidence = F.create_map(lit("snippet_sha256"), h, lit("source"), F.col("source"), lit("flow"), lit("direct"), lit("sink"), F.col("lang"), lit("decision"), lit("review"))
    advised = F.map_concat(
        F.create_map(lit("snippet_sha256"), F.when(n % 9 == 0, lit("0")).otherwise(h), lit("source"), F.when(F.col("source") == "src2", "src").otherwise(F.col("source")), lit("flow"), lit("direct"),
                     lit("sink"), F.when((F.col("lang") == "fr") & (n % 2 == 0), "html").otherwise(F.col("lang"))),
        part(n % 11 == 0, "confirmed", lit("true")), part(n % 7 == 0, "prose", lit("surely")), part(n % 5 == 0, "decision", lit("accept")),
    )
    reason = gates.advisory_reason(F.when(n % 13 != 0, advised), evidence)
    return load(spark, sf_dir, "documents").groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))


# answers that hold a turn's own words
ANSWER = """'Classification: ' || CASE length(text) % 4 WHEN 0 THEN 'Vulnerable ' || text WHEN 1 THEN 'safe' WHEN 2 THEN 'safely' ELSE '' END || chr(10) || 'Confidence: ' || CASE length(text) % 5 WHEN 0 THEN 'high' WHEN 1 THEN '1.5' ELSE '0.' || (length(text) % 10) END
 || chr(10) || 'Evidence: ' || CASE length(text) % 3 WHEN 0 THEN 'Not established, observed ' WHEN 1 THEN 'inferred from ' ELSE '' END || text || CASE WHEN length(text) % 7 = 0 THEN ' Executed in the browser' ELSE '' END"""


def sql_field(key: str) -> str:
    return f"trim(regexp_extract(answer, '(?m)^{key}:\\s*([^\\n]+)$', 1), chr(32))"


@query(rf"""
WITH a AS (SELECT conv_id, turn, {ANSWER} AS answer FROM conversations), f AS (SELECT *, {sql_field('Classification')} AS c, TRY_CAST({sql_field('Confidence')} AS DOUBLE) AS v, {sql_field('Confidence')} AS w, {sql_field('Evidence')} AS e FROM a)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(lower(c), '^(safe|vulnerable)(?:\s|$)', 1), ''), 'invalid') AS prediction, CASE WHEN v BETWEEN 0 AND 1 THEN v END AS confidence, (c <> '')::INT + (w <> '')::INT + (e <> '')::INT AS fields_present,
 coalesce(c <> '' AND w <> '' AND e <> '' AND v BETWEEN 0 AND 1, false) AS complete, regexp_matches(answer, '{answers.CLAIM}') AS claims_execution,
 CASE WHEN contains(upper(e), 'NOT_ESTABLISHED') OR contains(upper(e), 'NOT ESTABLISHED') THEN 'not_established' WHEN contains(upper(e), 'INFERRED') THEN 'inferred' WHEN contains(upper(e), 'OBSERVED') THEN 'observed' END AS tag FROM f""")
def free_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in free text: prediction, confidence, complete fields, claims without evidence, evidence tag."""
    own = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(ANSWER.replace("chr(10)", "'\\n'")).alias("answer"))
    found = answers.free_answer(F.col("answer"), ("Classification", "Confidence", "Evidence"))
    return own.select("conv_id", "turn", F.inline(F.array(found)), answers.evidence_tag(answers.field(F.col("answer"), "Evidence")).alias("tag"))


@query("""
WITH c AS (SELECT *, (length(text) % 100) / 100 AS conf, CASE WHEN role = 'user' THEN 'XSS' ELSE 'SAFE' END AS fast, upper(CASE length(text) % 4 WHEN 0 THEN 'Verdict: xss ' WHEN 1 THEN 'classification: Safe ' WHEN 2 THEN 'verdict: possible_xss, verdict: xss ' ELSE '' END || text) AS up FROM conversations),
v AS (SELECT *, CASE WHEN contains(up, 'CLASSIFICATION: POSSIBLE_XSS') OR contains(up, 'VERDICT: POSSIBLE_XSS') THEN 'POSSIBLE_XSS' WHEN contains(up, 'CLASSIFICATION: XSS') OR contains(up, 'VERDICT: XSS') THEN 'XSS' WHEN contains(up, 'CLASSIFICATION: SAFE') OR contains(up, 'VERDICT: SAFE') THEN 'SAFE' ELSE 'POSSIBLE_XSS' END AS slow,
 CASE WHEN fast = 'SAFE' AND conf >= 0.9 THEN 'encoder' WHEN fast = 'XSS' AND conf >= 0.85 THEN 'browser_required' ELSE 'escalate' END AS first FROM c),
r AS (SELECT CASE WHEN first = 'escalate' THEN slow ELSE fast END AS verdict, CASE WHEN first <> 'escalate' THEN first WHEN slow = 'XSS' THEN 'browser_required' WHEN slow = 'SAFE' THEN 'heuristic' ELSE 'abstain' END AS route FROM v)
SELECT verdict, route, route IN ('browser_required', 'abstain') AS requires_oracle, count(*) AS n FROM r GROUP BY ALL""")
def router_both_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns routed by a fast verdict and, where it is unsure, by a slower analysis."""
    n = F.length("text")
    analysis = F.concat(F.when(n % 4 == 0, "Verdict: xss ").when(n % 4 == 1, "classification: Safe ").when(n % 4 == 2, "verdict: possible_xss, verdict: xss ").otherwise(""), F.col("text"))
    stages = gates.two_stages(F.when(F.col("role") == "user", "XSS").otherwise("SAFE"), (n % 100) / 100, analysis)
    return load(spark, sf_dir, "conversations").select(F.inline(F.array(stages))).groupBy("verdict", "route", "requires_oracle").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_type, CASE user_id % 3 WHEN 0 THEN rtrim(props, '}') WHEN 1 THEN props ELSE replace(props, '}', ', "extra": 1}') END AS raw FROM events)
SELECT event_type, CASE WHEN json_valid(raw) THEN list_sort(json_keys(raw)) = ['k'] ELSE false END AS accepted, count(*) AS n FROM e GROUP BY ALL""")
def advisory_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers that hold the wanted keys and no others."""
    u = F.col("user_id") % 3
    raw = F.when(u == 0, F.rtrim("props", F.lit("}"))).when(u == 1, F.col("props")).otherwise(F.replace("props", F.lit("}"), F.lit(', "extra": 1}')))
    return load(spark, sf_dir, "events").groupBy("event_type", answers.has_exact_keys(raw, ("k",)).alias("accepted")).agg(F.count("*").alias("n"))


@query("""
SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def instruction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the answer to it as one row."""
    turns = load(spark, sf_dir, "conversations")
    said = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return said.join(answer, ["conv_id", "turn"])  # by conversation and turn: a long conversation spreads over tasks


@query(r"""
WITH t AS (SELECT page_id, 'see ```js' || chr(10) || regexp_extract(html, '(?s)<script>(.*?)</script>', 1) || '``` and ```x```' AS md FROM pages) SELECT page_id, nullif(regexp_extract(md, '```[A-Za-z]*\n([^`]*)```', 1), '') AS code FROM t""")
def fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fenced block of a text."""
    md = F.concat(F.lit("see ```js\n"), F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1), F.lit("``` and ```x```"))
    return load(spark, sf_dir, "pages").select("page_id", answers.fenced(md).alias("code"))
