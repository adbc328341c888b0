"""Queries on evidence for outputs, role texts, relation corpora and annotated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import evidence
from tessella.operators import audit, holdout
from tessella.operators.split import hash_mod
from tessella.registry import query
from tessella.tables import load

CONTEXTS = ("html", "javascript", "url", "remote_script", "text", "attribute")
SANITIZERS = ("dompurify:default-html", "encodeURIComponent:html-markup", "fixed-relative-url", "fixed-navigation-url", "own-filter")

_ITEMS = f"""i AS (SELECT l_orderkey, l_linenumber, l_partkey, [{', '.join(f"'{c}'" for c in CONTEXTS)}][1 + l_suppkey % 6] AS context, CASE WHEN l_partkey % 7 < 5 THEN [{', '.join(f"'{c}'" for c in SANITIZERS)}][1 + l_partkey % 7] END AS sanitizer,
 l_returnflag <> 'N' AS have, l_linestatus = 'O' AND l_quantity < 10 AS unknown FROM lineitem),
k AS (SELECT *, context = 'html' AND sanitizer IN ('dompurify:default-html', 'encodeURIComponent:html-markup') OR context = 'url' AND sanitizer IN ('fixed-relative-url', 'fixed-navigation-url') AS fit FROM i),
v AS (SELECT *, coalesce(fit, false) AS fits, CASE WHEN unknown THEN 'UNKNOWN' WHEN have THEN 'CONNECTED' ELSE 'DISCONNECTED' END AS relation FROM k)"""


@query(f"""
WITH {_ITEMS}, r AS (SELECT context, sanitizer, relation, CASE WHEN unknown THEN 'INCONCLUSIVE' WHEN context = 'text' OR NOT have OR fits THEN 'SAFE' ELSE 'CANDIDATE' END AS verdict,
 CASE WHEN context = 'text' THEN 'SAFE_TEXT_OUTPUT' WHEN fits THEN CASE sanitizer WHEN 'dompurify:default-html' THEN 'SANITIZED_HTML' WHEN 'encodeURIComponent:html-markup' THEN 'ENCODED_HTML_MARKUP' WHEN 'fixed-relative-url' THEN 'SAFE_RELATIVE_URL' ELSE 'SAFE_NAVIGATION_URL' END
  WHEN relation = 'CONNECTED' AND context <> 'attribute' THEN 'UNPROTECTED_CONNECTED_SINK' WHEN relation = 'DISCONNECTED' THEN 'DISCONNECTED' ELSE 'UNRESOLVED' END AS rule,
 CASE WHEN context = 'text' THEN 'SAFE_OUTPUT_API' WHEN fits THEN CASE sanitizer WHEN 'dompurify:default-html' THEN 'VERIFIED_CONTEXTUAL_SANITIZATION' WHEN 'encodeURIComponent:html-markup' THEN 'CONTEXTUAL_HTML_ENCODING' WHEN 'fixed-relative-url' THEN 'VERIFIED_RELATIVE_URL_PREFIX' ELSE 'VERIFIED_NAVIGATION_URL_PREFIX' END
  WHEN relation = 'CONNECTED' AND context <> 'attribute' THEN 'NONE' WHEN relation = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'NOT_REQUIRED_FOR_THIS_FLOW' END AS protection FROM v)
SELECT context, coalesce(sanitizer, '') AS sanitizer, relation, verdict, protection, rule, CASE WHEN rule = 'UNPROTECTED_CONNECTED_SINK' THEN 'CANDIDATE' WHEN relation = 'UNKNOWN' THEN 'INCONCLUSIVE' ELSE 'BOUNDED_SAFE' END AS status, count(*) AS n FROM r GROUP BY ALL""")
def sink_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as an output operation with sources, a context and a sanitizer: what evidence comes of it."""
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    context, sanitizer = of(CONTEXTS, F.col("l_suppkey") % 6), of(SANITIZERS, F.col("l_partkey") % 7)
    sources = F.when(F.col("l_returnflag") != "N", F.array(F.lit("location.hash"), F.lit("location.hash")))
    made = evidence.sink_evidence(context, sources, sanitizer, (F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10))
    own = load(spark, sf_dir, "lineitem").select(context.alias("context"), F.coalesce(sanitizer, F.lit("")).alias("sanitizer"), made.alias("e"))
    return own.groupBy("context", "sanitizer", *[F.col(f"e.{c}").alias(c) for c in ("relation", "verdict", "protection", "rule", "status")]).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT p_partkey, p_brand AS source, CASE p_partkey % 4 WHEN 0 THEN p_brand || '.x' WHEN 1 THEN ' ' WHEN 2 THEN 'out' ELSE substring(p_brand, 1, 5) END AS sink, 'out = ' || p_brand || '.x + ' || p_name || p_brand || ';' AS excerpt FROM part)
SELECT p_partkey, CASE WHEN trim(sink) <> '' THEN '[SOURCE]' || chr(10) || '__SOURCE__' || chr(10) || '[SINK]' || chr(10) || '__SINK__' || chr(10) || '[FLOW]' || chr(10) ||
 CASE WHEN length(source) >= length(sink) THEN replace(replace(excerpt, source, '__SOURCE__'), sink, '__SINK__') ELSE replace(replace(excerpt, sink, '__SINK__'), source, '__SOURCE__') END END AS role_text FROM p""")
def role_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts in which both expressions stand as roles; one lies inside the other for half of them."""
    k, source = F.col("p_partkey") % 4, F.col("p_brand")
    sink = F.when(k == 0, F.concat(source, F.lit(".x"))).when(k == 1, " ").when(k == 2, "out").otherwise(F.substring("p_brand", 1, 5))
    excerpt = F.concat(F.lit("out = "), source, F.lit(".x + "), "p_name", source, F.lit(";"))
    return load(spark, sf_dir, "part").select("p_partkey", evidence.role_text(source, sink, excerpt).alias("role_text"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a relation corpus, some of them at fault."""
    k, of = F.col("doc_id") % 17, lambda at, fault, value: F.when(F.col("doc_id") % 17 == at, fault).otherwise(value)
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") % 5 == 0, "dev").otherwise("train").alias("split"), F.concat(F.lit("r"), of(1, None, F.col("doc_id").cast("string"))).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"),
        of(2, "MAYBE", F.lit("CONNECTED")).alias("label"), of(3, "OPEN", F.lit("REVIEWED")).alias("status"), (k == 6).alias("native"), F.lit("a").alias("reviewer"), of(4, "  ", F.lit("b")).alias("rationale"), F.lit("c").alias("reference"),
        F.concat(F.lit("repo"), (F.col("doc_id") % 41).cast("string")).alias("repository"), of(5, None, F.concat(F.lit("fw"), (F.col("n_chars") % 5 == 0).cast("string"))).alias("framework"), F.when(k.isin(6, 7), "not-applicable").otherwise("t").alias("template"), F.lit(" g ").alias("generator"),
    )


_RELATIONS = """r AS (SELECT doc_id, doc_id % 17 AS k, CASE WHEN n_chars % 5 = 0 THEN 'dev' ELSE 'train' END AS split, sha256(coalesce(text, '')) AS content FROM documents),
f AS (SELECT split, content, min(doc_id) AS first FROM r GROUP BY ALL)"""


@query(f"""
WITH {_RELATIONS} SELECT doc_id, split, CASE k WHEN 2 THEN 'label' WHEN 1 THEN 'id' WHEN 3 THEN 'review' WHEN 4 THEN 'review' WHEN 5 THEN 'provenance' WHEN 7 THEN 'not_applicable' ELSE CASE WHEN doc_id <> first THEN 'duplicate' ELSE 'ok' END END AS reason FROM r JOIN f USING (split, content)""")
def relation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.relation_reasons(relations(spark, sf_dir), "doc_id").select("doc_id", "split", "reason")


@query("""
WITH r AS (SELECT CASE WHEN n_chars % 5 = 0 THEN 'dev' ELSE 'train' END AS split, sha256(coalesce(text, '')) AS content, 'repo' || doc_id % 41 AS repository, 't' AS template FROM documents WHERE true),
v AS (SELECT split, 'repository' AS key, repository AS value FROM r UNION SELECT split, 'content', content FROM r UNION SELECT split, 'template', 't' FROM r UNION SELECT split, 'generator', 'g' FROM r)
SELECT key, count(*) AS n FROM (SELECT key, value FROM v GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY key""")
def relation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.relation_overlap(relations(spark, sf_dir))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE pos % 6 WHEN 1 THEN '// RuleId: Not-This' WHEN 2 THEN '# ruleid : Dom-XSS.' || doc_id % 3 WHEN 3 THEN '  ' WHEN 5 THEN '<!-- ok: avoid-v-html -->' ELSE line END AS line FROM l),
t AS (SELECT *, min(CASE WHEN trim(line, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) <> '' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target FROM m)
SELECT doc_id, pos, lower(regexp_extract(line, '(?:ruleid|ok)\s*:\s*([\w.-]+)', 1)) AS rule, CASE WHEN regexp_matches(line, '\bok\s*:') THEN 'SAFE' ELSE 'UNSAFE' END AS label, target FROM t WHERE target IS NOT NULL AND regexp_matches(line, '(?:ruleid|ok)\s*:\s*([\w.-]+)')""")
def annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines with annotations put between them; each one's next line that is not blank."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    k = F.col("pos") % 6
    made = F.when(k == 1, "// RuleId: Not-This").when(k == 2, F.concat(F.lit("# ruleid : Dom-XSS."), (F.col("doc_id") % 3).cast("string"))).when(k == 3, "  ").when(k == 5, "<!-- ok: avoid-v-html -->").otherwise(F.col("line"))
    return audit.annotated(lines.select("doc_id", "pos", made.alias("line")), "doc_id", "pos", "line")


#: What the registered holdout says of itself.
MANIFEST = {"evaluation_kind": "external_holdout", "exposure_status": "unseen", "frozen_before_engine_changes": True, "development_inventory_complete": False, "sampling_plan_ref": None}
AUTHORS = ("author1", "author2")


def holdout_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Test documents as cases, some of them at fault, and the other documents as the development set."""
    docs = load(spark, sf_dir, "documents").withColumn("split", hash_mod(F.col("doc_id").cast("string")))
    of = lambda at, fault, value: F.when(F.col("doc_id") % 23 == at, fault).otherwise(value)
    text = lambda at, fault, value: of(at, F.lit(fault).cast("string"), value if not isinstance(value, str) else F.lit(value))
    cases = docs.where("split = 'test'").select(
        "doc_id", text(1, None, of(2, F.lit("same"), F.concat(F.lit("c"), F.col("doc_id").cast("string")))).alias("id"), text(3, None, text(4, "", F.col("text"))).alias("code"),
        text(5, "maybe", F.when(F.col("n_chars") % 2 == 0, "safe").otherwise("unsafe")).alias("label"), of(8, F.col("source"), text(7, None, F.concat(F.lit("ext/"), "source"))).alias("repository"), text(6, "main", F.sha1(F.col("source"))).alias("revision"), F.lit("a/b").alias("path"),
        text(9, None, F.col("lang")).alias("family"), text(10, "", text(11, "author1", "someone")).alias("reviewer"), F.lit("e").alias("evidence_ref"), F.lit("s").alias("semantic_reason"), of(12, F.lit(None).cast("boolean"), F.lit(False)).alias("safe_by_nonexecution_only"), of(13, F.lit(False), F.lit(True)).alias("executed"),
    )
    return cases, docs.where("split = 'train'").select(F.col("text").alias("code"), F.col("source").alias("repository"))


@query(r"""
WITH d AS (SELECT doc_id, doc_id % 23 AS k, text, source, lang, n_chars, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 3 = 0 AS test FROM documents),
dev AS (SELECT DISTINCT sha256(regexp_replace(text, '\s+', '', 'g')) AS fp FROM d WHERE NOT test),
c AS (SELECT *, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'same' ELSE 'c' || doc_id END AS id, CASE WHEN k NOT IN (3, 4) AND text <> '' THEN sha256(regexp_replace(text, '\s+', '', 'g')) END AS fp, CASE WHEN k = 5 THEN 'maybe' WHEN n_chars % 2 = 0 THEN 'safe' ELSE 'unsafe' END AS label FROM d WHERE test),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY id) AS first_id, min(doc_id) OVER (PARTITION BY fp) AS first_fp FROM c),
r AS (SELECT doc_id, unnest(list_filter([CASE WHEN id IS NULL OR doc_id <> first_id THEN 'missing_or_duplicate_case_id' END, CASE WHEN fp IS NULL THEN 'source_code_missing' END,
 CASE WHEN fp IS NOT NULL AND fp IN (FROM dev) THEN 'development_code_overlap' END, CASE WHEN fp IS NOT NULL AND doc_id <> first_fp THEN 'repeated_holdout_code' END, CASE WHEN fp IS NOT NULL AND k = 5 THEN 'label_not_adjudicated' END,
 CASE WHEN fp IS NOT NULL AND k IN (6, 7) THEN 'immutable_external_source_missing' END, CASE WHEN fp IS NOT NULL AND k = 8 AND source IN (SELECT source FROM d WHERE NOT test) THEN 'development_repository_overlap' END, CASE WHEN fp IS NOT NULL AND k = 9 THEN 'source_family_missing' END,
 CASE WHEN fp IS NOT NULL AND k = 10 THEN 'independent_label_review_missing' END, CASE WHEN fp IS NOT NULL AND k = 11 THEN 'reviewer_is_engine_author' END, CASE WHEN fp IS NOT NULL AND k = 12 THEN 'negative_browser_result_is_not_safe_ground_truth' END,
 CASE WHEN fp IS NOT NULL AND k = 13 AND label = 'unsafe' THEN 'positive_execution_evidence_missing' END], lambda x: x IS NOT NULL)) AS reason FROM m),
w AS (SELECT count(*) FILTER (label = 'unsafe') AS u, count(*) FILTER (label = 'safe') AS s, count(DISTINCT CASE k WHEN 7 THEN NULL WHEN 8 THEN source ELSE 'ext/' || source END) AS places, count(DISTINCT CASE WHEN k <> 9 THEN lang END) AS kinds FROM c WHERE fp IS NOT NULL)
SELECT reason, count(*) AS n FROM r GROUP BY reason UNION ALL SELECT 'insufficient_cases_per_class', 1 FROM w WHERE least(u, s) < 160 UNION ALL SELECT 'insufficient_disjoint_source_repositories', 1 FROM w WHERE places < 5 UNION ALL SELECT 'insufficient_source_families', 1 FROM w WHERE kinds < 10
UNION ALL SELECT unnest(['development_inventory_incomplete', 'representative_sampling_plan_missing']), 1""")
def holdout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases each code of the holdout protocol speaks against, and what speaks against the set and its manifest."""
    cases, development = holdout_cases(spark, sf_dir)
    return holdout.report(holdout.case_reasons(cases, development, "doc_id", AUTHORS), MANIFEST, per_class=160)


@query("""
WITH r AS (SELECT doc_id, source AS repository, CASE WHEN doc_id % 7 = 0 THEN 'r2' ELSE 'r1' END AS revision, n_chars % 50 AS path, CASE WHEN lang = 'es' THEN 'other' ELSE 'MIT' END AS license FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY repository, revision, path) AS first FROM r)
SELECT doc_id, CASE WHEN repository LIKE '%9' THEN 'unpinned' WHEN revision <> 'r1' THEN 'wrong_revision' WHEN license <> 'MIT' THEN 'wrong_license' WHEN doc_id <> first THEN 'duplicate_identity' ELSE 'ok' END AS reason FROM f""")
def pinned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of repositories, held against one pinned revision and licence for each repository."""
    docs = load(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("source").alias("repository"), F.when(F.col("doc_id") % 7 == 0, "r2").otherwise("r1").alias("revision"), (F.col("n_chars") % 50).alias("path"), F.when(F.col("lang") == "es", "other").otherwise("MIT").alias("license"))
    pins = docs.where("source not like '%9'").select(F.col("source").alias("repository"), F.lit("r1").alias("revision"), F.lit("MIT").alias("license")).distinct()
    return audit.pinned(rows, pins, "doc_id").select("doc_id", "reason")
