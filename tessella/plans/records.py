"""Queries on record projections, gates, guards and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import records as r
from tessella.operators.identity import exact
from tessella.registry import query
from tessella.tables import load

KINDS = ("view", "click", "signup", "purchase")


@query("""
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') / 10 AS a, count(*) FILTER (event_type = 'click') / 10 AS b, count(*) FILTER (event_type = 'signup') / 10 AS c, count(*) FILTER (event_type = 'purchase') / 10 AS d FROM events GROUP BY 1), m AS (SELECT *, greatest(a, b, c, d) AS m FROM u)
SELECT user_id, CASE m WHEN a THEN 'view' WHEN b THEN 'click' WHEN c THEN 'signup' ELSE 'purchase' END AS label, round(1 / (exp(a - m) + exp(b - m) + exp(c - m) + exp(d - m)), 6) AS probability FROM m""")
def argmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = {k: F.count_if(F.col("event_type") == k) / 10 for k in KINDS}
    users = load(spark, sf_dir, "events").groupBy("user_id").agg(*[c.alias(k) for k, c in n.items()])
    scores = {k: F.col(k) for k in KINDS}
    return users.select("user_id", r.argmax_first(scores).alias("label"), F.round(F.array_max(r.softmax(F.array(*scores.values()))), 6).alias("probability"))


@query("""
SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (l_returnflag = 'R') AS source, arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (l_returnflag = 'N') AS sink, count(*) AS n_nodes FROM lineitem GROUP BY 1""")
def first_source_last_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("role"))
    flows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(node)).alias("flow"))
    source, sink = r.first_of(F.col("flow"), lambda x: x["role"] == "R"), r.last_of(F.col("flow"), lambda x: x["role"] == "N")
    return flows.select("l_orderkey", source["l_partkey"].alias("source"), sink["l_partkey"].alias("sink"), F.size("flow").cast("long").alias("n_nodes"))


@query("""
SELECT source, count(*) FILTER (lang = 'fr' OR source = 'src3' OR toxic = 1) AS reserved, count(*) FILTER (quality = 1 AND NOT coalesce(toxic = 1, false)) AS eligible, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS lang_index FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang_index""")
def reserved_and_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").drop("text").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    tags = F.array_compact(F.array(F.upper("lang"), F.col("source"), F.when(F.col("toxic") == 1, "Toxic")))
    reserved = F.arrays_overlap(F.transform(tags, F.lower), F.array(F.lit("fr"), F.lit("src3"), F.lit("toxic")))
    eligible = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    index = (F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")) - 1).cast("int")
    return docs.groupBy("source", index.alias("lang_index")).agg(F.count_if(reserved).alias("reserved"), F.count_if(eligible).alias("eligible"))


@query(r"""
WITH k AS (SELECT regexp_replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN '-safe' ELSE '-unsafe' END, '-(unsafe|safe)$', '') AS stem, regexp_replace('case-' || c_mktsegment || '-v-' || c_custkey, '-(v|s)-\d+$', '') AS family, c_acctbal FROM customer)
SELECT family, count(DISTINCT stem) AS n_stems, round(sum(c_acctbal), 2) AS total FROM k GROUP BY family""")
def derived_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    stem = F.regexp_replace(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "-safe").otherwise("-unsafe")), "-(unsafe|safe)$", "")
    family = F.regexp_replace(F.concat(F.lit("case-"), "c_mktsegment", F.lit("-v-"), F.col("c_custkey").cast("string")), r"-(v|s)-\d+$", "")
    return c.groupBy(family.alias("family")).agg(F.countDistinct(stem).alias("n_stems"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""
SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 1000000000000 + o_orderkey) AS first_finding, count(*) AS n FROM orders GROUP BY 1""")
def status_priority_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct(order.alias("p"), "o_orderkey"))["o_orderkey"].alias("first_finding"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT o_custkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS spent FROM orders)
SELECT o_custkey, count(*) AS n_within, round(max(spent), 2) AS spent FROM c WHERE spent <= 400000 GROUP BY 1""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    within = load(spark, sf_dir, "orders").select("o_custkey", spent.alias("spent")).where("spent <= 400000")
    return within.groupBy("o_custkey").agg(F.count("*").alias("n_within"), F.round(F.max("spent"), 2).alias("spent"))


@query("""
WITH p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'SAFE' ELSE 'XSS' END AS verdict, (n_chars % 100) / 100 AS conf, toxic FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN verdict = 'SAFE' AND conf >= 0.9 THEN 'encoder' WHEN verdict = 'XSS' AND conf >= 0.85 THEN 'browser_required' ELSE 'escalate' END AS route, CASE WHEN conf < 0.6 OR conf - (1 - conf) < 0.3 THEN 'POSSIBLE_XSS' ELSE 'XSS' END AS gate,
 CASE WHEN verdict = 'XSS' OR conf >= 0.85 THEN 'high' ELSE 'normal' END AS priority, count(*) AS n FROM p GROUP BY ALL""")
def two_stage_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id")
    verdict, conf = F.when(F.col("quality") == 1, "SAFE").otherwise("XSS"), (F.col("n_chars") % 100) / 100
    priority = F.when((verdict == "XSS") | (conf >= 0.85), "high").otherwise("normal")
    return docs.groupBy(r.routed(verdict, conf).alias("route"), r.abstaining(conf, 1 - conf, 0.6, 0.3).alias("gate"), priority.alias("priority")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT lang, source, CASE WHEN lang IN ('en', 'de') AND source <> 'src5' THEN 'allowed' WHEN source = 'src5' THEN 'source not authorised' ELSE 'class not authorised' END AS decision, coalesce(nullif(nullif(source, 'src1'), ''), nullif(lang, ''), 'unknown') AS owner FROM documents)
SELECT decision, owner, count(*) AS n FROM a GROUP BY ALL""")
def authorisation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    decision = F.when(F.col("lang").isin("en", "de") & (s != "src5"), "allowed").when(s == "src5", "source not authorised").otherwise("class not authorised")
    return load(spark, sf_dir, "documents").groupBy(decision.alias("decision"), r.first_filled(F.nullif("source", F.lit("src1")), F.col("lang")).alias("owner")).agg(F.count("*").alias("n"))


EXPECTED = {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.10, "it": 0.0}


@query("""
WITH e AS (SELECT * FROM (VALUES ('en', 0.6), ('fr', 0.15), ('de', 0.15), ('es', 0.10), ('it', 0.0)) v(lang, share)), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, coalesce(n, 0) AS n, abs(coalesce(n, 0) / (SELECT count(*) FROM documents) - coalesce(share, 0)) <= 0.03 AS as_declared FROM e FULL JOIN n USING (lang)""")
def declared_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame(list(EXPECTED.items()), "lang string, share double")
    counts = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    both = declared.join(counts, "lang", "full")
    n = F.coalesce("n", F.lit(0))
    return both.select("lang", n.alias("n"), (F.abs(n / F.sum(n).over(Window.partitionBy()) - F.coalesce("share", F.lit(0.0))) <= 0.03).alias("as_declared"))


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, sha256(text) AS h, sha256(regexp_extract(text, '^([^.]*[.])', 1)) AS f, length(regexp_extract(text, '^([^.]*[.])', 1)) AS n FROM documents)
SELECT 'text' AS key, count(*) AS n_leaked FROM s WHERE split = 'eval' AND h IN (SELECT h FROM s WHERE split = 'train') UNION ALL
SELECT 'first_sentence', count(*) FROM s WHERE split = 'eval' AND n > 20 AND f IN (SELECT f FROM s WHERE split = 'train' AND n > 20)""")
def prompt_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.regexp_extract("text", "^([^.]*[.])", 1)
    docs = load(spark, sf_dir, "documents").select((F.col("doc_id") % 5 == 0).alias("held"), exact(F.col("text")).alias("text"), F.when(F.length(first) > 20, exact(first)).alias("first_sentence"))
    keys = docs.select("held", F.explode(F.create_map(F.lit("text"), F.col("text"), F.lit("first_sentence"), F.col("first_sentence"))).alias("key", "value")).where("value is not null")
    counts = keys.groupBy("key", "value").agg(F.count_if(F.col("held")).alias("held"), F.count_if(~F.col("held")).alias("train"))
    return counts.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("held"))), F.lit(0)).alias("n_leaked"))


@query("""
WITH b AS (SELECT doc_id, sha256(text) AS h, source FROM documents WHERE doc_id % 11 <> 3), a AS (SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN sha256(text || '.') ELSE sha256(text) END AS h, source FROM documents WHERE doc_id % 7 <> 2)
SELECT CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM b FULL JOIN a USING (doc_id) GROUP BY 1""")
def snapshot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, t = load(spark, sf_dir, "documents"), F.col("text")
    before = docs.where("doc_id % 11 <> 3").select("doc_id", exact(t).alias("b"))
    after = docs.where("doc_id % 7 <> 2").select("doc_id", exact(F.when(F.col("doc_id") % 13 == 5, F.concat(t, F.lit("."))).otherwise(t)).alias("a"))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return before.join(after, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT DISTINCT p_brand AS name FROM part), p AS (SELECT a.name AS a, b.name AS b FROM b a JOIN b b ON a.name < b.name)
SELECT a, b, (SELECT count(*) FROM range(1, length(a) + 1) t(i) WHERE i <= length(b) AND left(a, i::BIGINT) = left(b, i::BIGINT)) AS prefix, (SELECT count(*) FROM range(1, length(a) + 1) t(i) WHERE i <= length(b) AND right(a, i::BIGINT) = right(b, i::BIGINT)) AS suffix FROM p""")
def shared_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).distinct()
    # brands are a fixed list; pairs are formed within it only
    pairs = names.join(F.broadcast(names.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", r.shared_prefix(F.col("a"), F.col("b")).cast("long").alias("prefix"), r.shared_suffix(F.col("a"), F.col("b")).cast("long").alias("suffix"))


@query(r"""
WITH m AS (SELECT needle, html, strpos(html, needle) AS pos FROM pages, (SELECT unnest(['track', 'utf-8', 'the', 'lang']) AS needle)),
b AS (SELECT needle, pos, substr(html, greatest(pos - 80, 1), pos - greatest(pos - 80, 1)) AS t FROM m),
l AS (SELECT *, length(t) - length(regexp_replace(t, '^.*<', '', 's')) AS lt, length(t) - length(regexp_replace(t, '^.*>', '', 's')) AS gt,
  contains(t, '<script') AND NOT contains(regexp_replace(t, '^.*<script', '', 's'), '</script>') AS js, contains(t, '<!--') AND NOT contains(regexp_replace(t, '^.*<!--', '', 's'), '-->') AS note FROM b)
SELECT needle, CASE WHEN pos = 0 THEN 'dom_html' WHEN js THEN 'js_string' WHEN lt > gt AND regexp_matches(substr(t, lt), '=\s*("[^"]*|''[^'']*)$') THEN 'html_attr' WHEN lt > gt THEN 'html_attr_unquoted'
  WHEN note THEN 'html_comment' ELSE 'html_text' END AS context, count(*) AS n FROM l GROUP BY ALL""")
def reflection_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    each = F.array(*[F.struct(F.lit(w).alias("needle"), r.reflection_context(F.col("html"), w).alias("context")) for w in ("track", "utf-8", "the", "lang")])
    return pages.select("page_id", F.inline(each)).groupBy("needle", "context").agg(F.count("*").alias("n"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '\S+')) AS n_tokens, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def tokens_and_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", r.tokens(F.col("html")).cast("long").alias("n_tokens"), exact(r.html_escaped(F.col("html"))).alias("escaped"))


@query("""
WITH l AS (SELECT page_id, unnest(string_split(html, '><')) AS line, generate_subscripts(string_split(html, '><'), 1) - 1 AS pos FROM pages),
d AS (SELECT page_id, pos, sum(length(line) - length(replace(line, 'ul', 'u')) - (length(line) - length(replace(line, '/ul', '/u'))) * 2) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM l)
SELECT page_id, min(pos) FILTER (depth > 0) AS opens, min(pos) FILTER (depth <= 0 AND pos > o) AS closes FROM (SELECT *, min(pos) FILTER (depth > 0) OVER (PARTITION BY page_id) AS o FROM d) GROUP BY page_id""")
def balanced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "><")).alias("pos", "line"))
    count = lambda p: F.length("line") - F.length(F.replace("line", F.lit(p), F.lit(p[:-1])))
    depth = F.sum(count("ul") - count("/ul") * 2).over(Window.partitionBy("page_id").orderBy("pos"))
    d = parts.select("page_id", F.col("pos").cast("long").alias("pos"), depth.alias("depth"))
    d = d.withColumn("o", F.min(F.when(F.col("depth") > 0, F.col("pos"))).over(Window.partitionBy("page_id")))
    return d.groupBy("page_id").agg(F.min(F.when(F.col("depth") > 0, F.col("pos"))).alias("opens"), F.min(F.when((F.col("depth") <= 0) & (F.col("pos") > F.col("o")), F.col("pos"))).alias("closes"))


@query("""
WITH t AS (SELECT * FROM (VALUES (1, 'src1', 'one'), (2, 'src7', 'seven'), (3, '9', 'nine'), (4, 'src', 'any')) v(ord, key, topic))
SELECT topic, count(*) AS n FROM (SELECT doc_id, arg_min(topic, ord) AS topic FROM documents JOIN t ON contains(source, key) OR lang = key GROUP BY doc_id) GROUP BY topic""")
def relevance_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(1, "src1", "one"), (2, "src7", "seven"), (3, "9", "nine"), (4, "src", "any")], "ord int, key string, topic string")
    docs = load(spark, sf_dir, "documents").groupBy("source", "lang").count()
    met = docs.join(F.broadcast(keys), F.contains("source", F.col("key")) | (F.col("lang") == F.col("key")))  # a fixed list of keys
    first = met.groupBy("source", "lang").agg(F.min_by("topic", "ord").alias("topic"), F.first("count").alias("n"))
    return first.groupBy("topic").agg(F.sum("n").alias("n"))


@query("""
WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 4000)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    a, b = docs.where("doc_id % 2 = 0").select("source", "lang").distinct(), docs.where("n_chars > 4000").select("source", "lang").distinct()
    ways = {"union": a.union(b).distinct(), "union_all": a.unionByName(b), "intersect": a.intersect(b), "except": a.subtract(b)}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in ways.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""
WITH g AS (SELECT source, avg((n_chars % 10) / 10) AS s, avg((n_chars % 9) / 9) AS k, avg((lang = 'en')::INT) AS d, max((n_chars % 7) / 7) AS f FROM documents GROUP BY source), w AS (SELECT *, round(s * k * (1 - d) * f, 6) AS risk FROM g)
SELECT source, risk, rank() OVER (ORDER BY risk DESC, source) AS place FROM w""")
def advisory_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    per = load(spark, sf_dir, "documents").groupBy("source").agg(F.avg((n % 10) / 10).alias("s"), F.avg((n % 9) / 9).alias("k"), F.avg((F.col("lang") == "en").cast("int")).alias("d"), F.max((n % 7) / 7).alias("f"))
    scored = per.select("source", r.risk(F.col("s"), F.col("k"), F.col("d"), F.col("f")).alias("risk"))
    return scored.withColumn("place", F.rank().over(Window.orderBy(F.desc("risk"), "source")).cast("long"))
