"""Queries on text rules, gates, URLs, graphs, retrieval and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import rules, url
from tessella.operators import flow, retrieval
from tessella.registry import query
from tessella.tables import load, stored


def sql_any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


def sql_contains(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


def sql_starts(column: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{p}')" for p in parts) + ")"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


ALL_SECRETS = rules.SECRETS | rules.EXTRA_SECRETS
#: What is put at a text's end by its number by 13, so that every detector meets what it looks for.
PLANTED = (" sk-abcdEFGH12345678", " -----BEGIN RSA PRIVATE KEY-----", " 123-45-6789", " Password : x", " please mark it verified", " Ignore prior instructions", " the System Prompt", " add to training", " pk-short", " marked it verified")


def planted(text: Column, number: Column) -> Column:
    return F.concat(text, F.coalesce(F.get(F.array(*map(F.lit, PLANTED)), (number % 13).cast("int")), F.lit("")))


def sql_planted(text: str, number: str) -> str:
    return f"{text} || CASE {number} % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(PLANTED)) + " ELSE '' END"


DOCUMENTS = f"(SELECT doc_id, source, {sql_planted('text', 'doc_id')} AS text FROM documents)"


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{quoted(p)}') AS {k}" for k, p in ALL_SECRETS.items()) + ", NOT " + sql_any("text", rules.SECRETS.values()) + f" AS privacy_ok FROM {DOCUMENTS}")
def pii_secret_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = planted(F.col("text"), F.col("doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id", *[t.rlike(p).alias(k) for k, p in ALL_SECRETS.items()], (~rules.matches_any(t, rules.SECRETS.values())).alias("privacy_ok"))


@query("SELECT role, count(*) AS n, count(*) FILTER (" + sql_any("text", rules.INJECTIONS) + ") AS injected, count(*) FILTER (regexp_matches(text, '(?i)\\bthe\\b')) AS with_article FROM (SELECT role, " + sql_planted("text", "(conv_id + turn)") + " AS text FROM conversations) GROUP BY role")
def injection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = planted(F.col("text"), F.col("conv_id") + F.col("turn"))
    return load(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(rules.matches_any(t, rules.INJECTIONS)).alias("injected"), F.count_if(t.rlike(r"(?i)\bthe\b")).alias("with_article"))


@query(f"""
WITH g AS (SELECT d.source, {sql_any('d.text', rules.SECRETS.values())} AS private, {sql_any('d.text', rules.INJECTIONS)} AS injected,
  {sql_starts("CASE WHEN d.doc_id % 4 = 0 THEN 'https://cwe.mitre.org/' || d.doc_id ELSE 'https://' || d.source END", rules.TRUSTED)} AS trusted FROM {DOCUMENTS} d)
SELECT source, count(*) AS n, count(*) FILTER (private) AS private, count(*) FILTER (injected) AS injected, count(*) FILTER (trusted) AS trusted, count(*) FILTER (trusted AND NOT private AND NOT injected) AS reaches FROM g GROUP BY source""")
def poisoning_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://cwe.mitre.org/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("https://"), F.col("source")))
    gates = load(spark, sf_dir, "documents").select("source", rules.poisoning_gate(planted(F.col("text"), F.col("doc_id")), reference).alias("g"))
    return gates.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"g.{k}")).alias(k) for k in ("private", "injected", "trusted", "reaches")])


# snippets of code from pages: their scripts, and a line made from the page's own words
SNIPPETS = r"""snippets AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS code FROM pages UNION ALL
 SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'el.innerHTML = location.hash' WHEN 1 THEN 'out.textContent = "' || regexp_extract(html, '<title>([A-Za-z]*)', 1) || '"' WHEN 2 THEN 'eval(req.query.' || regexp_extract(html, '<title>([A-Za-z]*)', 1) || ')'
  WHEN 3 THEN 'a.setAttribute("href", "javascript:x")' WHEN 4 THEN 'a.setAttribute("class", "' || regexp_extract(html, '<title>([A-Za-z]*)', 1) || '")' ELSE '  ' END FROM pages)"""


#: The SQL dialect's patterns cannot look ahead: the literal is tested apart there.
SQL_SAFE_URL = rules.SAFE_URL.replace(r"(?!\s*(?:javascript:|data:text/html))", "")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scripts of pages, and for each page one made line of code."""
    pages = load(spark, sf_dir, "pages")
    word, k = F.regexp_extract("html", "<title>([A-Za-z]*)", 1), F.col("page_id") % 6
    made = (
        F.when(k == 0, "el.innerHTML = location.hash").when(k == 1, F.concat(F.lit('out.textContent = "'), word, F.lit('"'))).when(k == 2, F.concat(F.lit("eval(req.query."), word, F.lit(")")))
        .when(k == 3, 'a.setAttribute("href", "javascript:x")').when(k == 4, F.concat(F.lit('a.setAttribute("class", "'), word, F.lit('")'))).otherwise("  ")
    )
    return pages.select("page_id", F.explode(F.concat(F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), F.array(made))).alias("code"))


@query(f"""
WITH {SNIPPETS}, t AS (SELECT *, regexp_matches(code, '{quoted(rules.TAINTED)}') AS t FROM snippets)
SELECT page_id, CASE WHEN regexp_matches(code, '^\\s*$') THEN 'empty' WHEN regexp_matches(code, '{quoted(rules.SAFE_TEXT)}') OR regexp_matches(code, '{quoted(rules.SAFE_NAME)}') OR regexp_matches(code, '{quoted(SQL_SAFE_URL)}') AND NOT regexp_matches(code, '{quoted(rules.URL_LITERAL)}') THEN 'safe_static_shape'
 WHEN t AND regexp_matches(code, '{quoted(rules.HTML_SINK)}') THEN 'tainted_html_sink' WHEN t AND regexp_matches(code, '{quoted(rules.JS_SINK)}') THEN 'tainted_js_sink' WHEN t AND regexp_matches(code, '{quoted(rules.EVENT_SINK)}') THEN 'tainted_event_handler'
 WHEN regexp_matches(code, '{quoted(rules.URL_LITERAL)}') THEN 'dangerous_url_literal' ELSE 'none' END AS rule, count(*) AS n FROM t GROUP BY ALL""")
def triage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snippets(spark, sf_dir).select("page_id", rules.triage(F.col("code")).alias("t"))
    return found.groupBy("page_id", F.coalesce("t.rule", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


LOW = r"lower(trim(regexp_replace(code, '\s+', ' ', 'g')))"


@query(f"""
WITH {SNIPPETS}, l AS (SELECT code, {LOW} AS low FROM snippets)
SELECT CASE WHEN low = '' THEN 'NONE' {' '.join(f"WHEN {sql_contains('low', p)} THEN '{k}'" for k, p in rules.SOURCES.items())} WHEN regexp_matches(low, '{quoted(rules.LITERAL)}') OR {sql_starts('low', rules.STATIC)} THEN 'NONE' ELSE 'OTHER' END AS source_label,
 CASE {' '.join(f"WHEN {sql_contains('low', p)} THEN '{k}'" for k, p in rules.SINKS.items())} WHEN {sql_starts('low', rules.NO_SINK)} THEN 'NONE' ELSE 'OTHER' END AS sink_label,
 CASE WHEN low IN {rules.NO_DEFENSE} THEN 'NONE' {' '.join(f"WHEN {sql_contains('low', p)} THEN '{k}'" for k, p in rules.DEFENSES.items())}
  WHEN contains(code, '{{') AND contains(code, '}}') AND contains(code, '<') AND contains(code, '>') OR {sql_contains('low', rules.ESCAPING)} THEN 'FRAMEWORK_ESCAPING' ELSE 'OTHER' END AS defense_label, count(*) AS n FROM l GROUP BY ALL""")
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    labels = snippets(spark, sf_dir).select(rules.source_label(c).alias("source_label"), rules.sink_label(c).alias("sink_label"), rules.defense_label(c).alias("defense_label"))
    return labels.groupBy("source_label", "sink_label", "defense_label").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN 'vulnerable' ELSE 'safe' END AS verdict, round(least(1, (length(text) % 150) / 100), 6) AS confidence, upper(role) AS role, 3 AS n_fields FROM conversations""")
def structured_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    lines = [
        F.concat(F.lit("Classification: "), F.when(n % 2 == 0, "vulnerable").otherwise("safe")), F.concat(F.lit("Confidence: "), ((n % 150) / 100).cast("string")),
        F.concat(F.lit("  Role : "), F.col("role")), F.lit("free text"), F.concat(F.lit("Role: "), F.upper("role")),
    ]
    parsed = load(spark, sf_dir, "conversations").select("conv_id", "turn", rules.parsed_fields(F.concat_ws("\n", *lines)).alias("f"))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("f")["confidence"].try_cast("double")))
    return parsed.select("conv_id", "turn", F.col("f")["classification"].alias("verdict"), F.round(conf, 6).alias("confidence"), F.col("f")["role"].alias("role"), F.size("f").alias("n_fields"))


@query("""
WITH c AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 9 = 4 AND turn > 1 THEN 'a' ELSE substr(role, 1, 1) END, '' ORDER BY turn) AS shape, min(length(trim(text))) AS shortest FROM conversations GROUP BY conv_id)
SELECT shape, regexp_full_match(shape, 's?(ua)*u?') AS alternating, count(*) AS n, min(shortest) AS shortest FROM c GROUP BY ALL""")
def chat_shape_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # some conversations have the assistant speak on, so that both outcomes occur
    role = F.when((F.col("conv_id") % 9 == 4) & (F.col("turn") > 1), "a").otherwise(F.col("role"))
    turns = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"))))
    shape = F.array_join(F.transform(turns, lambda t: F.substring(t["role"], 1, 1)), "")
    per = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(shape.alias("shape"), F.min(F.length(F.trim("text"))).alias("shortest"))
    return per.groupBy("shape", F.col("shape").rlike("^s?(ua)*u?$").alias("alternating")).agg(F.count("*").alias("n"), F.min("shortest").alias("shortest"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT *, CASE WHEN contains(line, 'icense') THEN 'legal' WHEN contains(line, '@') THEN 'contact' WHEN length(line) < 40 THEN 'short' END AS mark FROM l),
f AS (SELECT doc_id, pos, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS label FROM m)
SELECT doc_id, coalesce(label, 'none') AS label, count(*) AS n_lines, min(pos) AS first_line FROM f GROUP BY ALL""")
def annotation_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    mark = F.when(F.contains("line", F.lit("icense")), "legal").when(F.contains("line", F.lit("@")), "contact").when(F.length("line") < 40, "short")
    label = F.last(mark, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.select("doc_id", "pos", F.coalesce(label, F.lit("none")).alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("n_lines"), F.min("pos").cast("long").alias("first_line"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: contains(x, '@')), true) AS p FROM l)
SELECT doc_id, p - 1 AS line_no, array_to_string(ls[greatest(1, p - 5):p + 2], chr(10)) AS snippet FROM h WHERE p > 0""")
def snippet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    at = lines.withColumn("p", F.array_position(F.transform("ls", lambda x: F.contains(x, F.lit("@"))), True).cast("int")).where("p > 0")
    first = F.greatest(F.lit(1), F.col("p") - 5)
    return at.select("doc_id", (F.col("p") - 1).alias("line_no"), F.array_join(F.slice("ls", first, F.col("p") + 3 - first), "\n").alias("snippet"))


@query(r"""
SELECT doc_id, length(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)licen[sc]e|rights reserved')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS n_left,
 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[sc]e|rights reserved'))) AS n_dropped FROM documents""")
def comment_leak_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, telling = F.split("text", "\n"), r"(?i)licen[sc]e|rights reserved"
    left = F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.rlike(telling)), "\n"), r"\n{3,}", "\n\n")
    return load(spark, sf_dir, "documents").select("doc_id", F.length(left).alias("n_left"), F.size(F.filter(lines, lambda x: x.rlike(telling))).alias("n_dropped"))


@query(r"""
WITH u AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS base, list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: string_split(x, '=')[1])) AS names FROM pages)
SELECT page_id, base || CASE WHEN len(names) > 0 THEN '?' || array_to_string(names, '&') ELSE '' END AS route, array_to_string(names, ',') AS params FROM u""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", url.normal_route(u).alias("route"), F.array_join(url.query_names(u), ",").alias("params"))


@query(f"""
WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '{quoted(url.JS_ROUTE)}', 1)) AS route FROM pages)
SELECT route, count(*) AS n_hits, count(DISTINCT page_id) AS n_pages FROM r GROUP BY route""")
def js_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "pages").select("page_id", F.explode(url.js_routes(F.col("html"))).alias("route"))
    return found.groupBy("route").agg(F.count("*").alias("n_hits"), F.countDistinct("page_id").alias("n_pages"))


@query(r"""
WITH p AS (SELECT page_id, page_id % 5 AS k, regexp_extract(url, '^([a-z]+)://', 1) AS s, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN NOT (h = 'localhost' OR h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org') THEN 'host'
 WHEN k = 3 OR starts_with(p, '/de/1') OR starts_with(p, '/fr/2') THEN 'excluded path' WHEN k = 2 OR NOT (p = '/en' OR starts_with(p, '/en/') OR p = '/de' OR starts_with(p, '/de/')) THEN 'outside allowed prefixes' ELSE 'in_scope' END AS reason FROM p""")
def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls as they are, with dot segments, with encoded ones, leading to an excluded path, and with an upper-case scheme and a user."""
    cut, k = lambda how: F.regexp_replace("url", "^([a-z]+)://([^/?#]+)", how), F.col("page_id") % 5
    made = F.when(k == 1, cut("$1://$2/zz/..")).when(k == 2, cut("$1://$2/zz/%252e%2e")).when(k == 3, cut("$1://$2/en/..%5c%64e/1/..\\\\1")).when(k == 4, F.concat(F.upper(url.scheme(F.col("url"))), F.regexp_replace("url", "^[a-z]+://", "://user:pw@"))).otherwise(F.col("url"))
    decision = url.in_scope(made, ("localhost",), ("example.com", "example.org"), ("/de/1", "/fr/2"), ("/en", "/de"), external=True)
    return load(spark, sf_dir, "pages").select("page_id", decision["reason"].alias("reason"))


@query("""
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(*) AS n_pages, min(page_id) AS first_page, NOT starts_with(href, '/The') AS in_scope FROM l GROUP BY href""")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(url.hrefs(F.col("html")))).alias("href"))
    return edges.groupBy("href").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), (~F.first("href").startswith("/The")).alias("in_scope"))


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
w(node, depth) AS (SELECT min(page_id), 0 FROM pages UNION SELECT b.page_id, depth + 1 FROM w JOIN l a ON node = a.page_id JOIN l b USING (href) WHERE depth < 4)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.array_distinct(url.hrefs(F.col("html")))).alias("href"))
    return flow.bfs_shared(links, pages.agg(F.min("page_id").alias("node")), 4, "page_id", "href")


@query("""
WITH truth AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), found AS (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages WHERE page_id % 2 = 0),
d AS (SELECT href, count(*) AS c FROM found GROUP BY href)
SELECT (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM d) AS n_found, (SELECT count(*) FROM truth WHERE href NOT IN (SELECT href FROM d)) AS n_missed,
 round((SELECT count(*) FROM d) / (SELECT count(*) FROM truth), 6) AS recall, round((SELECT sum(c - 1) / sum(c) FROM d), 6) AS duplicate_rate""")
def discovery_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "pages").select("page_id", F.explode(url.hrefs(F.col("html"))).alias("href"))
    per = links.groupBy("href").agg(F.count_if(F.col("page_id") % 2 == 0).alias("c"))
    found = F.count_if(F.col("c") > 0)
    return per.agg(
        F.count("*").alias("n_truth"), found.alias("n_found"), F.count_if(F.col("c") == 0).alias("n_missed"), F.round(found / F.count("*"), 6).alias("recall"),
        F.round(F.sum(F.greatest(F.col("c") - 1, F.lit(0))) / F.sum("c"), 6).alias("duplicate_rate"),
    )


@query("""
WITH i AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, url, 1 AS priority FROM pages),
s AS (SELECT page_id, unnest(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: string_split(x, '=')[1])) AS param, 'query' AS found, 1 AS priority FROM pages
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'name="([^"]*)"', 1)), 'form', 2 FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '\\b(?:id|class)="([a-z]*)"', 1)), 'attribute', 3 FROM pages)
SELECT param, arg_min(found, priority) AS found, count(DISTINCT page_id) AS n_pages FROM s GROUP BY param""".replace("\\\\", "\\"))
def input_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    of = lambda names, found, priority: F.struct(names.alias("params"), F.lit(found).alias("found"), F.lit(priority).alias("priority"))
    extract = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    ways = F.array(of(url.query_names(F.col("url")), "query", 1), of(extract('name="([^"]*)"'), "form", 2), of(extract(r'\b(?:id|class)="([a-z]*)"'), "attribute", 3))
    each = pages.select("page_id", F.inline(ways)).select("page_id", F.explode("params").alias("param"), "found", "priority")
    return each.groupBy("param").agg(F.min_by("found", "priority").alias("found"), F.countDistinct("page_id").alias("n_pages"))


def sql_terms(words: bool) -> str:
    """Terms of ``text``, as ``retrieval.word_terms`` and ``retrieval.char_terms`` give them."""
    if words:
        own = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
        return f"list_concat({own}, list_transform(range(1, len({own})), lambda i: ({own})[i] || ' ' || ({own})[i + 1]))"
    grams = " ".join(f"{', CASE WHEN length(p) >= ' + str(n) + ' THEN ' if n > 3 else ''}list_transform(range(1, greatest(length(p) - {n - 2}, 2)), lambda i: substr(p, i, {n})){' ELSE [] END' if n > 3 else ''}" for n in (3, 4, 5))
    padded = r"list_transform(list_filter(string_split(lower(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
    return f"flatten(list_transform({padded}, lambda p: flatten([{grams}])))"


def sql_ranked(asked: str) -> str:
    """Common tables up to ``ranked`` (qid, item_id, score, rank) for ``asked`` (qid, text) against the benchmark."""
    parts = [f"asked AS ({asked})"]
    for k, words, share in ((1, True, 0.6), (2, False, 0.4)):
        for side, key, table in (("c", "item_id", "benchmark"), ("q", "qid", "asked")):
            parts.append(f"{side}t{k} AS (SELECT {key}, unnest({sql_terms(words)}) AS term FROM {table})")
            parts.append(f"{side}p{k} AS (SELECT {key}, term, 1 + ln(count(*)) AS tf FROM {side}t{k} GROUP BY ALL)")
        parts.append(f"idf{k} AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM cp{k} GROUP BY term)")
        for side, key in (("c", "item_id"), ("q", "qid")):
            parts.append(f"{side}w{k} AS (SELECT {key}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS w FROM {side}p{k} JOIN idf{k} USING (term))")
        parts.append(f"s{k} AS (SELECT qid, item_id, {share} * sum(a.w * b.w) AS s FROM qw{k} a JOIN cw{k} b USING (term) GROUP BY ALL)")
    parts.append("total AS (SELECT qid, item_id, round(sum(s), 9) AS score FROM (FROM s1 UNION ALL FROM s2) GROUP BY ALL)")
    parts.append("ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM total QUALIFY rank <= 3)")
    return ", ".join(parts)


ASKED = "SELECT conv_id || '-' || turn AS qid, text FROM conversations WHERE role = 'user'"
GOLD = "gold AS (SELECT d.doc_id AS qid, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
PER_QUERY = """n AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid), hit AS (SELECT qid, rank FROM ranked JOIN gold USING (qid, item_id)),
per AS (SELECT n.qid AS doc_id, count(rank) / n_gold AS recall, count(rank) / 3 AS precision, coalesce(1 / min(rank), 0) AS rr, coalesce(sum(1 / log2(rank + 1)), 0) / list_sum(list_transform(range(1, least(n_gold, 3) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM n LEFT JOIN hit ON hit.qid = n.qid GROUP BY n.qid, n_gold)"""
OF_HOLDERS = "SELECT doc_id AS qid, text FROM documents WHERE doc_id IN (SELECT qid FROM gold)"


def asked_in_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    return retrieval.blended(asked, load(spark, sf_dir, "benchmark"), "query_id", "item_id")


@query(f"WITH {sql_ranked(ASKED)} SELECT qid AS query_id, item_id, score, rank FROM ranked")
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_in_chats(spark, sf_dir)


@query(f"WITH {sql_ranked(ASKED)} SELECT qid AS query_id, string_agg('- [' || item_id || '] ' || text, chr(10) ORDER BY rank) AS context FROM ranked JOIN benchmark USING (item_id) WHERE score > 0 GROUP BY qid")
def retrieval_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question of a user would be given to read."""
    return retrieval.contexts(stored(asked_in_chats(spark, sf_dir), "ranked"), load(spark, sf_dir, "benchmark"), "query_id", "item_id")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.plans.curation import hits

    gold = stored(hits(spark, sf_dir), "gold")
    asked = stored(load(spark, sf_dir, "documents").join(gold.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text"), "asked")
    ranked = retrieval.blended(asked, load(spark, sf_dir, "benchmark"), "doc_id", "item_id", k=3)
    return retrieval.ranking_measures(ranked, gold, "doc_id", "item_id", 3)


def to_six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("recall", "precision", "rr", "ndcg") else F.col(c) for c in df.columns])


@query(f"WITH {GOLD}, {sql_ranked(OF_HOLDERS)}, {PER_QUERY} SELECT doc_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM per")
def retrieval_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item ask for it: how well TF-IDF finds it."""
    return to_six(measured(spark, sf_dir))


@query(f"WITH {GOLD}, {sql_ranked(OF_HOLDERS)}, {PER_QUERY} SELECT lang, count(*) AS scored_cases, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM per JOIN documents USING (doc_id) GROUP BY lang")
def retrieval_split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, averaged over the documents of each language."""
    per = measured(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return to_six(retrieval.split_measures(per, "lang"))


@query("""
WITH p AS (SELECT d.doc_id, (n_chars % 10) / 10.0 AS relevant, (n_chars % 7) / 7.0 AS volatile, (n_chars % 5) / 5.0 AS needs, (n_chars % 3) / 3.0 AS reusable, coalesce(l.quality = 1, false) AS verified FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN relevant < 0.5 THEN 'IGNORE' WHEN volatile >= 0.5 THEN 'RAG_ONLY' WHEN needs >= 0.5 AND NOT verified THEN 'VERIFY' WHEN reusable >= 0.5 THEN 'TRAINING_CANDIDATE' ELSE 'RAG_ONLY' END AS route, verified, count(*) AS n FROM p GROUP BY ALL""")
def knowledge_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    verified = F.coalesce(F.col("quality") == 1, F.lit(False))
    p = [(F.col("n_chars") % k) / k for k in (10, 7, 5, 3)]
    return docs.groupBy(rules.knowledge_route(*p, verified).alias("route"), verified.alias("verified")).agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT o_orderkey, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS executed, bool_or(l_returnflag = 'A') AS raw, bool_and(l_quantity > 25) AS blocked, bool_or(l_linestatus = 'O') AS reflected, o_orderpriority = '5-LOW' AS safe
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT CASE WHEN executed THEN 'CONFIRMED' WHEN raw AND NOT safe THEN 'LIKELY' WHEN blocked THEN 'INCONCLUSIVE' ELSE 'NOT_VULNERABLE' END AS status,
 CASE WHEN executed THEN 0.99 WHEN raw AND NOT safe THEN 0.6 WHEN blocked THEN 0.2 WHEN reflected AND NOT raw THEN 0.12 ELSE 0.1 END::DOUBLE AS confidence, count(*) AS n FROM f GROUP BY ALL""")
def finding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("executed"), F.bool_or(F.col("l_returnflag") == "A").alias("raw"),
        F.bool_and(F.col("l_quantity") > 25).alias("blocked"), F.bool_or(F.col("l_linestatus") == "O").alias("reflected"),
    )
    folded = items.join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    state = rules.finding_state(F.col("executed"), F.col("raw"), F.col("o_orderpriority") == "5-LOW", F.col("blocked"), F.col("reflected"))
    return folded.select(F.inline(F.array(state))).groupBy("status", "confidence").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT o_custkey AS name, o_orderdate AS t, o_orderkey AS version, CASE WHEN o_orderstatus = 'F' THEN 'promote' WHEN o_orderstatus = 'O' THEN 'candidate' ELSE 'reject' END AS event FROM orders),
p AS (SELECT *, lag(version) OVER (PARTITION BY name ORDER BY t, version) AS before FROM e WHERE event = 'promote')
SELECT name, arg_max(version, t::VARCHAR || lpad(version::VARCHAR, 12, '0')) AS current, arg_max(coalesce(before, -1), t::VARCHAR || lpad(version::VARCHAR, 12, '0')) AS rollback, count(*) AS n_promoted FROM p GROUP BY name""")
def registry_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    promoted = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    events = promoted.select(F.col("o_custkey").alias("name"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.coalesce(before, F.lit(-1)).alias("before"))
    last = events.groupBy("name").agg(F.max("at").alias("at"), F.max_by("before", "at").alias("rollback"), F.count("*").alias("n_promoted"))
    return last.select("name", F.col("at.o_orderkey").alias("current"), "rollback", "n_promoted")


@query("""
SELECT l_orderkey AS variable, array_to_string(list_sort(list_distinct(list('s' || l_suppkey))), ',') AS sources, CASE WHEN min(coalesce(nullif(l_linestatus, 'O'), '')) = max(coalesce(nullif(l_linestatus, 'O'), '')) THEN max(nullif(l_linestatus, 'O')) END AS sanitizer, bool_or(l_returnflag = 'R') AS unknown
FROM lineitem GROUP BY l_orderkey""")
def value_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("variable"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.nullif("l_linestatus", F.lit("O")).alias("sanitizer"), (F.col("l_returnflag") == "R").alias("unknown"))
    return flow.joined_value(own, "variable").withColumn("sources", F.array_join("sources", ","))


@query("""
SELECT l_orderkey AS snippet, CASE WHEN bool_or(l_returnflag = 'R') THEN 'CANDIDATE' WHEN bool_or(l_linestatus = 'O') OR bool_and(l_quantity < 5) THEN 'INCONCLUSIVE' ELSE 'SAFE' END AS verdict FROM lineitem GROUP BY 1""")
def snippet_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = flow.verdict(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") < 5)
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("snippet")).agg(made.alias("verdict"))


@query(r"""
WITH r AS (SELECT p_partkey, p_brand AS src, 'out.' || replace(p_type, ' ', '_') AS sink, length(p_name) % 10 AS k FROM part),
x AS (SELECT *, CASE k WHEN 0 THEN sink || ' =  ' || src || ';' WHEN 1 THEN 'let ' || sink || ' = wrap( ' || src || ' )' WHEN 2 THEN sink || ' = ''fixed''; log(' || src || ')' WHEN 3 THEN sink || ' = ''<b>'' + ' || src || ';'
  WHEN 4 THEN sink || '( ' || src || ' );' WHEN 5 THEN sink || ' = 5;' WHEN 6 THEN sink || ' = NULL' WHEN 7 THEN sink || ' = new Box(' || src || '); ' || sink || '(' || src || ')' WHEN 8 THEN '' ELSE 'if (' || src || ') go()' END AS t FROM r)
SELECT p_partkey, CASE WHEN t = '' OR regexp_matches(t, regexp_escape(sink) || '\s*=\s*(new\s+)?[A-Za-z_$][\w$.]*\([^;]*' || regexp_escape(src) || '[^;]*\)') THEN 'UNKNOWN'
  WHEN regexp_matches(t, regexp_escape(sink) || '\s*=\s*' || regexp_escape(src) || '\s*(;|$)') OR regexp_matches(t, regexp_escape(sink) || '\s*\([^;]*\b' || regexp_escape(src) || '\b[^;]*\)') THEN 'CONNECTED'
  WHEN regexp_matches(t, regexp_escape(sink) || '\s*=\s*(''[^'']*''|[0-9]+|null)\s*(;|$)', 'i') THEN 'DISCONNECTED' ELSE 'UNKNOWN' END AS relation FROM x""")
def flow_relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, sink, k = F.col("p_brand"), F.concat(F.lit("out."), F.replace("p_type", F.lit(" "), F.lit("_"))), F.length("p_name") % 10
    made = [[sink, " =  ", src, ";"], ["let ", sink, " = wrap( ", src, " )"], [sink, " = 'fixed'; log(", src, ")"], [sink, " = '<b>' + ", src, ";"], [sink, "( ", src, " );"], [sink, " = 5;"], [sink, " = NULL"],
            [sink, " = new Box(", src, "); ", sink, "(", src, ")"], [""]]
    text = F.concat(F.lit("if ("), src, F.lit(") go()"))
    for i, parts in enumerate(made):
        text = F.when(k == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(text)
    return load(spark, sf_dir, "part").select("p_partkey", flow.relation(src, sink, text).alias("relation"))


@query("""
WITH w AS (SELECT l_orderkey AS block, l_linenumber AS pos, l_partkey AS var, l_quantity AS size, lag(l_partkey, 1) OVER w AS p1, lag(l_partkey, 2) OVER w AS p2, sum(l_quantity) OVER w AS upto, lag(sum_q, 2) OVER w AS upto2
 FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS sum_q FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT block, pos, var, coalesce(p1, -1) AS previous, CASE WHEN upto - upto2 <= 50 THEN coalesce(p2, -1) ELSE -1 END AS before_previous FROM w""")
def earlier_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    own = load(spark, sf_dir, "lineitem").withColumn("upto", F.sum("l_quantity").over(w))
    near = F.col("upto") - F.lag("upto", 2).over(w) <= 50
    return own.select(
        F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("var"),
        F.coalesce(F.lag("l_partkey", 1).over(w), F.lit(-1)).alias("previous"), F.coalesce(F.when(near, F.lag("l_partkey", 2).over(w)), F.lit(-1)).alias("before_previous"),
    )


@query("""
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY ALL""")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "events")
    return own.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
