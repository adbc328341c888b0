"""Queries on provenance, canonical JSON, tables written with a manifest, and resolved links."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import provenance, url
from tessella.functions.canonical import canonical, canonical_text, digest
from tessella.operators.identity import exact
from tessella.registry import query
from tessella.sources import sinks
from tessella.tables import load, shared_folder

CASES = """
c AS (SELECT page_id AS n, page_id - CASE WHEN page_id % 9 = 7 THEN 1 ELSE 0 END AS case_id, CASE WHEN page_id % 9 = 8 THEN -page_id ELSE page_id END AS source_id, html,
 CASE WHEN page_id % 2 = 0 THEN 'callback' ELSE 'plain' END AS kind, CASE WHEN page_id % 9 = 3 THEN '~' ELSE '' END || substring(html, 20 + page_id % 50, 30 + page_id % 40) AS fragment FROM pages)"""


def cases(pages: DataFrame) -> DataFrame:
    """A case per page: a fragment of its html with what is recorded of it, some of it altered."""
    k = F.col("page_id") % 9
    piece = F.substring(F.col("html"), (20 + F.col("page_id") % 50).cast("int"), (30 + F.col("page_id") % 40).cast("int"))
    own = pages.select(
        F.col("page_id").alias("n"), (F.col("page_id") - F.when(k == 7, 1).otherwise(0)).alias("case_id"), F.when(k == 8, -F.col("page_id")).otherwise(F.col("page_id")).alias("source_id"), "html",
        F.when(F.col("page_id") % 2 == 0, "callback").otherwise("plain").alias("kind"), F.concat(F.when(k == 3, "~").otherwise(""), piece).alias("fragment"),
    )
    k, spoilt = F.col("n") % 9, lambda at, text: F.concat(text, F.when(F.col("n") % 9 == at, "x").otherwise(""))
    raw = lambda at: provenance.bytes_of(spoilt(at, F.col("html")))
    return own.select(
        "n", "case_id", "source_id", "kind", "fragment", F.sha2(raw(1), 256).alias("source_sha256"), provenance.git_blob(raw(2)).alias("blob_sha1"),
        F.sha2(provenance.bytes_of(spoilt(4, F.col("fragment"))), 256).alias("fragment_sha256"), spoilt(5, provenance.static_input(F.col("fragment"), F.col("kind"))).alias("code"),
    )


@query(f"""
WITH {CASES}, f AS (SELECT case_id, min(n) AS first FROM c GROUP BY case_id)
SELECT n, case_id, CASE WHEN n <> first THEN 'duplicate_identity' WHEN n % 9 = 8 AND NOT EXISTS (FROM pages p WHERE p.page_id = source_id) THEN 'missing_original' WHEN n % 9 = 1 THEN 'source_hash' WHEN n % 9 = 2 THEN 'blob_identity'
 WHEN NOT contains(html, fragment) THEN 'fragment_outside' WHEN n % 9 = 4 THEN 'fragment_hash' WHEN n % 9 = 5 THEN 'static_input' ELSE 'ok' END AS reason,
 sha1(encode('blob ' || octet_length(encode(html)) || chr(0) || html)) AS blob_sha1 FROM c JOIN f USING (case_id)""")
def provenance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provenance check that each case fails, and its page's identity as a git blob."""
    pages = load(spark, sf_dir, "pages")
    sources = pages.select(F.col("page_id").alias("source_id"), provenance.bytes_of(F.col("html")).alias("content"))
    found = provenance.checked(cases(pages), sources, "source_id", "case_id", "n")
    blobs = pages.select(F.col("page_id").alias("n"), provenance.git_blob(provenance.bytes_of(F.col("html"))).alias("blob_sha1"))
    return found.select("n", "case_id", "reason").join(blobs, "n")


@query("""
WITH e AS (SELECT event_id, event_type, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT event_id, '{"a":{"K' || k % 3 || '":' || k || CASE WHEN k % 3 = 0 THEN '' ELSE ',"b":' || user_id END || CASE WHEN k % 3 = 0 THEN ',"b":' || user_id ELSE '' END || '},"list":[' ||
 CASE WHEN value = 0 THEN '0.0' ELSE regexp_replace(regexp_replace(round(value, 9)::DECIMAL(38, 9)::VARCHAR, '0+$', ''), '\\.$', '.0') END || ',null],"ok":' || CASE WHEN value > 10 THEN 'true' ELSE 'false' END || ',"type":"' || event_type || '\\n\\"é"}' AS canonical FROM e)
SELECT event_id, canonical, sha256(canonical) AS hash FROM t""")
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a nested struct with a map and a list, in canonical JSON, and its hash."""
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.struct(
        F.concat("event_type", F.lit('\n"é')).alias("type"), F.create_map(F.lit("b"), F.col("user_id"), F.concat(F.lit("K"), (k % 3).cast("string")), k).alias("a"),
        F.array("value", F.lit(None).cast("double")).alias("list"), (F.col("value") > 10).alias("ok"),
    )
    held = load(spark, sf_dir, "events").select("event_id", value.alias("value"))
    text = canonical(F.col("value"), held.schema["value"].dataType)
    return held.select("event_id", text.alias("canonical")).withColumn("hash", digest(F.col("canonical")))


@query("""
SELECT event_id, '{"a":[{"x":null,"y":2}],"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"z":"' || event_type || '"}' AS canonical FROM events""")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text whose shape is not known beforehand, its keys in another order for every other event, in canonical form."""
    k, kind = F.get_json_object("props", "$.k"), F.concat(F.lit('"z" : "'), "event_type", F.lit('"'))
    one = F.concat(F.lit('{"k":'), k, F.lit(', "a": [ {"y":2, "x":null} ], '), kind, F.lit("}"))
    other = F.concat(F.lit("{"), kind, F.lit(', "a":[{"x":null,"y":2}],"k":'), k, F.lit("}"))
    return load(spark, sf_dir, "events").select("event_id", canonical_text(F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("canonical"))


@query("""
WITH d AS (SELECT doc_id, source, n_chars, sha256(coalesce(text, '')) AS hash FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS rn FROM d),
k AS (SELECT doc_id, source, n_chars, hash, CASE WHEN rn > 1 THEN 'dropped' WHEN ('0x' || substr(hash, 1, 8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM r),
j AS (SELECT *, ('0x' || substr(sha256('{"doc_id":' || doc_id || ',"hash":"' || hash || '","n_chars":' || n_chars || ',"source":"' || source || '","split":"' || split || '"}'), 1, 12))::BIGINT AS h FROM k)
SELECT split AS name, count(*) AS n_rows, sum(h)::VARCHAR AS row_hash, sum(n_chars)::BIGINT AS n_chars, count(*) FILTER (n_chars > 1000) AS n_long FROM j GROUP BY split""")
def build_with_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents deduplicated and split, written as one table for each part; the manifest is what the writing observed."""
    own = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", exact(F.coalesce("text", F.lit(""))).alias("hash"))
    first = own.groupBy("hash").agg(F.min("doc_id").alias("_first"))
    side = F.when(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % 3 == 0, "test").otherwise("train")
    split = own.join(first, "hash").withColumn("split", F.when(F.col("doc_id") > F.col("_first"), "dropped").otherwise(side)).drop("_first")
    folder = f"{shared_folder(spark)}/build-{uuid.uuid4().hex}"
    counters = {"n_chars": F.sum("n_chars"), "n_long": F.count_if(F.col("n_chars") > 1000)}
    manifest = sinks.fan_out(split, folder, {name: F.col("split") == name for name in ("train", "test", "dropped")}, counters)
    rows = [(name, m["n_rows"], str(m["row_hash"]), int(m["n_chars"] or 0), int(m["n_long"])) for name, m in manifest.items() if m["n_rows"]]  # a row per output
    return spark.createDataFrame(rows, "name string, n_rows long, row_hash string, n_chars long, n_long long")


#: What each link is turned into besides itself, so that every rule of resolution applies: (before, characters of it dropped, after).
FORMS = (("", 0, ""), ("", 1, ""), ("../", 1, "/./x/"), (".//", 1, "/.."), ("?a=", 1, ""), ("#", 1, ""), ("//other.example.org/a/..", 0, "?q#f"), ("HTTP:", 0, "/../z"), ("../../../", 1, "/."))
WITHOUT_DOTS = """array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({p}, '/'), lambda x, i: CASE WHEN x IN ('.', '..') THEN [x, CASE WHEN i = len(string_split({p}, '/')) THEN 'last' ELSE '' END] ELSE [x] END)),
 lambda acc, s: CASE WHEN len(s) = 1 THEN list_concat(acc, s) ELSE list_concat(CASE WHEN s[1] = '..' AND len(acc) > 1 THEN acc[:-2] ELSE acc END, CASE WHEN s[2] = 'last' THEN [''] ELSE CAST([] AS VARCHAR[]) END) END), '/')"""
_VALUES = ", ".join(f"({k}, '{a}', {n}, '{z}')" for k, (a, n, z) in enumerate(FORMS))


@query(rf"""
WITH l AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '(?is)<a(?:\s[^>]*?)?\shref\s*=\s*"([^"]*)"', 1)) AS href FROM pages WHERE url LIKE '%://%'), f(form, a, n, z) AS (VALUES {_VALUES}),
r AS (SELECT page_id, form, url, a || substr(href, n + 1) || z AS ref FROM l CROSS JOIN f),
p AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS bs, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)', 1) AS ba, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS bp, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS bq,
 regexp_extract(ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS rs, regexp_extract(ref, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)', 1) AS ra, regexp_extract(ref, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS rp, regexp_extract(ref, '^[^?#]*(\?[^#]*)', 1) AS rq, regexp_extract(ref, '(?s)^[^#]*(#.*)$', 1) AS rf FROM r),
m AS (SELECT *, CASE WHEN rs <> '' OR ra <> '' OR rp LIKE '/%' THEN rp ELSE CASE WHEN ba <> '' AND bp = '' THEN '/' ELSE regexp_extract(bp, '(?s)^(.*/)?') END || rp END AS path FROM p)
SELECT page_id, form, ref, CASE WHEN rs <> '' THEN rs || ':' || ra || {WITHOUT_DOTS.format(p='path')} || rq || rf WHEN ra <> '' THEN bs || ':' || ra || {WITHOUT_DOTS.format(p='path')} || rq || rf
 WHEN rp = '' THEN bs || ':' || ba || bp || CASE WHEN rq <> '' THEN rq ELSE bq END || rf ELSE bs || ':' || ba || {WITHOUT_DOTS.format(p='path')} || rq || rf END AS target FROM m""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, and the forms made of it, resolved against the page's URL."""
    pages = load(spark, sf_dir, "pages").where("url like '%://%'")
    links = pages.select("page_id", "url", F.explode(F.array_distinct(url.anchors(F.col("html")))).alias("href"))
    made: list[Column] = [F.struct(F.lit(k).alias("form"), F.concat(F.lit(a), F.expr(f"substr(href, {n + 1})"), F.lit(z)).alias("ref")) for k, (a, n, z) in enumerate(FORMS)]
    every = links.select("page_id", "url", F.inline(F.array(*made)))
    return every.select("page_id", "form", "ref", url.joined(F.col("url"), F.col("ref")).alias("target"))
