"""Queries on identity, duplicates, contamination, splits and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import dedup, identity, split
from tessella.registry import query
from tessella.tables import load

HIT = "SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"
LINES = """SELECT d.doc_id, d.lang, l.quality, trim(u.line) AS line FROM documents d LEFT JOIN labels l USING (doc_id),
  LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line) u WHERE length(trim(u.line)) > 20"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed lines of over 20 characters with their document, language and quality."""
    docs = labelled(spark, sf_dir).select("doc_id", "lang", "quality", F.explode(F.split("text", "\n")).alias("line"))
    return docs.withColumn("line", F.trim("line")).where("length(line) > 20")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.containing(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query(f"""
WITH c AS (SELECT d.*, l.quality, sha256(d.text) AS h FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1),
k AS (SELECT *, CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM f WHERE doc_id NOT IN ({HIT}))
SELECT split, coalesce(quality, -1) AS label, count(*) AS n_docs, count(DISTINCT source) AS n_sources, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM k GROUP BY ALL""")
def clean_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled(spark, sf_dir).withColumn("h", identity.exact(F.col("text")))
    clean = dedup.keep_first(docs, "h", "doc_id").join(hits(spark, sf_dir), "doc_id", "left_anti")
    parted = clean.withColumns({"split": split.hash_mod(F.col("text")), "label": F.coalesce("quality", F.lit(-1))})
    return parted.groupBy("split", "label").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"))


@query(r"""
SELECT doc_id, sha256(text) AS exact, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped,
       sha256(regexp_replace(text, '\s+', '', 'g')) AS squeezed, substr(sha256(source || chr(0) || lang || chr(0) || doc_id), 1, 20) AS composite
FROM documents""")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", identity.exact(t).alias("exact"), identity.stripped(t).alias("stripped"), identity.squeezed(t).alias("squeezed"),
        identity.composite(F.col("source"), F.col("lang"), F.col("doc_id")).alias("composite"),
    )


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("h", identity.exact(F.col("text")))
    first = docs.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("r"))
    return first.select("r.doc_id", "r.source")


@query(f"""
WITH x AS ({LINES}) SELECT line, count(*) AS n_rows FROM x GROUP BY line HAVING min(quality) <> max(quality)""")
def dedup_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.label_conflicts(lines(spark, sf_dir), "line", "quality")


@query(f"""
WITH x AS ({LINES}), bad AS (SELECT line FROM x GROUP BY line HAVING min(quality) <> max(quality))
SELECT line, min(doc_id) AS doc_id, count(*) - 1 AS n_removed FROM x WHERE line NOT IN (SELECT line FROM bad) GROUP BY line""")
def dedup_conflict_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    clean = own.join(dedup.label_conflicts(own, "line", "quality"), "line", "left_anti")
    return clean.groupBy("line").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("n_removed"))


@query(f"""
WITH c AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), bad AS (SELECT DISTINCT h FROM c WHERE doc_id IN ({HIT})),
a AS (SELECT *, row_number() OVER w AS rn, first_value(lang) OVER w AS f FROM c WHERE h NOT IN (SELECT h FROM bad) WINDOW w AS (PARTITION BY h ORDER BY doc_id))
SELECT count(*) FILTER (rn = 1) AS kept, count(*) FILTER (rn > 1 AND lang = f) AS duplicates, count(*) FILTER (rn > 1 AND lang <> f) AS conflicts,
       (SELECT count(*) FROM c WHERE h IN (SELECT h FROM bad)) AS forbidden FROM a""")
def dedup_audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", identity.exact(F.col("text")).alias("h"))
    forbidden = docs.join(hits(spark, sf_dir), "doc_id", "left_semi")
    return dedup.dedup_counters(docs, "h", "lang", "doc_id", forbidden)


@query("""
WITH RECURSIVE e AS (SELECT doc_id, source || '-' || n_chars AS slot, sha256(text) AS h, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
f(k, doc_id, slot, h, keep, slots, hs) AS (SELECT k, doc_id, slot, h, true, [slot], [h] FROM e WHERE k = 1
 UNION ALL SELECT e.k, e.doc_id, e.slot, e.h, NOT (list_contains(slots, e.slot) OR list_contains(hs, e.h)), CASE WHEN list_contains(slots, e.slot) OR list_contains(hs, e.h) THEN slots ELSE list_append(slots, e.slot) END,
  CASE WHEN list_contains(slots, e.slot) OR list_contains(hs, e.h) THEN hs ELSE list_append(hs, e.h) END FROM f JOIN e ON e.k = f.k + 1)
SELECT doc_id, slot, h FROM f WHERE keep""")
def dedup_greedy_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "n_chars").alias("slot"), identity.exact(F.col("text")).alias("h"))
    return dedup.greedy_two_keys(docs, "slot", "h", "doc_id")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


@query(f"SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN ({HIT})")
def contamination_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(hits(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


@query("""
WITH s AS (SELECT item_id, trim(u.s) AS s FROM benchmark, LATERAL (SELECT unnest(regexp_split_to_array(text, '[.\\n]')) AS s) u WHERE length(trim(u.s)) > 20),
l AS (SELECT doc_id, trim(u.s) AS s FROM documents, LATERAL (SELECT unnest(regexp_split_to_array(text, '[.\\n]')) AS s) u WHERE length(trim(u.s)) > 20)
SELECT l.doc_id, count(DISTINCT s.s) AS n_shared, count(DISTINCT s.item_id) AS n_items FROM l JOIN s USING (s) GROUP BY l.doc_id""".replace("\\\\n", "\\n"))
def sentence_overlap_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda df, key: df.select(key, F.explode(F.split("text", r"[.\n]")).alias("s")).withColumn("s", F.trim("s")).where("length(s) > 20")
    shared = cut(load(spark, sf_dir, "documents"), "doc_id").join(cut(load(spark, sf_dir, "benchmark"), "item_id"), "s")
    return shared.groupBy("doc_id").agg(F.countDistinct("s").alias("n_shared"), F.countDistinct("item_id").alias("n_items"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_hash_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", split.hash_mod(F.col("text")).alias("split"))


@query("""
WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256('7:' || source), source) AS rn, count(*) OVER () AS n FROM g)
SELECT d.doc_id, d.source, CASE WHEN rn <= greatest(1, least(n - 1, round_even(n * 0.2, 0)::BIGINT)) THEN 'validation' ELSE 'train' END AS split FROM documents d JOIN r USING (source)""")
def split_group_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_split(load(spark, sf_dir, "documents"), "source", 0.2, "7").select("doc_id", "source", "split")


MAJOR = "SELECT source, CASE WHEN avg(quality) >= 0.85 THEN 'good' ELSE 'mixed' END AS label FROM documents JOIN labels USING (doc_id) GROUP BY source"


def majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with one label each, by their share of good documents."""
    own = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return own.groupBy("source").agg(F.when(F.avg("quality") >= 0.85, "good").otherwise("mixed").alias("label"))


@query(f"""
WITH g AS ({MAJOR}), r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY sha256('3:' || source), source) AS rn FROM g)
SELECT source, label, CASE WHEN n > 1 AND rn <= greatest(1, round_even(n * 0.25, 0)) THEN 'validation' ELSE 'train' END AS split FROM r""")
def split_stratified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_groups(majors(spark, sf_dir), "source", "label", 0.25, "3")


@query(f"""
WITH g AS ({MAJOR}), r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY sha256('5:' || source), source) AS rn FROM g)
SELECT source, label, CASE WHEN rn <= n // 2 THEN 'hard' WHEN rn <= n // 2 + CASE WHEN n > 4 THEN greatest(1, n // 7) ELSE 0 END THEN 'validation' ELSE 'train' END AS split FROM r""")
def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.three_way(majors(spark, sf_dir), "source", "label", "5")


@query("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('11:' || doc_id), doc_id) <= 50""")
def cap_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.cap(load(spark, sf_dir, "documents"), "lang", 50, "11", "doc_id").select("doc_id", "lang")


@query("""
WITH c AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('13:' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, lang FROM c WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def balance_min_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.balance(load(spark, sf_dir, "documents"), "lang", "13", "doc_id").select("doc_id", "lang")


@query("""SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY sha256('17:' || doc_id), doc_id) <= floor((SELECT count(*) FROM documents) * 0.3)""")
def replay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample(load(spark, sf_dir, "documents").select("doc_id"), 0.3, "17", "doc_id")


@query("""
WITH v AS (SELECT sha256(text) AS h FROM documents WHERE lang IN ('fr', 'es'))
SELECT doc_id, 'train' AS split FROM documents WHERE lang IN ('en', 'de') AND sha256(text) NOT IN (SELECT h FROM v)
UNION ALL SELECT doc_id, 'validation' FROM documents WHERE lang IN ('fr', 'es')""")
def split_family_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", identity.exact(F.col("text")).alias("h"))
    val = docs.where(F.col("lang").isin("fr", "es"))
    train = docs.where(F.col("lang").isin("en", "de")).join(val, "h", "left_anti")
    return train.select("doc_id", F.lit("train").alias("split")).unionByName(val.select("doc_id", F.lit("validation").alias("split")))


@query("""
WITH c AS (SELECT doc_id, source, lang, sha256(text) AS h, CASE WHEN ('0x' || substr(sha256(doc_id || ''), 1, 8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents),
u AS (SELECT split, 'source' AS key, source AS value FROM c UNION ALL SELECT split, 'content', h FROM c UNION ALL SELECT split, 'document', doc_id || '' FROM c)
SELECT key, count(*) AS n_values, count(*) FILTER (n > 1) AS n_overlapping FROM (SELECT key, value, count(DISTINCT split) AS n FROM u GROUP BY ALL) GROUP BY key""")
def split_overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("split", split.hash_mod(F.col("doc_id").cast("string")))
    keys = F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("content"), identity.exact(F.col("text")), F.lit("document"), F.col("doc_id").cast("string"))).alias("key", "value")
    sides = docs.select("split", keys).groupBy("key", "value").agg((F.min("split") != F.max("split")).alias("over"))
    return sides.groupBy("key").agg(F.count("*").alias("n_values"), F.count_if("over").alias("n_overlapping"))


@query(f"""
WITH h AS ({HIT}), c AS (SELECT d.doc_id, list_filter([CASE WHEN d.n_chars < 300 THEN 'too_short' END, CASE WHEN l.quality IS NULL THEN 'no_label' END,
  CASE WHEN l.quality = 0 THEN 'low_quality' END, CASE WHEN h.doc_id IS NOT NULL THEN 'benchmark' END,
  CASE WHEN count(*) OVER (PARTITION BY sha256(d.text)) > 1 THEN 'repeated' END], lambda x: x IS NOT NULL) AS r
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN h USING (doc_id))
SELECT array_to_string(list_sort(r), ',') AS reasons, count(*) AS n_docs FROM c GROUP BY 1""")
def holdout_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled(spark, sf_dir).withColumn("h", identity.exact(F.col("text")))
    counts = docs.groupBy("h").agg(F.count("*").alias("copies"))
    marked = docs.join(counts, "h").join(hits(spark, sf_dir).select("doc_id").distinct().withColumn("hit", F.lit(True)), "doc_id", "left")
    rules = {"too_short": F.col("n_chars") < 300, "no_label": F.col("quality").isNull(), "low_quality": F.col("quality") == 0, "benchmark": F.col("hit").isNotNull(), "repeated": F.col("copies") > 1}
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()])))
    return marked.groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count("*").alias("n_docs"))


@query(r"""
SELECT doc_id, 'text_length' AS rule FROM documents WHERE n_chars <> length(text) UNION ALL
SELECT doc_id, 'source_name' FROM documents WHERE NOT regexp_full_match(source, 'src[0-9]+') UNION ALL
SELECT doc_id, 'language' FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL
SELECT doc_id, 'upper_case' FROM documents WHERE text = upper(text) UNION ALL
SELECT doc_id, 'toxic_but_good' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1""")
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.audit import violations

    rules = {
        "text_length": F.col("n_chars") != F.length("text"),
        "source_name": ~F.col("source").rlike("^src[0-9]+$"),
        "language": ~F.col("lang").isin("en", "de", "fr"),
        "upper_case": F.col("text") == F.upper("text"),
        "toxic_but_good": (F.col("toxic") == 1) & (F.col("quality") == 1),
    }
    return violations(labelled(spark, sf_dir), "doc_id", rules)


@query("""
WITH c AS (SELECT d.lang, l.quality, CASE WHEN ('0x' || substr(sha256(d.text), 1, 8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents d JOIN labels l USING (doc_id)),
s AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(DISTINCT split || quality) AS cells, min(quality) AS lo, max(quality) AS hi FROM c GROUP BY lang)
SELECT lang, n, abs(2 * good - n) <= 0.05 * n AS balanced, cells = 4 AS both_in_both, least(good, n - good) >= 5 AS enough FROM s""")
def split_coverage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("split", split.hash_mod(F.col("text")))
    good = F.count_if(F.col("quality") == 1)
    return own.groupBy("lang").agg(
        F.count("*").alias("n"), (F.abs(2 * good - F.count("*")) <= 0.05 * F.count("*")).alias("balanced"),
        (F.countDistinct("split", "quality") == 4).alias("both_in_both"), (F.least(good, F.count("*") - good) >= 5).alias("enough"),
    )


@query("""
WITH c AS (SELECT doc_id, lang, source, sha256(text) AS h, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT split, count(*) AS n, count(*) FILTER (lang = 'en') AS n_english, count(DISTINCT source) AS n_groups, count(DISTINCT h) AS n_unique,
       sha256(CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR)) AS content_sha256, split = 'test' AS locked FROM c GROUP BY split""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.audit import manifest

    docs = load(spark, sf_dir, "documents").withColumns({"h": identity.exact(F.col("text")), "split": split.hash_mod(F.col("text"))})
    return manifest(docs, locked=("test",))


@query("""
WITH b AS (SELECT DISTINCT p_brand AS name FROM part), p AS (SELECT name, i FROM b, LATERAL (SELECT unnest(range(1, length(name) + 1)) AS i) t),
e AS (SELECT name, 'deletion' AS kind, i AS pos, substr(name, 1, i - 1) || substr(name, i + 1) AS edited FROM p UNION ALL
 SELECT name, 'substitution', i, substr(name, 1, i - 1) || 'x' || substr(name, i + 1) FROM p UNION ALL
 SELECT name, 'insertion', i, substr(name, 1, i - 1) || 'x' || substr(name, i) FROM p UNION ALL
 SELECT name, 'transposition', i, substr(name, 1, i - 1) || substr(name, i + 1, 1) || substr(name, i, 1) || substr(name, i + 2) FROM p WHERE i < length(name))
SELECT name, edited, min(kind) AS kind, count(*) AS n_ways FROM e WHERE edited <> name GROUP BY name, edited""")
def nearmiss_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.text import single_edits

    names = load(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    made = names.select("name", F.inline(single_edits(F.col("name"))))
    return made.where("edited <> name").groupBy("name", "edited").agg(F.min("kind").alias("kind"), F.count("*").alias("n_ways"))


@query("""
WITH b AS (SELECT DISTINCT p_brand AS name FROM part)
SELECT a.name, count(b.name) AS n_neighbours, min(b.name) AS first_neighbour FROM b a LEFT JOIN b b ON levenshtein(a.name, b.name) = 1 GROUP BY a.name""")
def nearmiss_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.audit import edit_neighbours

    names = load(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    pairs = edit_neighbours(names, "name")
    return names.join(pairs, "name", "left").groupBy("name").agg(F.count("neighbour").alias("n_neighbours"), F.min("neighbour").alias("first_neighbour"))


@query("""
WITH c AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents),
d AS (SELECT doc_id, h, row_number() OVER (ORDER BY doc_id) AS k FROM c WHERE rn > 1)
SELECT doc_id, substr(h, 1, 12) || '__stable_copy_' || lpad(k || '', 6, '0') AS new_id FROM d""")
def copies_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.ordering import with_position

    docs = load(spark, sf_dir, "documents").select("doc_id", identity.exact(F.col("text")).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    later = with_position(docs.join(first, "h").where("doc_id > first"), "doc_id")
    return later.select("doc_id", F.concat(F.substring("h", 1, 12), F.lit("__stable_copy_"), F.lpad((F.col("position") + 1).cast("string"), 6, "0")).alias("new_id"))


@query("""
SELECT doc_id, sha256('7:order:' || doc_id) < sha256('7:noise:' || doc_id) AS first_stream_lower, substr(sha256('7:order:' || doc_id), 1, 8) AS order_key FROM documents""")
def named_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, noise = (identity.stream(7, c, F.col("doc_id")) for c in ("order", "noise"))
    return load(spark, sf_dir, "documents").select("doc_id", (order < noise).alias("first_stream_lower"), F.substring(order, 1, 8).alias("order_key"))


@query("""
WITH c AS (SELECT doc_id, lang, source, sha256(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('19:' || doc_id), doc_id) <= 80),
g AS (SELECT source, row_number() OVER (ORDER BY sha256('19:' || source), source) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM k))
SELECT CASE WHEN rn <= greatest(1, least(n - 1, round_even(n * 0.25, 0)::BIGINT)) THEN 'validation' ELSE 'train' END AS split, lang, count(*) AS n_docs FROM k JOIN g USING (source) GROUP BY ALL""")
def stagewise_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("h", identity.exact(F.col("text")))
    capped = split.cap(dedup.keep_first(docs, "h", "doc_id"), "lang", 80, "19", "doc_id")
    return split.group_split(capped, "source", 0.25, "19").groupBy("split", "lang").agg(F.count("*").alias("n_docs"))


@query("""
SELECT source, min(doc_id) AS first_id, max(doc_id) FILTER (rn = 2) AS second_id, count(*) FILTER (rn <= 3) AS n_first_three
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY source""")
def first_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    top = load(spark, sf_dir, "documents").select("doc_id", "source", rank.alias("rn")).where("rn <= 3")
    return top.groupBy("source").agg(F.min("doc_id").alias("first_id"), F.max(F.when(F.col("rn") == 2, F.col("doc_id"))).alias("second_id"), F.count("*").alias("n_first_three"))
