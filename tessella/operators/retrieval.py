"""TF-IDF retrieval over postings, and measures of a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_terms(text: Column) -> Column:
    """Words of two characters or more and pairs of neighbours, lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.slice(words, 1, 0)))


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words that are padded by a space; a shorter word counts whole, once."""
    padded = F.transform(F.filter(F.split(F.lower(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sized(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))

    def grams(w: Column) -> Column:
        parts = [sized(w, n) for n in range(low, high + 1)]
        # beyond a word's length there is the word itself, once: of several sizes only the first gives it
        kept = [parts[0]] + [F.when(F.length(w) >= n, p).otherwise(F.slice(p, 1, 0)) for n, p in zip(range(low + 1, high + 1), parts[1:], strict=True)]
        return F.concat(*kept)

    return F.flatten(F.transform(padded, grams))


def postings(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """Rows (key, term, tf): sublinear term frequencies."""
    counts = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").count()
    return counts.select(key, "term", (1 + F.log("count")).alias("tf"))


def weighted(post: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """Rows (key, term, w): tf-idf of unit length; terms without an idf drop out."""
    w = post.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def idf(post: DataFrame, n_docs: int) -> DataFrame:
    """Smooth inverse document frequencies: ln((1 + n) / (1 + df)) + 1."""
    return post.groupBy("term").agg((F.log((F.lit(1.0) + n_docs) / (1 + F.count("*"))) + 1).alias("idf"))


def cosine(queries: DataFrame, corpus: DataFrame, q: str, d: str, q_text: str, d_text: str, terms, share: float) -> DataFrame:
    """Rows (q, d, sim): ``share`` of the cosine of each pair that has a term in common.

    The corpus's vocabulary decides: it should be the smaller side. Terms meet by a join of
    postings; those of the queries are first cut to the vocabulary.
    """
    own = postings(corpus, d, terms(F.col(d_text)))
    inverse = idf(own, corpus.count())
    asked = postings(queries, q, terms(F.col(q_text)))
    return weighted(asked, q, inverse).withColumnRenamed("w", "qw").join(weighted(own, d, inverse), "term").groupBy(q, d).agg((F.sum(F.col("qw") * F.col("w")) * share).alias("sim"))


def blended(queries: DataFrame, corpus: DataFrame, q: str, d: str, q_text: str = "text", d_text: str = "text", k: int = 3) -> DataFrame:
    """The ``k`` best of .6 word and .4 character cosine for each query, ties by smaller id."""
    both = cosine(queries, corpus, q, d, q_text, d_text, word_terms, 0.6).unionByName(cosine(queries, corpus, q, d, q_text, d_text, char_terms, 0.4))
    total = both.groupBy(q, d).agg(F.round(F.sum("sim"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("score"), d))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def ranking_measures(ranked: DataFrame, gold: DataFrame, q: str, d: str, k: int) -> DataFrame:
    """Per query recall, precision, reciprocal rank and nDCG at ``k``; ``ranked`` has rank from 1."""
    n = gold.groupBy(q).agg(F.count("*").alias("n_gold"))
    hits = n.join(ranked.join(gold, [q, d]), q, "left")
    gain = F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    per = hits.groupBy(q, "n_gold").agg(F.count("rank").alias("found"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"), gain.alias("dcg"))
    return per.select(q, (F.col("found") / F.col("n_gold")).alias("recall"), (F.col("found") / k).alias("precision"), "rr", (F.col("dcg") / ideal).alias("ndcg"))


def split_measures(per: DataFrame, by: str) -> DataFrame:
    """The measures of ``per`` (a row per scored query) averaged over each value of ``by``, with how many were scored."""
    return per.groupBy(by).agg(F.count("*").alias("scored_cases"), *(F.avg(c).alias(c) for c in ("recall", "precision", "rr", "ndcg")))


def contexts(ranked: DataFrame, corpus: DataFrame, q: str, d: str, text: str = "text") -> DataFrame:
    """A row per query: its hits as a list of points in the order of their rank; hits without a score are left out."""
    line = F.concat(F.lit("- ["), F.col(d).cast("string"), F.lit("] "), F.col(text))
    own = ranked.where("score > 0").join(corpus.select(d, text), d).groupBy(q).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_all"))  # k rows a query
    return own.select(q, F.array_join(F.transform("_all", lambda x: x["line"]), "\n").alias("context"))
