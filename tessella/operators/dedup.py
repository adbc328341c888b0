"""Duplicates, label conflicts and contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.tables import stored


def keep_first(df: DataFrame, key: Column | str, *order: str) -> DataFrame:
    """The first row of every key in the order given; of rows alike in the order any.

    Tasks reduce their own rows of a key before the shuffle, so a key with very many copies meets nowhere as a whole.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias("_key")).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys whose rows disagree on the label, with their number of rows; null labels don't count."""
    return df.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count("*").alias("n_rows")).where("lo <> hi").drop("lo", "hi")


def quarantine_conflicts(df: DataFrame, key: str, label: str, *order: str) -> DataFrame:
    """Drops all rows of keys in conflict; of the others keeps the first."""
    return keep_first(df.join(label_conflicts(df, key, label), key, "left_anti"), key, *order)


def unique_or_raise(df: DataFrame, key: str, label: str, *order: str) -> DataFrame:
    """The first row of every key; keys whose rows disagree on the label are refused."""
    if bad := [r[key] for r in label_conflicts(df, key, label).limit(20).collect()]:
        raise ValueError(f"labels in conflict, among them {bad}")
    return keep_first(df, key, *order)


def dedup_counters(df: DataFrame, key: str, label: str, order: str, forbidden: DataFrame) -> DataFrame:
    """One row: forbidden rows, later duplicates, and later rows against the label of the first."""
    marked = df.join(forbidden.select(key).distinct().withColumn("_forbidden", F.lit(True)), key, "left")
    allowed = marked.where(F.col("_forbidden").isNull())
    first = allowed.groupBy(key).agg(F.min(F.struct(order, label)).alias("first"))
    later = allowed.join(first, key).withColumn("is_later", F.col(order) > F.col(f"first.{order}"))
    counts = later.agg(
        F.count_if(~F.col("is_later")).alias("kept"),
        F.count_if(F.col("is_later") & F.col(label).eqNullSafe(F.col(f"first.{label}"))).alias("duplicates"),
        F.count_if(F.col("is_later") & ~F.col(label).eqNullSafe(F.col(f"first.{label}"))).alias("conflicts"),
    )
    return counts.join(marked.agg(F.count_if(F.col("_forbidden").isNotNull()).alias("forbidden")), how="cross")  # two single rows


def greedy_two_keys(df: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Keeps a row if no kept row before it shares either key: an ordered, greedy choice.

    Each round keeps the undecided rows that come first under both of their keys, and drops the
    undecided rows that share a key with one of them. Every round decides one row at least.
    """
    kept, open_rows = None, df
    while True:
        both = open_rows
        for k, key in enumerate((first, second)):
            least = both.groupBy(key).agg(F.min(order).alias(f"_least{k}"))
            both = both.join(least, key)
        now = stored(both.where(f"{order} = _least0 and {order} = _least1").select(*df.columns), "kept")
        kept = now if kept is None else kept.unionByName(now)
        open_rows = stored(open_rows.join(now.select(first), first, "left_anti").join(now.select(second), second, "left_anti"), "open-rows")
        if open_rows.isEmpty():
            return kept


#: Passages whose anchors are broadcast, and the bytes of their texts at most; beyond, the anchors' join shuffles.
BROADCAST_PASSAGES, BROADCAST_BYTES = 50_000, 32 << 20
#: Words of an anchor at most, and characters of one where a passage has no whole word inside.
GRAM, CHARS = 4, (8, 4, 2, 1)


def _units(text: Column, by_words: bool) -> Column:
    return F.split(F.btrim(F.regexp_replace(text, r"\s+", " ")), " ") if by_words else F.split(text, "")


def _gram(units: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(units, at + i) for i in range(size)])


def containing(docs: DataFrame, passages: DataFrame, text: str = "text", passage: str = "text", keys: tuple[str, str] = ("doc_id", "item_id")) -> DataFrame:
    """Pairs of ``keys``: documents whose text contains a passage as a substring.

    Words inside a passage are whole words of any text that contains it, so up to ``GRAM`` words after a
    passage's first are its anchor, and a text is compared with the passages whose anchor one of its word
    runs equals. Passages of one or two words are anchored by their first characters in the same way. A text's runs are
    hashed and looked up where it is read: with anchors few enough to broadcast nothing of the texts is shuffled.
    Null texts contain nothing; null and empty passages are in no text.
    """
    d, p = keys
    items = passages.select(F.col(p), F.col(passage).alias("_passage")).where("_passage <> ''")
    n_words, n_chars = F.size(_units(F.col("_passage"), True)), F.size(_units(F.col("_passage"), False))
    size = F.when(n_words >= 3, F.least(n_words - 2, F.lit(GRAM)))
    for chars in CHARS:
        size = size.when(n_chars >= chars, F.lit(-chars))  # negative: by characters
    items = items.withColumn("_size", size)
    classes = items.groupBy("_size").agg(F.count("*").alias("n"), F.sum(F.octet_length("_passage")).alias("bytes")).collect()  # a row per size
    few = sum(c["n"] for c in classes) <= BROADCAST_PASSAGES and sum(c["bytes"] for c in classes) <= BROADCAST_BYTES
    found = docs.select(d).join(items.select(p), F.lit(False)).limit(0)
    for c in classes:
        by_words, size = c["_size"] > 0, abs(c["_size"])
        own = items.where(F.col("_size") == c["_size"]).withColumn("_units", _units(F.col("_passage"), by_words))
        anchors = own.select(p, "_passage", _gram(F.col("_units"), F.lit(1 if by_words else 0), size).alias("_gram"))
        texts = docs.select(d, F.col(text).alias("_text"), _units(F.col(text), by_words).alias("_units"))
        starts = F.when(F.size("_units") >= size, F.sequence(F.lit(0), F.size("_units") - size))
        runs = texts.select(d, "_text", "_units", F.explode(starts).alias("_at")).select(d, "_text", _gram(F.col("_units"), F.col("_at"), size).alias("_gram"))
        if few:
            pairs = runs.join(F.broadcast(anchors), "_gram").where("contains(_text, _passage)").select(d, p)
        else:
            met = runs.select(d, "_gram").distinct().join(anchors.select(p, "_gram"), "_gram").select(d, p).distinct()
            pairs = met.join(docs.select(d, F.col(text).alias("_text")), d).join(own.select(p, "_passage"), p).where("contains(_text, _passage)").select(d, p)
        found = found.unionByName(pairs)
    return found.distinct()
