"""Graphs and value flow: breadth-first depth, reachability, joins of abstract values."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.tables import stored


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """Rows (node, depth): nodes within ``depth`` steps of ``seeds`` (node), by least depth; None goes on to the end.

    Each step joins the newest nodes with the edges and leaves out what was seen.
    """
    seen = front = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "front")
    for step in count(1) if depth is None else range(1, depth + 1):
        nxt = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = stored(nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def bfs_shared(links: DataFrame, seeds: DataFrame, depth: int, node: str, via: str) -> DataFrame:
    """Rows (node, depth): nodes within ``depth`` steps of ``seeds`` (node), a step leading to every node with a shared ``via``.

    ``links`` has columns ``node`` and ``via``. The search goes from the newest nodes to values of ``via`` not yet
    seen and from these to nodes, so that a value costs one row for each of its nodes and no pairs arise.
    """
    links = stored(links.select(F.col(node).alias("node"), F.col(via).alias("via")).distinct(), "links")
    seen = front = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "front")
    passed = None
    for step in range(1, depth + 1):
        new = links.join(front.select("node"), "node").select("via").distinct()
        new = stored(new.join(passed, "via", "left_anti") if passed is not None else new, "passed")
        front = stored(links.join(new, "via").select("node").distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        passed = new if passed is None else passed.unionByName(new)
    return seen


def joined_value(df: DataFrame, *by: str) -> DataFrame:
    """Joins abstract values of one variable: union of sources, sanitizer only if all agree, any unknown.

    Takes source, sanitizer (null for none) and unknown.
    """
    same = (F.min(F.coalesce("sanitizer", F.lit(""))) == F.max(F.coalesce("sanitizer", F.lit("")))) & F.max("sanitizer").isNotNull()
    return df.groupBy(*by).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.when(same, F.max("sanitizer")).alias("sanitizer"), F.bool_or("unknown").alias("unknown"))


def verdict(candidate: Column, inconclusive: Column, none: Column) -> Column:
    """Over a snippet's sinks: any candidate, else anything inconclusive or no sink at all, else safe."""
    return F.when(F.bool_or(candidate), "CANDIDATE").when(F.bool_or(inconclusive) | F.bool_and(none), "INCONCLUSIVE").otherwise("SAFE")


# fixed values: what stands around a source and a sink in each relation, and which literals end a flow
OPAQUE_CALL = (r"\s*=\s*(?:new\s+)?[A-Za-z_$][\w$.]*\([^;]*", r"[^;]*\)")
ASSIGNED, ARGUMENT, ENDS = r"\s*=\s*", (r"\s*\([^;]*\b", r"\b[^;]*\)"), r"(?:\s*;|\s*$)"
LITERAL_WRITE = r"""\s*=\s*(?:['"][^'"]*['"]|\d+(?:\.\d+)?|true|false|null|undefined)"""


def relation(source: Column, sink: Column, excerpt: Column) -> Column:
    """How a source reaches a sink in an excerpt; what is not obvious is UNKNOWN.

    A call's result that is written to the sink is UNKNOWN, whatever else there is. The source assigned
    as it is, or handed to the sink as an argument, is CONNECTED; the sink overwritten by a
    literal that ends its statement is DISCONNECTED. Nulls and empty texts are UNKNOWN.
    """
    bare = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r"))
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(bare(c), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    text, src, out = bare(F.regexp_replace(excerpt, r"\s+", " ")), quoted(source), quoted(sink)
    found = lambda *parts: F.regexp_like(text, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    opaque = found(out, OPAQUE_CALL[0], src, OPAQUE_CALL[1])
    direct = found(out, ASSIGNED, src, ENDS) | found(out, ARGUMENT[0], src, ARGUMENT[1])
    literal = found("(?i)", out, LITERAL_WRITE, ENDS)
    missing = (bare(source) == "") | (bare(sink) == "") | (text == "") | excerpt.isNull()
    return F.when(missing | opaque, "UNKNOWN").when(direct, "CONNECTED").when(literal, "DISCONNECTED").otherwise("UNKNOWN")


# fixed value: an assignment to a name
ASSIGNMENT = r"([A-Za-z_$][\w$]*)\s*=\s*([^;=\n][^;\n]*)"
NAME = r"[A-Za-z_$][\w$]*"


def assignments(scripts: DataFrame, key: str, code: str) -> DataFrame:
    """Rows (key, dst, src): the names that each assigned value reads, over every statement of every script; strings are no names."""
    bare = F.regexp_replace(F.col(code), r"'[^'\n]*'|\"[^\"\n]*\"", "0")
    said = scripts.select(key, F.explode(F.regexp_extract_all(bare, F.lit(ASSIGNMENT), F.lit(0))).alias("_said"))
    read = F.array_distinct(F.regexp_extract_all(F.regexp_extract("_said", ASSIGNMENT, 2), F.lit(NAME), F.lit(0)))
    return said.select(key, F.regexp_extract("_said", ASSIGNMENT, 1).alias("dst"), F.explode(read).alias("src")).distinct()


def reached(edges: DataFrame, key: str, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Rows (key, sink, depth): sinks of each script that a value of one of its sources reaches, by the fewest assignments.

    ``sources`` and ``sinks`` have key and name. Every step joins the names reached last with the edges of their scripts and
    leaves out what was reached before, so cycles end; steps go on until a step reaches nothing new.
    """
    pair = lambda name: F.struct(F.col(key).alias("k"), F.col(name).alias("name"))
    steps = stored(edges.select(pair("src").alias("src"), pair("dst").alias("dst")), "edges")
    found = bfs(steps, sources.select(pair("name").alias("node")), None)
    return found.join(sinks.select(pair("name").alias("node")).distinct(), "node").select(F.col("node.k").alias(key), F.col("node.name").alias("sink"), "depth")
