import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tessella.llm import prefix_trie, queries
from tessella.llm.common import load, stored

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def ordered(rows):
    """Each conversation's turns; ties by a digest of role and text."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {c: [x[3:] for x in sorted(ts)] for c, ts in convs.items()}


def rebuilt(rows):
    own = ordered(rows)
    h = {c: crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    found = []

    def below(node):
        parts = [below(x) for x in children.get(node, [])]
        leaves = sum(p[0] for p in parts) or 1
        saved = sum(p[1] for p in parts) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        found.append((min(members[node]), len(node), parent, len(members[node]), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return sorted(found, key=str)


def made(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def sample():
    rng, rows = random.Random(4), []
    for c in (*range(0, 40), 100, 101, 102, 130, 205, 206, 100_000_000_007):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else None, rng.choice(["hi", "yes é🎈", None, "", "a longer text"]) if t < 3 else f"own {c} {rng.random()}"))
    rows += [(7, None, "system", "before all"), (8, 1, "user", "tied"), (8, 1, "assistant", "tied"), (8, 1, "user", "tied"), (None, 0, "user", "of no conversation")]
    copies = [(300 + i, t, "user", f"copied {t}") for i in range(60) for t in range(4)]
    return rows + copies


def test_nodes_equal_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("clash")).repartition(5)
    conv = F.col("conv_id")
    got = prefix_trie.conversation_trie(df, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)
    assert made(got) == brute(rebuilt(rows))
    assert made(prefix_trie.conversation_trie(df)) == brute(ordered(rows))
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_long_conversations_lie_in_many_partitions(spark):
    rows = [(c, t, "user", f"turn {t % 7}") for c, n in ((5, 3000), (6, 3000), (9, 10)) for t in range(n)]
    conf = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(9))
        assert turns.where("conv_id = 5").select("part").distinct().count() > 2
        got = {r["depth"]: r for r in prefix_trie.trie(stored(prefix_trie.prefixes(turns), "prefixes")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(got) == 3001
    for d, r in got.items():
        assert (r["conv_id"], r["n_convs"], r["n_leaves"], r["n_children"]) == (5, 3 if d <= 10 else 2, 1, int(d < 3000))
        want = sum((2 if x <= 10 else 1) * 6 for x in range(max(d, 1), 3001))
        assert r["saved_tokens"] == want
    assert got[3000]["ends_sha256"] == hashlib.sha256(b"5,6").hexdigest() and got[10]["ends_sha256"] == hashlib.sha256(b"9").hexdigest()


def test_sketch_proves_singletons_and_collisions_change_nothing(spark, monkeypatch):
    rows = sample()
    found = stored(prefix_trie.prefixes(prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA))), "prefixes")
    counts = {tuple(r[k] for k in prefix_trie.KEY): r["count"] for r in found.groupBy(*prefix_trie.KEY).count().collect()}
    for r in prefix_trie.screened(found).collect():
        n = counts[tuple(r[k] for k in prefix_trie.KEY)]
        assert r["shared"] or n == 1  # never a shared prefix taken for a singleton
        assert not r["shared"] or n > 1 or r["depth"] == 0
    monkeypatch.setattr(prefix_trie, "LEAST_BITS", 5)
    monkeypatch.setattr(prefix_trie, "MOST_BITS", 5)
    monkeypatch.setattr(prefix_trie, "BLOCK", 32)
    flags = prefix_trie.screened(found).collect()
    assert any(r["shared"] and counts[tuple(r[k] for k in prefix_trie.KEY)] == 1 for r in flags)
    assert made(prefix_trie.trie(found)) == brute(ordered(rows))


def test_ends_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(95, 1200)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert made(got) == brute(ordered(rows))


def test_carries():
    a, b, c = (3, 10, 20, 5), (2, 7, 9, 1), (4, 1, 1, 1)
    ends = [(0, 1, 4, a[0] - 1, *a[1:]), (1, 4, 4, b[0] - 1, *b[1:]), (2, 4, 6, c[0] - 1, *c[1:])]
    assert prefix_trie.carries(ends) == {1: (4, *a), 2: (4, *prefix_trie.moved(a, b))}


def test_query_equals_brute_force_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in load(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert made(queries.QUERIES["op13_conversation_prefix_trie"](spark, sf)) == brute(rebuilt(rows))


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_conversation_prefix_trie"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
