"""The prefix trie of conversations: which turns are shared, and what sharing them saves.

A node is a distinct sequence of first turns. A prefix is told by a polynomial of its turns' digests
modulo a prime, in two lanes: such sums can be carried over a partition's border and moved to another
position, so a conversation of any length is cut over tasks like any other rows. A count-min sketch
over all prefixes screens them: an estimate of one proves that a single conversation has the prefix,
and its node is written where it stands; only prefixes that may be shared are grouped, by partial aggregates.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored

PRIME = (1 << 61) - 1
#: The polynomials' points, and their inverses up to the longest head.
POINTS = (1_234_567_890_123_456_789 % PRIME, 987_654_321_987_654_321)
#: A conversation can begin with at most so many turns of another.
MOST_HEAD = 5
INVERSES = [[pow(x, -k, PRIME) for k in range(MOST_HEAD + 1)] for x in POINTS]

#: Rows of the sketch, its cells for each prefix (rounded up to a power of two) and its largest size:
#: three rows of 2^26 bits, 25 MB, are all that is ever sent to the driver and broadcast. With more
#: than 2^26 prefixes more of them count as possibly shared; results do not change.
ROWS, CELLS_PER_PREFIX, LEAST_BITS, MOST_BITS = 3, 4, 16, 26
BLOCK = 1 << 16
#: Ids of one piece of a node's list of ends.
IDS = 1000

KEY = ["depth", "d1", "d2"]
_NUMBERED = "conv_id long, pos long, t1 long, t2 long, chars long, p1 long, p2 long, cum long, part int"
_PREFIX = "conv_id long, depth long, d1 long, d2 long, u1 long, u2 long, chars long, before long, length long"


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions, polynomials and characters so far of a sorted partition's turns, as if no earlier partition were there."""
    from pyspark import TaskContext

    part, conv, (x1, x2) = TaskContext.get().partitionId(), None, POINTS
    pos = p1 = p2 = cum = w1 = w2 = 0
    for b in batches:
        made = []
        for c, t1, t2, chars in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if c != conv:
                conv, pos, p1, p2, cum, w1, w2 = c, 0, 0, 0, 0, 1, 1
            p1, p2, cum = (p1 + t1 * w1) % PRIME, (p2 + t2 * w2) % PRIME, cum + chars
            made.append((pos, p1, p2, cum))
            pos, w1, w2 = pos + 1, w1 * x1 % PRIME, w2 * x2 % PRIME
        pos_, p1_, p2_, cum_ = zip(*made, strict=True) if made else [()] * 4
        sums = [pa.array(x, pa.int64()) for x in (pos_, p1_, p2_, cum_)]
        columns = [*b.columns[:4], *sums, pa.array([part] * len(made), pa.int32())]
        names = ["conv_id", "t1", "t2", "chars", "pos", "p1", "p2", "cum", "part"]
        yield pa.RecordBatch.from_arrays(columns, names=names).select([f.split()[0] for f in _NUMBERED.split(", ")])


def carries(ends: list[tuple]) -> dict[int, tuple]:
    """What partitions take over: {partition: (conversation, turns, p1, p2, characters before it)}.

    ``ends`` has a row (partition, first conversation, last conversation, its last pos, p1, p2, cum) for each partition, in order.
    """
    found, conv, held = {}, None, (0, 0, 0, 0)
    for part, first, last, *sums in ends:
        own = (sums[0] + 1, *sums[1:])
        if first == conv:
            found[part] = (conv, *held)
            if last == first:
                own = moved(held, own)
        conv, held = last, own
    return found


def moved(before: tuple, own: tuple) -> tuple:
    """(turns, p1, p2, characters) of ``own`` turns that follow those of ``before``."""
    n = before[0]
    lanes = [(b + pow(x, n, PRIME) * p) % PRIME for x, b, p in zip(POINTS, before[1:3], own[1:3], strict=True)]
    return (n + own[0], *lanes, before[3] + own[3])


def _carried(carry: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if carry and not carry.keys().isdisjoint(b.column("part").to_pylist()):
                rows = b.to_pylist()
                for r in rows:
                    conv, *before = carry.get(r["part"], (None,))
                    if conv == r["conv_id"]:
                        n, r["p1"], r["p2"], r["cum"] = moved(before, (r["pos"] + 1, r["p1"], r["p2"], r["cum"]))
                        r["pos"] = n - 1
                b = pa.RecordBatch.from_pylist(rows, schema=b.schema)
            yield b

    return run


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its position in its conversation and the sums up to it.

    Turns are sorted by range, so that a conversation's turns may lie in several partitions; the
    sums of each partition's last conversation, a row per partition, are carried over. Texts are
    hashed where they are read: only digests and lengths are shuffled.
    """
    own = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.char_length(own[0]).cast("string"), F.lit(":"), *own).cast("binary"))
    lane = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long") + 1
    turns = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), lane(1).alias("t1"), lane(17).alias("t2"), F.char_length(own[1]).cast("long").alias("chars"), F.monotonically_increasing_id().alias("id")
    ).where("conv_id is not null")
    order = ["conv_id", "turn", "t1", "t2", "id"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "chars")
    local = stored(dealt.mapInArrow(_numbered, _NUMBERED), "turns")
    last = F.max(F.struct("conv_id", "pos", "p1", "p2", "cum")).alias("last")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), last).select("part", "first", "last.*").orderBy("part").collect()
    return local.mapInArrow(_carried(carries([tuple(r) for r in ends])), _NUMBERED)


def _own_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes that end with a conversation's own turns, moved behind its head."""
    names, powers = [f.split()[0] for f in _PREFIX.split(", ")], [[1], [1]]
    for b in batches:
        rows = []
        for conv, pos, t1, t2, chars, p1, p2, cum, h, nb, length, b1, b2, bc, o1, o2, oc in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lanes = []
            for k, (t, p, head, own) in enumerate(((t1, p1, b1, o1), (t2, p2, b2, o2))):
                known = powers[k]
                while len(known) <= min(pos, 4096):
                    known.append(known[-1] * POINTS[k] % PRIME)
                power, inverse = known[pos] if pos <= 4096 else pow(POINTS[k], pos, PRIME), INVERSES[k][h - nb]
                lanes.append(((head + (p - own) * inverse) % PRIME, (head + (p - own - t * power) * inverse) % PRIME))
            rows.append((conv, nb + pos - h + 1, lanes[0][0], lanes[1][0], lanes[0][1], lanes[1][1], chars, bc + cum - chars - oc, length))
        yield _batch(names, list(zip(*rows, strict=True)) if rows else [()] * len(names))


def prefixes(turns: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """A row for each conversation and depth: the prefix's digest, its parent's, and its characters.

    A conversation begins with the first ``head`` turns (at most ``MOST_HEAD``) of conversation
    ``base`` (all, if it has fewer; none, if it is not there), its own turns after its first ``head`` follow.
    """
    first = F.when(F.col("pos") < MOST_HEAD, F.struct("pos", "t1", "t2", "chars", "p1", "p2", "cum"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(first)).alias("own"))
    convs = convs.withColumn("h", (F.lit(0) if head is None else F.least(head, F.lit(MOST_HEAD))).cast("int")).withColumn("base", (F.col("conv_id") if base is None else base).cast("long"))
    convs = stored(convs, "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("heads")).join(convs.select("base").distinct(), "base", "left_semi")
    at = lambda heads, k, field: F.when(F.col(k) > 0, F.try_element_at(heads, F.col(k))[field]).otherwise(0)
    nb = F.least("h", F.coalesce(F.size("heads"), F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("nb", F.when(F.col("heads").isNull(), 0).otherwise(nb)).withColumn("length", F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    sums = [at(F.col("heads"), "nb", x).alias(y) for x, y in (("p1", "b1"), ("p2", "b2"), ("cum", "bc"))]
    sums += [at(F.col("own"), "h", x).alias(y) for x, y in (("p1", "o1"), ("p2", "o2"), ("cum", "oc"))]
    placed = turns.join(convs.where("n > h").select("conv_id", "h", "nb", "length", *sums), "conv_id").where("pos >= h")
    columns = "conv_id pos t1 t2 chars p1 p2 cum h nb length b1 b2 bc o1 o2 oc".split()
    own = placed.select(columns).mapInArrow(_own_prefixes, _PREFIX)
    heads = convs.select("conv_id", "length", "heads", F.explode(F.sequence(F.lit(0), F.col("nb"))).alias("depth"))
    heads = heads.withColumn("up", F.col("depth") - 1)
    of = lambda k, field: at(F.col("heads"), k, field).cast("long")
    heads = heads.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), of("depth", "p1").alias("d1"), of("depth", "p2").alias("d2"), of("up", "p1").alias("u1"), of("up", "p2").alias("u2"),
        of("depth", "chars").alias("chars"), of("up", "cum").alias("before"), F.col("length").cast("long").alias("length"),
    )
    return own.unionByName(heads)


def cells(depth: np.ndarray, d1: np.ndarray, d2: np.ndarray, bits: int) -> list[np.ndarray]:
    """A cell of each of the sketch's rows for every prefix."""
    x = d1.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + d2.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + depth.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    found = []
    for k in range(ROWS):
        y = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k * 0x94D049BB133111)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        found.append((y >> np.uint64(64 - bits)) + np.uint64(k << bits))
    return found


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _counted(bits: int):
    """Each task's sketch, its counts held at two, in packed blocks; empty blocks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS << bits, dtype=np.uint8)
        for b in batches:
            for found in cells(*(_column(b, k) for k in KEY), bits):
                at, n = np.unique(found, return_counts=True)
                counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)
        for block in range(0, len(counts), BLOCK):
            part = counts[block : block + BLOCK]
            if part.any():
                packed = zlib.compress(np.packbits(part >= 1, bitorder="little").tobytes() + np.packbits(part >= 2, bitorder="little").tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "cells": pa.array([packed], pa.binary())})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of all tasks, sorted by their place, as one block each: the cells that count two."""
    block, ones, twos = None, None, None
    row = lambda: pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "cells": pa.array([twos.tobytes()], pa.binary())})
    for b in batches:
        for at, packed in zip(b.column("block").to_pylist(), b.column("cells").to_pylist(), strict=True):
            one, two = np.split(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), 2)
            if at != block:
                if block is not None:
                    yield row()
                block, ones, twos = at, one, two
            else:
                ones, twos = ones | one, twos | two | (ones & one)
    if block is not None:
        yield row()


def sketch(found: DataFrame, bits: int) -> np.ndarray:
    """The cells of a count-min sketch over all prefixes that count two or more, as packed bits."""
    blocks = found.where("depth > 0").select(KEY).mapInArrow(_counted(bits), "block long, cells binary")
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block long, cells binary")
    twos = np.zeros((ROWS << bits) // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():
        twos[r["block"] // 8 :][: BLOCK // 8] = np.frombuffer(r["cells"], dtype=np.uint8)
    return twos


def _screened(twos, bits: int):
    """Whether a prefix, and its parent, may be shared: every cell counts two. The root always may."""

    def shared(depth: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        full = depth <= 0
        met = np.ones(len(depth), dtype=bool)
        for at in cells(depth, d1, d2, bits):
            met &= (twos.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return met | full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth = _column(b, "depth")
            flags = [shared(depth, _column(b, "d1"), _column(b, "d2")), shared(depth - 1, _column(b, "u1"), _column(b, "u2"))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(f) for f in flags)], names=[*b.schema.names, "shared", "shared_up"])

    return run


def screened(found: DataFrame) -> DataFrame:
    """``found`` with whether each prefix and its parent may be shared; what is not is proved to be one conversation's."""
    bits = min(max((CELLS_PER_PREFIX * found.count()).bit_length(), LEAST_BITS), MOST_BITS)
    twos = found.sparkSession.sparkContext.broadcast(sketch(found, bits))  # 25 MB at most
    return found.mapInArrow(_screened(twos, bits), f"{_PREFIX}, shared boolean, shared_up boolean")


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, id) rows as pieces of joined ids, so that a node of many ends is few rows."""
    names, key, ids = [*KEY, "first", "ids"], None, []
    row = lambda: (*key, ids[0], ",".join(map(str, ids)))
    for b in batches:
        rows = []
        for *at, conv in zip(*(b.column(c).to_pylist() for c in [*KEY, "conv_id"]), strict=True):
            if at != key or len(ids) >= IDS:
                if ids:
                    rows.append(row())
                key, ids = at, []
            ids.append(conv)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row()], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one digest for each node; a piece is read and let go."""
    names, key, state = [*KEY, "ends"], None, None
    for b in batches:
        rows = []
        for *at, ids in zip(*(b.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
            if at != key:
                if key:
                    rows.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=names)


def ends_of(found: DataFrame) -> DataFrame:
    """The digest of the ids that end in each node; a node's ids are joined in parallel and hashed in their order."""
    ended = found.where("depth = length").select(*KEY, "conv_id")
    order = [*KEY, "conv_id"]
    pieces = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_pieces, "depth long, d1 long, d2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "depth long, d1 long, d2 long, ends string")


def trie(found: DataFrame) -> DataFrame:
    """The nodes of the trie of ``found``, the stored rows of ``prefixes``: a row for each node.

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. A conversation is a node's smallest member from some depth on, so
    what it shares lies above: leaves and savings of a whole subtree are sums over a node's members of
    one number for each conversation, and no level waits for another.
    """
    flagged = stored(screened(found), "screened")
    shared, single = flagged.where("shared"), flagged.where("not shared")
    group = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("length").alias("longest"), *(F.min(c).alias(c) for c in ("u1", "u2", "before")), F.max("shared_up").alias("shared_up")]
    nodes = stored(shared.groupBy(KEY).agg(*group), "shared-nodes")
    root = (nodes.where("depth = 0").select("conv_id").first() or [None])[0]

    # for each conversation: the characters before the first node whose smallest member it is, and whether a leaf is told by it
    leaf = lambda test: F.when(test, 1).otherwise(0).alias("leaf")
    told = nodes.select("conv_id", "before", leaf(F.col("longest") == F.col("depth")))
    last = F.col("depth") == F.col("length")
    told = told.unionByName(single.select("conv_id", "before", leaf(last)))
    told = told.unionByName(flagged.where(last).select("conv_id", (F.col("before") + F.col("chars")).alias("before"), F.lit(0).alias("leaf")))
    told = told.groupBy("conv_id").agg(F.min("before").alias("own_from"), F.max("leaf").alias("leaf"))

    sums = [F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("own_from") - F.col("before"), F.lit(0))).alias("saved_tokens")]
    whole = shared.join(told, "conv_id").groupBy(KEY).agg(*group, *sums)
    links = nodes.where("depth > 0 and shared_up").unionByName(single.where("shared_up"), allowMissingColumns=True)
    children = links.select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("d1"), F.col("u2").alias("d2")).groupBy(KEY).agg(F.count("*").alias("n_children"))
    none = hashlib.sha256(b"").hexdigest()
    whole = whole.join(children, KEY, "left").join(ends_of(shared), KEY, "left")
    ends = F.coalesce("ends", F.lit(none)).alias("ends_sha256")
    result = ["conv_id", "depth", "u1", "u2", "shared_up", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", ends]
    tail = [F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")]
    tail.append(F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"))
    rows = whole.select(result).unionByName(single.select("conv_id", "depth", "u1", "u2", "shared_up", *tail))

    # a parent that is not shared has the same only member; the others' smallest members are looked up
    known = F.when(F.col("depth") == 1, F.lit(root)).when(F.col("depth") > 1, F.col("conv_id")).cast("long")
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    straight = rows.where("depth <= 1 or not shared_up").withColumn("parent_conv_id", known).select(columns)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("u1"), F.col("d2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    return straight.unionByName(rows.where("depth > 1 and shared_up").join(parents, ["depth", "u1", "u2"]).select(columns))


def conversation_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all conversations, each begun with ``head`` turns of conversation ``base`` where given (Columns over conv_id).

    Turns follow ``turn``, nulls first, ties by a digest of role and text; repeated rows are turns
    of their own. A null role or text counts as empty; rows without a conv_id belong to no
    conversation and are left out; an empty table gives no nodes. Other columns are not read, and
    texts may have any length. Two prefixes are held equal if two polynomials of 61 bits agree.
    """
    return trie(stored(prefixes(numbered(conversations, conv_id, turn, role, text), base, head), "prefixes"))


#: DuckDB SQL of the query: whole turn lists as nodes, crc32 bit by bit, subtrees as prefixes of prefixes.
ORACLE = """
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null
), convs as (
    select conv_id, list({'role': role, 'text': text} order by turn nulls first, md5(length(role) || ':' || role || text)) as own,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 as h
    from turns group by conv_id
), rebuilt as (
    select c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) as turns from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100
), members as (
    select conv_id, d as depth, turns[1:d] as node, len(turns) as length from (select *, unnest(range(0, len(turns) + 1)) as d from rebuilt)
), nodes as (
    select depth, node, min(conv_id) as conv_id, count(*) as n_convs, max(length) as longest,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth), '')) as ends_sha256,
        (count(*) - 1) * coalesce(length(any_value(node[depth].text)), 0) as saved
    from members group by depth, node
), below as (
    select d as depth, node[1:d] as node, sum(saved) as saved_tokens, count(*) filter (longest = depth) as n_leaves
    from (select *, unnest(range(0, depth + 1)) as d from nodes) group by all
), children as (
    select depth - 1 as depth, node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by all
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join below b using (depth, node) left join children c using (depth, node)
left join nodes p on p.depth = n.depth - 1 and p.node = n.node[1:n.depth - 1]
"""
