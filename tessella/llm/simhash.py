"""SimHash near-duplicates, linked through the anchors of a covering code.

A fingerprint is 64 bits: each bit is set if it is set in over half of the XXH64 hashes
(seed 42) of the text's word shingles. Fingerprints that differ in at most three bits link.

Two blocks of 31 bits are cut from the 64. Two linked fingerprints differ in at most one bit of
one of the blocks. The anchors of a block are the words of the perfect Hamming code of length
31: every value lies within one bit (the covering radius) of exactly one anchor, its home. A
fingerprint is replicated to all anchors within covering radius plus threshold, two bits, which
are 1 or 16. So, for a linked pair, one fingerprint is at the home anchor of the other, and
comparing the homes of an anchor with all that were replicated to it finds every link.

Copies share a fingerprint and count once. What an anchor's task returns is a spanning forest
of its links, not all pairs. Anchors that are home to many fingerprints are split: homes are
dealt over salted parts, and what is replicated there goes to each part.

Three bits of 64 are far less than what texts of a similarity of 0.8 differ in, about ten. ``drop_near_duplicates``
serves a bound on the Jaccard similarity of shingles: fingerprints of 256 bits, and many
blocks, each of ``GOLAY`` and some exact bits sampled from them. A block's anchors are the words of the
perfect Golay code (covering radius 3) with the further bits as they are; its threshold is zero, so that every
fingerprint has one anchor in it. How many bits stand as they are follows from the count of distinct fingerprints, how many
blocks from the share of pairs that may be missed. The pairs that meet at an anchor and are near in all 256 bits give a minimum spanning
forest, and its edges are verified: only texts whose shingles are as similar as asked for link. Where a
check fails, other pairs of the same anchors may be the links that hold: what the verified links leave
apart there is paired and verified again, until no pair is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, repeat
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import components, stored

SEED, MAX_BITS, BLOCK_BITS = 42, 3, 31
#: Homes of one part of an anchor; more are dealt over further parts.
PART_HOMES = 1024
#: Hot anchors up to this count are broadcast; beyond it the join shuffles.
BROADCAST_ANCHORS = 20_000

#: 64-bit words of a wide fingerprint; bits of a block in the Golay code; fingerprints that share an anchor
#: by chance, on average, and exact bits at least; share of the pairs at the bound that never meet.
WIDE, GOLAY, BY_CHANCE, LEAST_EXACT, LOSS = 4, 23, 256, 4, 0.02
#: Nearest partners of a fingerprint at an anchor that are verified at once after a failed check; eight times as many in each further round.
FAN = 32
#: A near-duplicate of the pipeline: so many words a shingle, and so much of the shingles of both in common.
SHINGLE, SIMILARITY = 5, 0.8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str | None, shingle: int) -> list[bytes]:
    """The text's runs of ``shingle`` words, A-Z lower-cased; fewer words are one run, none give none."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= shingle:
        return [whole]
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-shingle]]
    return [whole[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :], strict=True)]


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for k = 0, and others made from them for each k above."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide_fingerprint(text: str | None, shingle: int = 3, seed: int = SEED, words: int = WIDE) -> np.ndarray:
    """The SimHash of one text in ``words`` unsigned 64-bit words; zero for a null text or one without words."""
    from xxhash import xxh64_intdigest

    pieces = shingles(text, shingle)
    if not pieces:
        return np.zeros(words, dtype=np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), dtype=np.uint64, count=len(pieces))
    made = np.zeros(words, dtype=np.uint64)
    for k in range(words):
        set_bits = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 16384):
            part = _mixed(hashes[at : at + 16384], k)
            set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        made[k] = np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return made


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The SimHash of one text as an unsigned integer; 0 for a null text or one without words."""
    return int(wide_fingerprint(text, shingle, seed, 1)[0])


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), shingle: int = 3, words: int = 1) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint of ``text``, row by row: a signed 64-bit integer, or bytes if it has more words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [wide_fingerprint(x.as_py(), shingle, words=words) for x in b.column("_text")]
            fp = pa.array(np.array(made, dtype=np.uint64).reshape(-1).view(np.int64)) if words == 1 else pa.array([x.tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*keys, "fp"])

    taken = docs.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1]) + (", fp long" if words == 1 else ", fp binary")
    return taken.mapInArrow(run, schema)


def _syndromes() -> tuple[list[np.ndarray], np.ndarray]:
    """Tables of the Hamming code: the syndrome by byte of a block, and the masks to its anchors.

    Bit i of a block has the column i + 1; a word is an anchor if its columns' xor is zero.
    """
    tables = []
    for byte in range(4):
        table = np.zeros(256, dtype=np.uint8)
        for bit in range(8):
            if byte * 8 + bit < BLOCK_BITS:
                table[np.arange(256) >> bit & 1 == 1] ^= byte * 8 + bit + 1
        tables.append(table)
    masks = np.zeros((32, 16), dtype=np.uint64)
    for s in range(1, 32):
        flips = [1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i ^ s > i]
        masks[s, : len(flips)] = flips
    return tables, masks


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, visits, fp): a fingerprint's home anchor in each block and all that it visits."""
    tables, masks = _syndromes()
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        anchors, visits, who = [], [], []
        for block in (0, 1):
            x = fp >> np.uint64(block * BLOCK_BITS) & np.uint64((1 << BLOCK_BITS) - 1)
            s = np.zeros(len(x), dtype=np.uint8)
            for byte, table in enumerate(tables):
                s ^= table[(x >> np.uint64(8 * byte) & np.uint64(255)).astype(np.intp)]
            near = x[:, None] ^ masks[s]
            key = near + np.uint64(block << BLOCK_BITS)
            keep = np.ones_like(key, dtype=bool)
            keep[s == 0, 1:] = False
            anchors += [key[:, 0], key[keep]]
            visits += [np.zeros(len(x), dtype=bool), np.ones(int(keep.sum()), dtype=bool)]
            who += [fp, np.broadcast_to(fp[:, None], key.shape)[keep]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(visits)), pa.array(np.concatenate(who).view(np.int64))],
            names=["anchor", "visits", "fp"],
        )


def _forest(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all that the links between ``homes`` and ``visitors`` connect."""
    label, us, vs = np.arange(len(homes)), [], []
    step = max(1, 1_000_000 // len(homes))
    for at in range(0, len(visitors), step):
        part = visitors[at : at + step]
        row, home = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= max_bits)
        if not len(row):
            continue
        new = np.r_[True, row[1:] != row[:-1]]
        first = home[new][np.cumsum(new) - 1]
        us.append(part[row[new]])
        vs.append(homes[home[new]])
        while True:
            a, b = label[first], label[home]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    us.append(homes)
    vs.append(homes[label])
    u, v = np.concatenate(us), np.concatenate(vs)
    return u[u != v], v[u != v]


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (anchor, part), homes first: only a part's homes are ever held."""
        kept = None  # anchor, part and homes of the last part seen
        for b in (b for b in batches if b.num_rows):
            anchor, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part"))
            visits = b.column("visits").to_numpy(zero_copy_only=False)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(anchor)]
            us, vs = [], []
            n_homes = np.add.reduceat(~visits, starts, dtype=np.int64)
            for i in np.unique(np.r_[0, np.flatnonzero(n_homes)]):
                s, e, h = starts[i], ends[i], n_homes[i]
                carried = kept[2] if i == 0 and kept and kept[:2] == (anchor[s], part[s]) else None
                if not (h or carried is not None) or (e - s == 2 and h == 1 and carried is None and i < len(starts) - 1):
                    continue
                homes = fp[s : s + h] if carried is None else np.concatenate([carried, fp[s : s + h]])
                if i == len(starts) - 1:
                    kept = (anchor[s], part[s], homes)
                if e - s - h:
                    u, v = _forest(homes, fp[s + h : e], max_bits)
                    us.append(u)
                    vs.append(v)
            if kept and kept[:2] != (anchor[-1], part[-1]):
                kept = None
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return run


def _parted(placed: DataFrame, homes: DataFrame, part_homes: int) -> DataFrame:
    """``placed`` with ``parts``: of how many parts each anchor is made, by the count of its ``homes``."""
    counts = homes.groupBy("anchor").agg(F.ceil(F.count("*") / part_homes).cast("int").alias("parts"))
    hot = stored(counts.where("parts > 1"), "hot-anchors")
    n = hot.count()
    if not n:
        return placed.withColumn("parts", F.lit(1))
    return placed.join(F.broadcast(hot) if n <= BROADCAST_ANCHORS else hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def links(fps: DataFrame, max_bits: int = MAX_BITS, part_homes: int = PART_HOMES) -> DataFrame:
    """Edges (u, v) whose connected components are those of all links among distinct ``fp``."""
    if max_bits > 3:
        raise ValueError("two blocks find links of at most three bits")
    placed = fps.select("fp").mapInArrow(_replicate, "anchor long, visits boolean, fp long")
    placed = _parted(placed, placed.where("not visits"), part_homes)
    every, mine = F.sequence(F.lit(0), F.col("parts") - 1), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = placed.select("anchor", "visits", "fp", F.explode(F.when(F.col("visits"), every).otherwise(F.array(mine))).alias("part"))
    dealt = placed.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "visits")
    return dealt.select("anchor", "part", "visits", "fp").mapInArrow(_compare(max_bits), "u long, v long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each of a block's bits in the Golay code, and the nearest word's mask for each syndrome."""
    columns = []
    for bit in range(GOLAY):
        v = 1 << bit
        for i in range(22, 10, -1):  # the rest after division by the code's generator, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
            v ^= 0b110001110101 << (i - 11) if v >> i & 1 else 0
        columns.append(v)
    leaders = np.zeros(1 << 11, dtype=np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(GOLAY), n):
            syndrome = 0
            for i in bits:
                syndrome ^= columns[i]
            leaders[syndrome] = sum(1 << i for i in bits)
    return np.array(columns, dtype=np.int64), leaders


def exact_bits(n: int) -> int:
    """A block's exact bits for ``n`` fingerprints: its 2^12 code words hold ``BY_CHANCE`` on average."""
    return max(LEAST_EXACT, ceil(log2(max(n, 1) / BY_CHANCE)) - 12)


def differing(similarity: float) -> float:
    """The share of bits that two texts of this Jaccard similarity differ in, on average."""
    return acos(2 * similarity / (1 + similarity)) / pi


def blocks_for(exact: int, similarity: float = SIMILARITY, loss: float = LOSS) -> int:
    """Blocks such that pairs at the bound meet in one, but for ``loss`` of them.

    A pair whose bits differ with chance p shares a code word if the word's offset (uniform over
    those of up to three bits) still has at most three bits with the differences. Pairs at one
    similarity differ in more or fewer of their bits, so p itself is spread as the binomial of all bits is.
    """

    def meets(p: float) -> float:
        binomial = lambda n, k: comb(n, k) * p**k * (1 - p) ** (n - k)
        words = 0.0
        for w in range(4):
            words += comb(GOLAY, w) * sum(binomial(w, lost) * binomial(GOLAY - w, won) for lost in range(w + 1) for won in range(GOLAY - w + 1) if w - lost + won <= 3)
        return words / 2**11 * (1 - p) ** exact

    bits, share = WIDE * 64, differing(similarity)
    spread = [(comb(bits, k) * share**k * (1 - share) ** (bits - k), meets(k / bits)) for k in range(bits // 2)]
    blocks = 1
    while sum(weight * (1 - q) ** blocks for weight, q in spread) > loss:
        blocks += max(1, blocks // 50)
    return blocks


def _anchors(blocks: int, exact: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (anchor, fp): a wide fingerprint's anchor in each block, the block's number above its bits."""
        columns, leaders = _golay()
        size, rng = GOLAY + exact, np.random.default_rng(SEED)
        per = WIDE * 64 // size
        chosen = [x for _ in range(-(-blocks // per)) for x in rng.permutation(WIDE * 64)[: per * size].reshape(per, size)][:blocks]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                column = b.column("fp").slice(at, 4096)
                bits = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, WIDE * 8), axis=1)
                anchors = []
                for k, places in enumerate(chosen):
                    own = bits[:, places].astype(np.int64)
                    syndrome = np.bitwise_xor.reduce(own[:, :GOLAY] * columns, axis=1)
                    anchors.append((own << np.arange(size)).sum(axis=1) ^ leaders[syndrome] | k << size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.concat_arrays([column] * blocks)], names=["anchor", "fp"])

    return run


def _forest_of(bits: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The places of the pairs that make a minimum spanning forest."""
    root: dict[int, int] = {}
    kept = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for k in np.argsort(bits, kind="stable").tolist():
        a, c = find(int(u[k])), find(int(v[k]))
        if a != c:
            root[a] = c
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _fan_of(bits: np.ndarray, u: np.ndarray, v: np.ndarray, fan: int) -> tuple[np.ndarray, bool]:
    """The places of the pairs that are among the ``fan`` nearest of either end, and whether that leaves any out."""
    near = np.zeros(len(bits), dtype=bool)
    for end in (u, v):
        order = np.lexsort((bits, end))
        first = np.r_[0, np.flatnonzero(end[order][1:] != end[order][:-1]) + 1]
        sizes = np.diff(np.r_[first, len(order)])
        near[order[np.arange(len(order)) - np.repeat(first, sizes) < fan]] = True
    return np.flatnonzero(near), not near.all()


def _nearest(most: int, fan: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (u, v, more) of a part that differ in at most ``most`` bits: a minimum spanning forest of them.

        With ``fan``, each one's nearest partners of another ``root`` instead, and whether there are more. Rows
        come by (anchor, part), homes first; pairs have a home in them. Of a part that goes on in
        the next batch only the homes are held.
        """
        held = None
        for b in (b for b in batches if b.num_rows):
            anchor, part, visits = (b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part", "visits"))
            fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, WIDE)
            root = b.column("root").to_numpy(zero_copy_only=False) if fan else np.zeros(len(fp), dtype=np.int64)
            known = 0
            if held is not None and (held[0][-1], held[1][-1]) == (anchor[0], part[0]):
                known = len(held[0])
                anchor, part, visits, fp, root = (np.concatenate(x) for x in zip(held, (anchor, part, visits, fp, root), strict=True))
            group = np.r_[0, np.cumsum((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))]
            last = np.flatnonzero((group == group[-1]) & ~visits)
            held = (anchor[last], part[last], visits[last], fp[last], root[last]) if len(last) else None
            i, found = np.flatnonzero(~visits), []
            for k in range(1, len(group)):
                i = i[i + k < len(group)]
                i = i[group[i] == group[i + k]]
                if not len(i):
                    break
                own = i[root[i] != root[i + k]] if fan else i
                bits = np.bitwise_count(fp[own] ^ fp[own + k]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero((bits <= most) & (own + k >= known))
                found.append((bits[near], own[near], own[near] + k))
            if not found:
                continue
            bits, u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            kept, more = _fan_of(bits, u, v, fan) if fan else (_forest_of(bits, u, v), False)
            if len(kept):
                ends = [pa.array([x.tobytes() for x in fp[side[kept]]], pa.binary()) for side in (u, v)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array([more] * len(kept))], names=["u", "v", "more"])

    return run


def _verified(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column("s"), b.column("t"), strict=True):
                one, other = set(shingles(s.as_py(), shingle)), set(shingles(t.as_py(), shingle))
                keep.append(len(one & other) >= similarity * len(one | other))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(keep, pa.bool_())], names=["u", "v", "similar"])

    return run


def met_pairs(fps: DataFrame, n: int, similarity: float = SIMILARITY, part_homes: int | None = None, fan: int | None = None) -> DataFrame:
    """Pairs (u, v, more) of distinct wide ``fp`` that meet at an anchor and may be as similar as asked for.

    ``n`` is the count of all fingerprints, which decides the blocks. Of an anchor's pairs those of a
    minimum spanning forest are returned; with ``fan``, of ``fps`` with a ``root``, each one's so many nearest of another
    root, and whether an anchor has more.
    """
    share, exact = differing(similarity), exact_bits(n)
    most = ceil(WIDE * 64 * share + 3.2 * sqrt(WIDE * 64 * share * (1 - share)))
    own = fps.select("fp").mapInArrow(_anchors(blocks_for(exact, similarity), exact), "anchor long, fp binary")
    own = _parted(own, own, part_homes or PART_HOMES)
    every, mine = F.sequence(F.lit(0), F.col("parts") - 1), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    own = own.select("anchor", "fp", F.explode(every).alias("part"), mine.alias("mine")).withColumn("visits", F.col("part") != F.col("mine"))
    own = own.join(fps.select("fp", F.xxhash64("root").alias("root")), "fp") if fan else own.withColumn("root", F.lit(0).cast("long"))
    dealt = own.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "visits")
    columns = ["anchor", "part", "visits", "fp", *(["root"] if fan else [])]
    met = dealt.select(columns).mapInArrow(_nearest(most, fan), "u binary, v binary, more boolean")
    return met.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("more").alias("more"))


def checked_links(met: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs of ``met`` and ``similar``: whether their texts' shingles have that Jaccard similarity; ``texts`` has fp and text."""
    pairs = met.join(texts.select(F.col("fp").alias("u"), F.col("text").alias("s")), "u").join(texts.select(F.col("fp").alias("v"), F.col("text").alias("t")), "v")
    return pairs.select("u", "v", "s", "t").mapInArrow(_verified(shingle, similarity), "u binary, v binary, similar boolean")


def similar_roots(each: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (node, root): components of the distinct fingerprints ``each`` by verified links.

    ``texts_of`` gives the texts (fp, text) of some fingerprints. A near pair that the forests leave out lies in
    components that a failed check touches, for else their verified edges connect it. So only the fingerprints of such
    components are dealt to anchors again, and only pairs of different components are verified there, until no anchor has more.
    """
    n, fan = each.count(), FAN

    def verified(met: DataFrame) -> DataFrame:
        ends = met.select(F.col("u").alias("fp")).unionByName(met.select(F.col("v").alias("fp"))).distinct()
        return stored(checked_links(met, texts_of(ends), shingle, similarity), "checked-links")

    checked = verified(stored(met_pairs(each, n, similarity), "met-fingerprints"))
    failed, roots = checked.where("not similar"), components(checked.where("similar"))
    while not failed.isEmpty():
        rooted = stored(each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")
        ends = failed.select(F.col("u").alias("fp")).unionByName(failed.select(F.col("v").alias("fp"))).distinct()
        again = rooted.join(rooted.join(ends, "fp").select("root").distinct(), "root", "left_semi")
        met = stored(met_pairs(again, n, similarity, fan=fan), "met-again")
        new = verified(met.join(checked, ["u", "v"], "left_anti"))
        checked = checked.unionByName(new)
        roots = components(checked.where("similar"))
        if met.where("more").isEmpty():
            break
        failed, fan = checked.where("not similar"), fan * 8
    return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` and ``component_id``, the smallest id reachable.

    A null text counts as empty: fingerprint zero, linked like any other. Rows that repeat an id
    stay as they are. A null id gets the smallest id of its component, null if there is none.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    fps = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle), "fingerprints")
    each = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    # a fingerprint's root is the smallest of its component as a number; ids come in afterwards
    roots = components(links(each, max_bits))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    named = fps.join(by_fp, "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Texts link as ``checked_links`` says, or if they share a wide fingerprint; null texts and those without words are one
    group. Of rows that share the smallest id one stays, the first by its text's hash. Rows with a null id are
    told apart by their text and stay only if no row of their group has an id.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("hash", F.xxhash64("text"))
    fps = stored(fingerprints(own.select("doc_id", "hash", "text"), keys=("doc_id", "hash"), shingle=shingle, words=WIDE), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    each = stored(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))

    def texts_of(some: DataFrame) -> DataFrame:
        first = each.join(some, "fp").select("fp", F.col("least.doc_id").alias("k_id"), F.col("least.hash").alias("k_hash"))
        return stored(own.select("doc_id", "hash", "text").join(first, same).select("fp", "text").dropDuplicates(["fp"]), "met-texts")

    roots = similar_roots(each.select("fp"), texts_of, shingle, similarity)
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("k_id"), F.col("least.hash").alias("k_hash"))
    left = own.join(kept, same, "left_semi")
    repeats = fps.groupBy("doc_id", "hash").count().where("count > 1").limit(1).count()
    left = left.dropDuplicates(["doc_id", "hash"]) if repeats else left
    return left.select("row.*")
