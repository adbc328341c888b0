import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import packing, simhash, token_files
from tessella.llm.common import WordIds, byte_pieces, components, word_pieces
from tessella.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, fp string, component_id int"
SCHEMA_ROWS = "doc_id long, text string, u string, root string, n int"
TEXTS = ["", None, "one", "a b", "a b c d e f g h i j", "A B c d e f g h i j", "tab\tand\nline  double", "x" * 5000, "é ñ ü ß É", "a b c d e f g h i k"]


def brute_components(fps, max_bits=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_follows_its_definition():
    from xxhash import xxh64_intdigest

    text = "The quick brown\tFox jumps É over the quick brown fox"
    words = text.translate({i: i + 32 for i in range(65, 91)}).split()
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("Two Words") == xxh64_intdigest(b"two words", 42)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    fps = {}
    for i in range(40):
        base = rng.getrandbits(64)
        for j in range(rng.choice([1, 1, 2, 30])):
            fps[len(fps)] = base
            for bit in rng.sample(range(64), 2):
                base ^= 1 << bit
            if j % 3:
                base ^= 1 << rng.randrange(64)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in set(fps.values())]
    want = brute_components(fps)
    for part_homes in (1024, 4):
        roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame(signed, "fp long"), part_homes=part_homes)).collect()}
        got = {i: roots.get(v, v) for i, v in ((i, int(np.uint64(x).view(np.int64))) for i, x in fps.items())}
        groups = lambda m: sorted(sorted(i for i in m if m[i] == r) for r in set(m.values()))
        assert groups(got) == groups(want)


def test_near_duplicates_odd_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g h i j", "x", 1), (3, "a b", "x", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fps = {}
    for r in got:
        fps.setdefault(r["doc_id"], int(r["fingerprint"], 16))
    want = brute_components({k: v for k, v in fps.items() if k is not None})
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [4]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 6, 7, 8, 9]
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_golay_code_is_perfect():
    columns, leaders = simhash._golay()
    assert len(set(leaders.tolist())) == 1 << 11 and max(int(x).bit_count() for x in leaders) == 3


def similar_texts(n, seed=1):
    """Groups of texts, each made from one by replacing some of its words."""
    rng = random.Random(seed)
    words, texts = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(3000)], []
    for _ in range(n):
        base = rng.choices(words, k=rng.randrange(40, 300))
        for share in (0, 0, 0.01, 0.01, 0.02, 0.03, 0.04, 0.3):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    return texts


def jaccard_components(texts, similarity):
    own = {i: set(simhash.shingles(t, 5)) for i, t in texts.items()}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(own):
        for b in own:
            if a < b and len(own[a] & own[b]) >= similarity * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in own}


def test_similar_documents_against_brute_force_jaccard(spark, monkeypatch):
    texts = dict(enumerate(similar_texts(25)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], SCHEMA).repartition(4)
    want = {i for i, r in jaccard_components(texts, 0.8).items() if i == r}
    for homes in (1024, 2):
        monkeypatch.setattr(simhash, "PART_HOMES", homes)
        kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
        assert want <= kept  # nothing goes that is not a near-duplicate
        assert len(kept - want) <= 0.1 * (len(texts) - len(want))


def bound_pairs(n, seed, confounders=0):
    """Texts of 200 words: ``n`` pairs of a similarity from 0.80 to 0.83, each with so many others of 0.70 to 0.80 to both."""
    rng, texts, pairs = random.Random(seed), {}, []
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(20_000)]
    own = lambda t: set(simhash.shingles(" ".join(t), 5))
    alike = lambda a, b: len(a & b) / len(a | b)

    def changed(base, lo, hi, of):
        while True:
            made = list(base)
            for _ in range(rng.randrange(2, 9)):
                made[rng.randrange(200)] = rng.choice(words)
            if all(lo <= alike(own(made), x) < hi for x in of):
                return made

    for _ in range(n):
        a = rng.choices(words, k=200)
        b = changed(a, 0.80, 0.83, [own(a)])
        pairs.append((len(texts), len(texts) + 1))
        for t in (a, b, *(changed(a, 0.70, 0.80, [own(a), own(b)]) for _ in range(confounders))):
            texts[len(texts)] = " ".join(t)
    return texts, pairs


@pytest.mark.parametrize("n, seed, confounders", [(400, 1, 0), (40, 2, 6)])
def test_recall_at_the_bound(spark, n, seed, confounders):
    texts, pairs = bound_pairs(n, seed, confounders)
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts.items()], SCHEMA_ROWS).repartition(8)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    missed = sum(a in kept and b in kept for a, b in pairs)
    print("recall", 1 - missed / n)
    assert missed <= 0.05 * n
    assert len(texts) - len(kept) >= 0.95 * n
    if not confounders:
        assert all(a in kept or b in kept for a, b in pairs)


def test_blocks_follow_the_count():
    assert [simhash.exact_bits(n) for n in (0, 1000, 256 << 12, 256 << 20)] == [4, 4, 4, 8]
    assert simhash.blocks_for(8) > simhash.blocks_for(4) > simhash.blocks_for(4, 0.9)


def test_all_pairs_of_an_anchor_are_verified_in_the_end(spark, monkeypatch):
    """One anchor for all: the forest by bits is refuted, and what it left out is found, whatever the fan."""
    rng = random.Random(9)
    texts, _ = bound_pairs(4, 5, 6)
    order = list(texts.items())
    rng.shuffle(order)
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in order], SCHEMA_ROWS)

    def one_anchor(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([7] * b.num_rows, pa.int64()), "fp": b.column("fp")})

    monkeypatch.setattr(simhash, "blocks_for", lambda *a, **k: 1)
    monkeypatch.setattr(simhash, "_anchors", lambda blocks, exact: one_anchor)
    want = {i for i, r in jaccard_components(texts, 0.8).items() if i == r}
    for fan in (1, 32):
        monkeypatch.setattr(simhash, "FAN", fan)
        assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == want


def test_hot_anchors_give_the_same_links(spark):
    texts = similar_texts(3, seed=7)
    rows = [(bytearray(simhash.wide_fingerprint(t, 5).tobytes()),) for t in dict.fromkeys(texts)]
    fps = spark.createDataFrame(rows, "fp binary").distinct()
    groups = []
    for homes in (1024, 2):
        roots = components(simhash.met_pairs(fps, len(rows), part_homes=homes)).collect()
        by = {}
        for r in roots:
            by.setdefault(bytes(r["root"]), set()).add(bytes(r["node"]))
        groups.append(sorted(map(sorted, by.values())))
    assert groups[0] == groups[1] and len(groups[0]) == 3


@pytest.mark.parametrize("name, pieces", [("byte_bpe_50k.json", byte_pieces), ("word_bpe_49k.json", word_pieces)])
def test_pieces_give_the_tokenizers_ids(name, pieces):
    ids = WordIds(tokenizer(name), pieces, most=300)
    rng = random.Random(5)
    alphabet = list("abzAZ019.,!'\"-_ \n\t\r\x1c\x85\xa0 　éßΣςİ日本") + ["  ", "\n\n", " '", "'s", "'re", "é", "́", "<|endoftext|>"]
    plain = list("abcéßÉ  .,9²A")
    texts = ["".join(rng.choices(alphabet if i % 2 else plain, k=rng.randrange(30))) for i in range(4000)]
    for text, got in zip(texts, ids.encoded(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    words = [" ".join(f"wörd{rng.randrange(10**6):x}ab" for _ in range(50)) for _ in range(60)]
    for text, got in zip(words, ids.encoded(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, tmp_path):
    code = tokenizer("byte_bpe_50k.json")
    encode = WordIds(code, byte_pieces).tokenizer
    rows = [(7 - i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "again", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    files = token_files.write_tokens(docs, code, 0, f"file://{tmp_path}")
    got = token_files.read_tokens(files).orderBy("start").collect()
    want = {}
    for key, text, *_ in rows:
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(key, []).append((len(ids), crc32(ids.tobytes())))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), code, 0, f"file://{tmp_path}/none")).count() == 0


def test_reader_opens_only_what_it_needs(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = token_files.FrameWriter(f, 4)
        for i in range(50):
            w.add(i, np.arange(i, dtype="<u4").tobytes())
        w.close()
    data = path.read_bytes()
    with open(path, "rb") as f:
        r = token_files.FrameReader(f, len(data))
        seen = []
        monkeypatch.setattr(r, "frame", lambda k, g=r.frame: seen.append(k) or g(k))
        assert r.document(33).tolist() == list(range(33)) and len(seen) == 1
        assert r.document(99) is None
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # other readers pass over the tables
    with open(path, "r+b") as f:
        f.seek(int(r.offsets[2]) + int(r.seek["packed"][2]) - 6)
        f.write(b"\x00\x01")
    with open(path, "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(f, len(data)).frame(2)


def test_cutting_stock_covers_exactly_and_wastes_little():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 65)
    counts = rng.integers(0, 400, 64) // (sizes // 8 + 1)
    plan = packing.cutting_stock(sizes[counts > 0], counts[counts > 0], 64)
    made = sum(p * n for p, n in plan)
    assert (made == counts[counts > 0]).all()
    assert all((p * sizes[counts > 0]).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= np.ceil((sizes * counts).sum() / 64) * 1.01 + 1


def check_packed(rows, docs, length, encode):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for key, text in docs:
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length


def test_packing(spark):
    code = tokenizer("word_bpe_49k.json")
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["word", "other", "é", "thing."], k=rng.randrange(90)))) for i in range(300)] + [(900 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    rows = packing.pack_documents(df, code, 2, length=64).collect()
    check_packed(rows, docs, 64, WordIds(code, word_pieces).tokenizer)
    assert packing.pack_documents(df.limit(0), code, 2).count() == 0
    twice = packing.pack_documents(df.where(F.col("doc_id") == 904).union(df.where(F.col("doc_id") == 904)), code, 2).collect()
    assert len(twice) == 2
    none = packing.pack_documents(spark.createDataFrame([(None, "a b c", "x", 1), (None, None, "x", 1), (1, "word " * 30_000, "x", 1)], SCHEMA), code, 2).collect()
    assert sum(r["length"] for r in none) == 4 + 1 + 30_001 and sorted(r["length"] for r in none if r["doc_id"] is None) == [1, 4]


def test_packing_in_many_parts_and_with_any_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 7)
    rng = random.Random(4)
    rows = [(i, 0, rng.choice([64, 64, 64, rng.randrange(1, 64)]), "x", 5) for i in range(400)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, start long, length long, rank string, class int"), 64, 8).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(400)) and {r["rank"] for r in packed} == {"x"}
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 64


@pytest.mark.parametrize("name, pieces", [("byte_bpe_50k.json", byte_pieces), ("word_bpe_49k.json", word_pieces)])
def test_literal_special_tokens_are_as_the_file_names_them(name, pieces):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_str(tokenizer(name))
    texts = ["end <|endoftext|> more", "<|endoftext|>", "a<|endoftext|><|startoftext|>b's  \n", "<|EndOfText|> no", "<|endoftext| >", "plain", "", "end <|endoftext|>"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordIds(tokenizer(name), pieces).encoded(texts)] == want
    if name == "byte_bpe_50k.json":
        assert want[0] == [437, 220, 50256, 517]
