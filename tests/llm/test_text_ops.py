import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontamination, langid, line_dedup, pii, topk, toxicity, url_filter

SCHEMA = "doc_id long, text string, hash string, row string, n_chars long"


def cut_lines(text):
    return [y for x in re.findall(line_dedup.LINE, text) for y in (re.split(f"(?<={line_dedup.CUT})", x) if len(x) > line_dedup.LONG_CHARS else [x])]


def brute_lines(docs):
    """Texts after every run of lines that occurs earlier has lost its lines; docs in order."""
    seen, out = set(), {}
    for key, text in docs:
        lines = cut_lines(text or "")
        trimmed, gone = [x.strip(" \n\t\r") for x in lines], set()
        for i in range(len(lines)):
            n = 2 if i + 2 <= len(lines) and len(trimmed[i] + trimmed[i + 1]) >= line_dedup.RUN_CHARS else line_dedup.WINDOW
            if i + n > len(lines):
                continue
            w = tuple(trimmed[i : i + n])
            if w in seen:
                gone.update(range(i, i + n))
            seen.add(w)
        out[key] = "".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
    return out


def made_texts(n, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("ab cd ef gh ij kl".split(), k=rng.randrange(1, 5))) + rng.choice([",", ".", "!\n", ".\n"]) for _ in range(60)]
    passages = [" ".join(rng.choices(pool, k=rng.randrange(3, 9))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(pool, k=rng.randrange(8)))]
        if rng.random() < 0.5:
            parts += ["mid word " + rng.choice(passages) + " and on", rng.choice(pool)]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("shift", [0, -(1 << 62), (1 << 63) - 200])
def test_line_dedup_equals_brute_force(spark, shift):
    docs = [(shift + i, t) for i, t in enumerate(made_texts(60, 4))]
    docs += [(shift + 100, docs[7][1]), (shift + 101, ""), (shift + 102, None), (shift + 103, "a. " * 50), (shift + 104, "no end"), (shift + 105, "..,,\n\n")]
    words = ["".join(random.Random(k).choices("abdehlxo", k=5)) for k in range(300)]
    passage = " ".join(words[:60])
    docs += [(shift + 110 + k, f"{' '.join(words[70 + 20 * k : 90 + 20 * k])} {passage} {' '.join(words[90 + 20 * k : 97 + 20 * k])}") for k in range(5)]
    docs += [(shift + 120, "a." * 40_000), (shift + 121, "word" * 300_000)]
    rows = [(k, t, "x", "y", len(t or "")) for k, t in docs]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(df).collect()}
    assert got == brute_lines(docs)
    assert all(len(got[shift + 110 + k].split()) <= 27 + 20 for k in range(1, 5))  # of the passage without a comma a line at either end may stay
    assert line_dedup.clean_documents(df).columns == ["doc_id", "text", "hash", "row", "n_chars"]
    assert line_dedup.clean_documents(df.limit(0)).count() == 0


def test_line_dedup_odd_ids(spark):
    text = "One line. Two lines, three lines. Four lines. Five."
    for t in (text, "a b " * 90, " \t" * 60 + "x. y", "x" * 300 + " ad" * 40 + "\n\n" + "word " * 200 + "."):
        assert "".join(cut_lines(t)) == t
    rows = [(None, text, "x", "y", 1), (5, text, "x", "y", 1), (5, text, "x", "y", 1), (2, "Other. " + text, "x", "y", 1)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in line_dedup.clean_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 2, "Other. " + text), (False, 5, ""), (False, 5, ""), (True, 0, "")]


def test_line_dedup_uses_no_python(spark):
    docs = spark.createDataFrame([(1, "a. b. c. d. e.", "x", "y", 1)], SCHEMA)
    assert line_dedup.drop_repeated_runs(docs).columns == ["row", "doc_id", "text", "removed_lines"]
    plan = line_dedup.drop_repeated_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("first", [-(1 << 32) - 2, -(1 << 32), (1 << 32) - 60, (1 << 32) - 58])
def test_line_dedup_ids_at_the_end_of_narrow_places(spark, first):
    docs = [(first + i, t) for i, t in enumerate(made_texts(60, 6))]
    df = spark.createDataFrame([(k, t, "x", "y", len(t)) for k, t in docs], SCHEMA).repartition(3)
    assert {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(df).collect()} == brute_lines(docs)


def test_line_dedup_computes_fingerprints_once(spark, monkeypatch):
    plans, stored = {}, line_dedup.stored

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", kept)
    docs = [(i, t, "x", "y", len(t)) for i, t in enumerate(made_texts(20, 5))]
    line_dedup.drop_repeated_runs(spark.createDataFrame(docs, SCHEMA))
    assert plans["line-hashes"].count("array_distinct(") == 1
    assert "decimal" not in plans["first-runs"] and "slice(" not in plans["line-runs"]


INSULTS = ["blorgface", "zankhead", "wuggle"]


def labelled(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = rng.choices(words, k=rng.randrange(40, 200))
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_on_held_out_texts():
    model = toxicity.fit([(t, y) for _, t, y in labelled(400, 1)])
    pack, right = model.compressors(), 0
    test = labelled(200, 2)
    scores = model.score(np.array([model.features(t, pack) for _, t, _ in test]))
    right = sum((s >= toxicity.THRESHOLD) == bool(y) for s, (_, _, y) in zip(scores, test, strict=True))
    assert right >= 190 and ((scores >= 0) & (scores <= 1)).all()
    assert 0 <= model.score(np.array([model.features("", pack)]))[0] < toxicity.THRESHOLD


def test_toxicity_scores_follow_the_dictionaries(spark):
    """Window lengths and the logistic sum computed apart, over the model's two dictionaries."""
    import zstandard as z

    rows = labelled(120, 5)
    model = toxicity.fit([(t, y) for _, t, y in rows])
    how = z.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=toxicity.MIN_MATCH, strategy=toxicity.STRATEGY, write_content_size=False, write_checksum=False, write_dict_id=False)
    packers = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d + toxicity.MARK.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (model.ordinary, model.toxic)]

    def brute(text):
        words, saved = text.lower().split(), []
        while words:
            window = f"{toxicity.MARK} {' '.join(words[:8])} ".encode()
            saved.append(len(packers[0].compress(window)) - len(packers[1].compress(window)))
            words = words[8:]
        x = [1.0, *(math.log(1 + sum(s >= k for s in saved)) for k in toxicity.SAVED), math.log(1 + len(saved))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    texts = [(i, t) for i, t, _ in rows[:30]] + [(900, None), (901, ""), (902, "x " * 50_000), (903, rows[0][1])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        assert got[i] == pytest.approx(brute(t or ""))


def test_toxicity_copies_stay_on_one_side_and_shared_headers_do_not_tie():
    rows = labelled(80, 6)
    header = "this site and all that it holds is offered as it is to all of you"
    texts = [(f"{header} {t}", y) for _, t, y in rows]
    near = [(t + " more", y) for t, y in texts]
    halves = toxicity._halves(texts + near)
    assert sorted(halves[0] + halves[1]) == sorted(texts + near)
    sides = {t: k for k, half in enumerate(halves) for t, _ in half}
    assert all(sides[t] == sides[t + " more"] for t, _ in texts)
    assert all(abs(sum(y == k for _, y in halves[0]) - sum(y == k for _, y in halves[1])) <= 4 for k in (0, 1))
    model = toxicity.fit(texts)
    pack = model.compressors()
    assert len({round(float(model.score(model.features(t, pack))), 6) for t, _ in texts}) > 2
    assert toxicity.fit([]).weights[0] == 0.0


def test_drop_toxic_keeps_clashing_names_and_repeats(spark):
    model = toxicity.fit([(t, y) for _, t, y in labelled(200, 3)])
    rows = [("x", "1", "a quiet text"), ("x", "1", "a quiet text"), (None, "2", None), ("y", "3", "")]
    docs = spark.createDataFrame(rows, "row string, score string, text string")
    got = toxicity.drop_toxic(docs, model)
    assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
    assert got.where("row = 'x'").count() in (0, 2)


def test_toxicity_in_spark(spark):
    rows = labelled(200, 3)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t, _ in rows] + [(None, "no id", "x", "y", 1), (900, None, "x", "y", 1), (901, "", "x", "y", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.sample(docs, labels, F.col("doc_id") % 3 != 1))
    assert toxicity.score(docs, model).count() == 203
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {None, 900, 901} <= ids and len([i for i, _, y in rows if y and i in ids]) <= 10
    assert toxicity.fit([]).score(np.zeros((1, 8)))[0] <= 1
    assert toxicity.score(docs.limit(0), toxicity.fit([("a", 1)])).count() == 0


def all_cuts(word, prob):
    """Logarithm of the sum over all segmentations, each position from the ones before it."""
    sums = [1.0]
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[start] * prob[word[start:end]] for start in range(end) if word[start:end] in prob))
    return math.log(sums[-1])


def test_language_scores_sum_all_segmentations(monkeypatch):
    pieces = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "abcabcabcabcabcabcabcabcabca"]
    rng = np.random.default_rng(0)
    prob = np.vstack([rng.random((len(pieces), 2)) / 5, np.full((1, 2), langid.UNKNOWN)])
    words = {"a", "abc", "cab", "abcabcab", "bb", "abc" * 13, "abd", *("".join(random.Random(k).choices("abc", k=k)) for k in range(9, 200, 10))}
    for letters in (100_000, 50):
        monkeypatch.setattr(langid, "BATCH_LETTERS", letters)
        s = langid.LanguageModel(pieces, ["x", "y"], np.log(prob)).scorer()
        s.learn(words)
        for w in words:
            want = [all_cuts("▁" + w, {**dict(zip(pieces, prob[:, k], strict=False)), "d": langid.UNKNOWN}) for k in (0, 1)]
            assert np.allclose(s.scores[s.known[w]], want)
    long = "abc" * 30_000
    s.learn({long})
    assert np.isfinite(s.scores[s.known[long]]).all() and s.scores[s.known[long]].max() < -1000


def test_language_training_follows_expectation_maximisation():
    pieces, counts = ["a", "b", "ab", "▁", "▁a"], {"ab": 3, "b": 2, "abab": 1, "ax": 1}
    prob = dict.fromkeys(pieces, 1 / len(pieces)) | {"x": langid.UNKNOWN}

    def cuts(word):
        if not word:
            return [[]]
        return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in prob for rest in cuts(word[k:])]

    for _ in range(langid.ROUNDS):
        expected = dict.fromkeys(prob, 0.0)
        for word, n in counts.items():
            each = [(c, math.prod(prob[p] for p in c)) for c in cuts("▁" + word)]
            for c, q in each:
                for p in c:
                    expected[p] += n * q / sum(x for _, x in each)
        known = sum(expected[p] for p in pieces)
        prob |= {p: (expected[p] + langid.SMOOTH) / (known + langid.SMOOTH * len(pieces)) for p in pieces}
    lattice = langid.Lattice(pieces)
    assert np.allclose(np.exp(langid.train(lattice, len(pieces), counts)[:-1]), [prob[p] for p in pieces])


def test_language_prediction(spark):
    rng = random.Random(1)
    parts = {"aa": "ka la mo ri tu".split(), "bb": "schi stro gnu wra ple".split(), "cc": "ka la schi stro xo".split()}
    text = lambda k: " ".join("".join(rng.choices(parts[k], k=rng.randrange(1, 4))) for _ in range(30))
    rows = [(i, text(k), k, "row", 1) for i, k in enumerate(rng.choices(list(parts), k=180))]
    odd = [(900, None, "aa", "row", 1), (901, "12 ?!", None, "row", 1), (902, "", "bb", "row", 1), (None, "ka", None, "row", 1), (903, "ka" * 200_000, None, "row", 1)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, score string, n long")
    counts = langid.sample(docs, F.col("doc_id") % 3 != 1)
    want = {}
    for i, t, k, *_ in [*rows, *odd]:
        if i is not None and i % 3 != 1 and t and k:
            for w in langid.words_of(t):
                want.setdefault(k, {}).setdefault(w, 0)
                want[k][w] += 1
    assert {k: dict(c) for k, c in counts.items()} == want
    model = langid.fit(counts, ["▁ka", "la", "sch", "str", "gn", *"abcdefghijklmnopqrstuvwxyz"])
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    test = [r for r in rows if r[0] % 3 == 1]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in test) >= 0.95 * len(test)
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows) + 5
    assert langid.Scorer(langid.fit({}, ["a"])).predict(["ka"]) == (["und"], [0.0])
    assert langid.sample(docs.limit(0), F.col("doc_id") % 3 != 1) == {}


def items(seed=0, n=30):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) for _ in range(150)]
    say = lambda k: " ".join(rng.choices(words[:20] if rng.random() < 0.5 else words, k=k))
    return rng, words, [(i, f"{say(rng.randrange(8, 30))}. {say(rng.randrange(2, 9))}.") for i in range(n)]


def test_wand_finds_all_above_the_threshold():
    rng, words, its = items()
    from collections import Counter

    df = Counter(t for _, x in its for t in set(decontamination.terms_of(x)))
    index = decontamination.ItemIndex(its, len(its), df, sum(len(decontamination.terms_of(x)) for _, x in its) / len(its), max(len(decontamination.terms_of(x)) for _, x in its))
    for least in (0.2, 0.55):
        for _ in range(200):
            base = decontamination.terms_of(rng.choice(its)[1]) if rng.random() < 0.5 else []
            said = rng.sample(base, len(base) * rng.randrange(5, 11) // 10) + rng.choices(words, k=20)
            terms = sorted({index.term[w] for w in said if w in index.term})
            want = {}
            for t in terms:
                for d, w in zip(index.docs[t], index.weights[t], strict=True):
                    want[d] = want.get(d, 0) + w
            want = sorted((d, round(s, 9)) for d, s in want.items() if s >= least)
            assert sorted((d, round(s, 9)) for d, s in index.search(terms, least)) == want


def test_decontamination(spark, monkeypatch):
    rng, words, its = items(1)
    clean = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 400))), "x", "y", 1) for i in range(60)]
    leaks = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(200))) + " " + its[i][1].upper() + " " + " ".join(rng.choices(words, k=rng.randrange(200))), "x", "y", 1) for i in range(20)]
    docs = spark.createDataFrame([*clean, *leaks, (200, "", "x", "y", 1), (201, None, "x", "y", 1), (None, its[3][1], "x", "y", 1)], SCHEMA)
    bench = spark.createDataFrame([*its, (99, None), (98, ""), its[0]], "item_id long, text string")
    for most in (20_000, 7):
        monkeypatch.setattr(decontamination, "SHARD_ITEMS", most)
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
        assert got == {(100 + i, i) for i in range(20)} | {(None, 3)}
        kept = decontamination.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(60), 200, 201}
    nameless = spark.createDataFrame([(None, its[0][1]), (-1, its[1][1])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, nameless).collect()} == {(100, None), (101, -1)}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs.limit(0), bench).count() == 0


def test_items_of_very_different_lengths_in_any_number_of_indexes(spark, monkeypatch):
    rng, words, its = items(3)
    long = " ".join(rng.choices(words, k=900)) + ". The last one ends it all here."
    its = [*its, (500, long), (501, "A short one? Of five terms only."), (502, "e\u0301t\u0301 a\u0301 marks. Are no terms.")]
    between = lambda: " ".join(rng.choices(words, k=rng.randrange(300, 700)))
    docs = [(i, f"{between()} {x} {between()}", "x", "y", 1) for i, x in its] + [(900, its[0][1], "x", "y", 1)] * 3 + [(901, f"{between()} {long} {between()} " * 12, "x", "y", 1)]
    df = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("hash", "hits").withColumnRenamed("row", "item_id")
    bench = spark.createDataFrame(its, "item_id long, text string")
    found = {}
    for most in (20_000, 7):
        monkeypatch.setattr(decontamination, "SHARD_ITEMS", most)
        found[most] = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in decontamination.contaminated(df, bench).collect())
        kept = decontamination.drop_contaminated(df, bench)
        assert kept.columns == df.columns and kept.count() == 0
    assert found[7] == found[20_000] and sum(r[0] == 900 for r in found[7]) == 3
    assert {(i, i) for i, _ in its} | {(901, 500)} <= {r[:2] for r in found[7]}


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.integers(-3, 3, 8).astype(float).tolist() if i % 3 else [0.5] * 8) for i in range(260)]
    bad = [(300, None), (350, [1.0, None] * 4), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (None, [1.0] * 8), (500, [1.0] * 3)]
    df = spark.createDataFrame([(*v, 1) for v in vectors + bad], "vec_id long, embedding array<double>, label int").repartition(6)
    monkeypatch.setattr(topk, "LEAST_ROWS", 40)
    monkeypatch.setattr(topk, "BINS", 16)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors}
    want = []
    for q in range(0, 260, 50):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    few = spark.createDataFrame([(0, [1.0, -2.0]), (7, [0.5, 1.0]), (8, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 8, -65536), (0, 2, 7, -98304)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("bins", [16, 1 << 18])
def test_top_k_with_large_components(spark, monkeypatch, bins):
    """Every finite component takes part; scores that no long holds count as the nearest that one does."""
    monkeypatch.setattr(topk, "BINS", bins)
    rng = random.Random(6)
    sizes = [1.0, 1e3, 1e7, 1e10, 1e17, 1e100, 1.7e308]
    vectors = [(i, [rng.choice([-1, 0, 1]) * rng.random() * rng.choice(sizes[: 2 + i % 6]) for _ in range(4)]) for i in range(120)]
    vectors += [(150, [0.5, 0.25, -1.0, 2.0]), (151, [1e308, -1e308, 0.0, 1.0]), (200, [1.0, 1.0, 1.0, 1.0]), (250, [])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    ints = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in vectors}
    want = []
    for q in (0, 50, 100, 150, 200):
        score = lambda c: min(max(sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        best = sorted((-score(c), c) for c in ints if c != q and ints[c])[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_url_parts_and_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?y#z", "x://example.net/EN/", "http://org/fr/", "http://xorg/fr/", "http://b.org/fr?x", "http://net", "http://NET?/", "no scheme", None, "http://example.com/de/a://b", "://h.net/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(url_filter.judge(df).collect(), key=lambda r: r["page_id"])]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/EN/", "net/", "block"), ("org", "/fr/", "org/fr/", "allow"), ("xorg", "/fr/", None, "allow"),
        ("b.org", "/fr", None, "allow"), ("net", "", None, "allow"), ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.com", "/de/a://b", "example.com/de/", "block"), ("h.net", "/", "net/", "block"),
    ]


def brute_rank(edges, seeds, steps=200):
    out = {}
    for a, b, n in edges:
        out.setdefault(a, []).append((b, n))
    total, fresh = dict(seeds), dict(seeds)
    for _ in range(steps):
        moved = {}
        for h, v in fresh.items():
            for b, n in out.get(h, []):
                moved[b] = moved.get(b, 0) + v * 0.85 * n / sum(x for _, x in out[h])
        fresh = moved
        for h, v in fresh.items():
            total[h] = total.get(h, 0) + v
    return total


def test_propagation_equals_brute_force(spark):
    rng = random.Random(2)
    edges = list({(a, b): (f"h{a}", f"h{b}", rng.randrange(1, 5)) for a in range(12) for b in rng.sample(range(12), 2) if a != b}.values())
    seeds = [("h0", 1.0, 0.0), ("h5", 0.0, 1.0), ("h6", 0.25, 0.5)]
    got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, pages long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"))
    got = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    trust = brute_rank(edges, {h: t for h, t, _ in seeds if t})
    distrust = brute_rank([(b, a, n) for a, b, n in edges], {h: d for h, _, d in seeds if d})
    for h in set(trust) | set(distrust):
        assert got[h] == pytest.approx((trust.get(h, 0), distrust.get(h, 0)), abs=1e-3)


def test_weight_that_fans_out_and_in_again_arrives(spark):
    n = 20_000
    edges = spark.range(n).select(F.lit("seed").alias("src"), F.concat(F.lit("h"), "id").alias("dst"), F.lit(1).alias("pages"))
    edges = edges.union(spark.range(n).select(F.concat(F.lit("h"), "id"), F.lit("hub"), F.lit(1)))
    got = url_filter.propagate(edges, spark.createDataFrame([("seed", 1.0, 0.0)], "host string, trusted double, blocked double"))
    ranks = {r["host"]: r["trust"] for r in got.where("host in ('hub', 'seed', 'h7')").collect()}
    assert ranks["hub"] == pytest.approx(0.85**2, abs=1e-3) and ranks["h7"] == pytest.approx(0.85 / n) and ranks["seed"] == 1
    assert got.count() == n + 2


def brute_judge(pages, rules):
    """The whole judgement with dictionaries; absolute links by a plain scan of quoted hrefs."""

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    ruled, edges, hosts = [], {}, {}
    for key, url, html in pages:
        host, path = parts(url)
        fits = [r for r in rules if (host == r[0].split("/", 1)[0] or host.endswith("." + r[0].split("/", 1)[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda r: len(r[0])) if fits else (None, None)
        ruled.append((key, host, path, rule, verdict))
        if host:
            hosts.setdefault(host, []).append(verdict)
        for to in set(re.findall(' href="(http://[^"]+)"', html or "")):
            dst = parts(to)[0]
            if host and dst != host:
                edges[host, dst] = edges.get((host, dst), 0) + 1
    trust = brute_rank([(a, b, n) for (a, b), n in edges.items()], {h: v.count("allow") / len(v) for h, v in hosts.items() if "allow" in v})
    distrust = brute_rank([(b, a, n) for (a, b), n in edges.items()], {h: v.count("block") / len(v) for h, v in hosts.items() if "block" in v})
    bad = lambda h: distrust.get(h, 0) >= 0.5 and distrust.get(h, 0) > trust.get(h, 0)
    return sorted((k, h, p, r, v or ("block" if bad(h) else "allow")) for k, h, p, r, v in ruled)


def test_judgement_equals_brute_force_on_linked_pages(spark):
    rng, rules = random.Random(8), (("bad.net/", "block"), ("good.org/", "allow"), ("bad.net/fine/", "allow"), ("mixed.io/x", "block"))
    hosts = ["bad.net", "Sub.Bad.net", "good.org", "mixed.io", *(f"h{i}.com" for i in range(14))]
    pages = []
    for i in range(160):
        host = hosts[i % len(hosts)]
        links = "".join(f'<a href="http://{rng.choice(hosts if host[0] in "hm" else hosts[4:])}/p{rng.randrange(9)}?q=1">x</a>' for _ in range(rng.randrange(4)))
        pages.append((i, f"http://{host}/{rng.choice(['', 'fine/', 'x', 'y?z', 'fine/a#b'])}", links + '<a data-href="http://bad.net/">no link</a>' + "<p>long</p>" * (40_000 if i == 9 else 1)))
    pages += [(900, None, None), (901, "", ""), (902, "no scheme", "<a>"), (903, "http://h1.com/", None), pages[5], pages[5]]
    df = spark.createDataFrame([(*p, "h", 1.0) for p in pages], "page_id long, url string, html string, host string, trust double")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect())
    assert str(got) == str([(k, h, p, r, v) for k, h, p, r, v in brute_judge(pages, rules)])
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_links_to_blocked_hosts_block(spark):
    pages = [(1, "http://bad.net/", ""), (2, "http://feeder.io/", '<a href="http://bad.net/x">a</a> <a href="/own">b</a>'), (3, "http://fine.io/", "<a HREF='//other.io/z'>a</a>"), (4, "http://other.io/", None)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


KEY = b"test"


def test_entities_and_surrogates():
    text = 'Mail Bob.X@Mail.example.com, call +1 (988) 555-2485 or card 4111 1111 1111 1111; ip 10.20.30.240, token = "0641917ea4e9feb9cda83477b57ac2654884f485" for Frau Schmidt and Mr. Иван Орлов, ssn 123-45-6789.'
    found = {k: text[s:e] for s, e, k, _ in pii.entities(text)}
    assert found == {"email": "Bob.X@Mail.example.com", "phone": "+1 (988) 555-2485", "card": "4111 1111 1111 1111", "ip": "10.20.30.240", "secret": "0641917ea4e9feb9cda83477b57ac2654884f485", "name-f": "Schmidt", "name-m": "Иван Орлов", "ssn": "123-45-6789"}
    for s, e, kind, form in pii.entities(text):
        made = pii.styled(kind, text[s:e], pii.surrogate(KEY, kind, form))
        assert made != text[s:e] and pii.surrogate(KEY, kind, form) == pii.surrogate(KEY, kind, form) != pii.surrogate(b"other", kind, form)
        if kind in ("phone", "card", "ssn"):
            assert re.sub(r"\d", "9", made) == re.sub(r"\d", "9", text[s:e])
        if kind == "card":
            assert pii._luhn(re.sub(r"\D", "", made)) == 0
        if kind == "name-m":
            assert re.fullmatch("[А-Яа-я]+ [А-Яа-я]+", made)
    assert pii.entities("nothing here, not 12 nor 3.4") == []


def test_replacement_keeps_distinct_and_alike(spark):
    rng = random.Random(1)
    mails = [f"user{i}@mail{i % 3}.example.com" for i in range(40)]
    rows = [(i, f"write {mails[i % 40]} or {mails[(i * 7) % 40].upper()} to Mr Keller and Mrs Vera Costa {i}", "x", "y", 1) for i in range(80)]
    rows += [(90, None, "x", "y", 1), (91, "", "x", "y", 1), (92, "clean", "x", "y", 1), (92, "clean", "x", "y", 1), (None, mails[0], "x", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pii.replace(docs, KEY).select("row.doc_id", F.col("row.text").alias("old"), "text", "n_entities").collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        if not r["n_entities"]:
            assert r["text"] == r["old"]
            continue
        for a, b in zip(pii.entities(r["old"]), pii.entities(r["text"]), strict=True):
            assert of.setdefault((a[2], a[3]), b[3]) == b[3] and a[2] == b[2]
    assert len(set(of.values())) == len(of) and not set(of.values()) & {k for _, k in of}
    assert pii.replace(docs.limit(0), KEY).count() == 0


def test_collisions_are_drawn_again(spark, monkeypatch):
    many = spark.createDataFrame([("name-m", f"person {i}") for i in range(300)] + [("name-f", "person 1")], "kind string, form string")
    made = [r["made"] for r in pii.assign(many, KEY).collect()]
    assert len(made) == len(set(made)) == 301


def test_forms_with_nothing_to_vary_end(spark):
    rows = [("secret", "________"), ("secret", "--------"), ("email", "_@_.com"), ("email", "--@--.--")]
    rows += [("ip", f"{i}.{j}.{k}.{m}") for i in range(10) for j in range(10) for k in range(10) for m in range(7)]
    made = {(r["kind"], r["form"]): r["made"] for r in pii.assign(spark.createDataFrame(rows, "kind string, form string"), KEY).collect()}
    assert len(made) == len(set(made.values())) == len(rows) and not set(made.values()) & {f for _, f in rows}


def test_a_persons_mentions_agree(spark):
    text = "Mr John Smith came. Later John Smith left, Mr Smith said. Dr John Smith and JOHN agree: Smith is a smithy.\nDear Mrs\nVera Costa, Costa"
    other = "Dr John Smith wrote; nobody else did."
    rows = [(1, text, "x", "y", 1), (2, other, "x", "y", 1)]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(rows, SCHEMA), KEY).select("row.doc_id", "text").collect()}
    assert not re.search("(?i)john|smith\\b|vera|costa", got[1] + got[2])
    first, last = re.match(r"Mr (\w+) (\w+) came", got[1]).groups()
    woman = re.search(r"Dear Mrs\s(\w+) (\w+),", got[1]).groups()
    start = f"Mr {first} {last} came. Later {first} {last} left, Mr {last} said. Dr {first} {last} and {first.upper()} agree: {last} is a smithy.\n"
    assert got[1] == f"{start}Dear Mrs\n{woman[0]} {woman[1]}, {woman[1]}" and got[2] == f"Dr {first} {last} wrote; nobody else did."


def test_parts_of_two_names_stay_apart():
    text = "Mr John Smith met Mrs Mary Smith. Mrs Smith spoke, then Smith. Mr Smith\nwas there."
    assert [(text[s:e], k, f) for s, e, k, f in pii.entities(text)] == [
        ("John Smith", "name-m", "john smith"), ("Mary Smith", "name-f", "mary smith"), ("Smith", "name-f", "mary smith"), ("Smith", "name-n", "smith"), ("Smith", "name-m", "john smith"),
    ]


def test_texts_that_begin_alike_all_count(monkeypatch):
    header, seen = "The same header line stands at the start of all of these texts. ", []
    monkeypatch.setattr(toxicity, "_dictionaries", lambda rows: seen.append(rows) or toxicity.ToxicityModel(b"a", b"b", []))
    rows = [(f"{header}word{i}", i % 2) for i in range(40)] + [(f"{header}word1", 0)]
    toxicity.fit(rows + rows[:7])
    assert sorted(seen[-1]) == sorted(rows)
