import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import fill_middle
from tessella.llm.fill_middle import ArrayContainer, BitmapContainer, BoundarySet, RunContainer


def brute_places(data: bytes, unit: str) -> list[int]:
    white = b" \t\n\x0b\x0c\r"
    starts = {
        "char": lambda i: data[i] & 0xC0 != 0x80,
        "line": lambda i: data[i - 1 : i] == b"\n",
        "word": lambda i: data[i] not in white and data[i - 1] in white,
    }[unit]
    return sorted({0, len(data)} | {i for i in range(1, len(data)) if starts(i)})


def texts():
    rng = random.Random(5)
    yield from ("", "a", "é", " two words\nline\r\n\n end ", "日本語 テキスト\n", "\n")
    for size in (300, 65_530, 65_536, 65_537, 200_000):
        yield "x" * size
        yield "".join(rng.choice("aé日𝄞 \n") for _ in range(size // 2))
        yield "".join(rng.choice("abcdefgh" * 90 + " \n") for _ in range(size))


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_select_and_rank_equal_brute_force(unit):
    rng = random.Random(1)
    for text in texts():
        data = text.encode()
        places, want = BoundarySet(data, unit), brute_places(data, unit)
        assert len(places) == len(want)
        for k in {0, len(want) - 1, *(rng.randrange(len(want)) for _ in range(200))}:
            assert places.select(k) == want[k]
            assert places.rank(want[k]) == k
        for _ in range(50):
            at = rng.randrange(len(data) + 1)
            assert places.rank(at) == np.searchsorted(want, at)
    with pytest.raises(IndexError):
        BoundarySet(b"ab").select(3)


def test_every_kind_of_container_occurs():
    kinds = {type(c) for t in texts() for u in fill_middle.UNITS for c in BoundarySet(t.encode(), u).containers}
    assert kinds == {ArrayContainer, BitmapContainer, RunContainer}


def brute(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_rows_equal_brute_force_and_come_back(spark):
    odd = [None, "", "x", "<", "<P", "a<S>b", "<<<<<S<", "né", "🎈🎈 ok\r\n", "long " * 30_000, "<M", "P>S>M>"]
    rows = [(i, t, "o") for i, t in enumerate(odd * 12)] + [(3, "<", "o"), (None, "no id", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumnRenamed("output", "odd`name".replace("`", "."))
    made = fill_middle.fill_in_middle(docs)
    got = made.withColumn("restored", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == brute(r["row"]["doc_id"], r["row"]["text"])
        assert r["restored"] == (r["row"]["text"] or "")
        if r["form"] != "plain":
            data = r["restored"].encode()
            assert len(data[: r["prefix_bytes"]].decode()) == r["prefix_units"]
            assert len(data[r["prefix_bytes"] :][: r["middle_bytes"]].decode()) == r["middle_units"]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_units_clashing_names_and_an_empty_table(spark):
    docs = spark.createDataFrame([(i, f"one two\nthree {i}\n\nfour") for i in range(40)], "row long, output string")
    for unit, n in (("line", 4), ("word", 5)):
        got = fill_middle.fill_in_middle(docs, unit, doc_id="row", text="output", plain_percent=0).collect()
        assert {r["n"] for r in got} == {n} and {r["form"] for r in got} == {"psm", "spm"}
        for r in got:
            data, places = r["row"]["output"].encode(), brute_places(r["row"]["output"].encode(), unit)
            assert {r["prefix_bytes"], r["prefix_bytes"] + r["middle_bytes"]} <= set(places) and data
    assert fill_middle.fill_in_middle(docs.limit(0), doc_id="row", text="output").count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, "sentence")
