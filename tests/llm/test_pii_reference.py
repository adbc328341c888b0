"""Surrogates against an independent reference: planted entities at known places, checked by type, distinctness and coreference."""

import random
import re
import unicodedata

from tessella.llm import pii

KEY = b"reference"
NAMES = {"latin": ["Johann Kruse", "Zoltan Nagy", "Ada Byron"], "greek": ["Γιώργος Παππάς", "Μελίνα Μερκούρη"], "cyrillic": ["Пётр Чехов"], "arabic": ["محمد علي"], "cjk": ["王小明", "李雷"], "hangul": ["김철수"], "hiragana": ["さくら"], "katakana": ["タナカ"], "devanagari": ["रमश कमर"], "hebrew": ["דוד לוי"], "thai": ["สมชาย"]}


def script(text):
    kinds = {unicodedata.name(c).split()[0].lower() for c in text if c.isalpha()}
    assert len(kinds) == 1, (text, kinds)
    return kinds.pop()


def mod97(iban):
    s = iban.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def shape(text):
    return re.sub("[^\\W\\d_]", "a", re.sub(r"\d", "9", text))


def planted(seed):
    """Templates with named holes, and what fills each: the same entity in several formats and texts."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    fill = {}
    for i in range(40):
        body = "4" + digits(14)
        card = next(body + c for c in "0123456789" if luhn(body + c) == 0)
        fill[f"card{i}"] = [card, " ".join(card[k : k + 4] for k in range(0, 16, 4)), "-".join(card[k : k + 4] for k in range(0, 16, 4))]
        account = digits(18)
        iban = "DE" + pii.iban_check("DE", account) + account
        fill[f"iban{i}"] = [iban, " ".join(iban[k : k + 4] for k in range(0, 22, 4))]
        code = rng.choice(["1", "49", "44", "353", "380", "7"])
        a, b, c = digits(3), digits(3), digits(4)
        fill[f"phone{i}"] = [f"+{code} {a} {b} {c}", f"+{code}-{a}-{b}-{c}"]
        fill[f"ip{i}"] = [f"{rng.randrange(100, 200)}.{rng.randrange(10, 99)}.{rng.randrange(10)}.{rng.randrange(100, 255)}"]
        fill[f"mail{i}"] = [f"user{i}x@mail{i % 5}.example.org", f"User{i}X@mail{i % 5}.example.org"]
        fill[f"ssn{i}"] = [f"{digits(3)}-{digits(2)}-{digits(4)}"]
    for kind, names in NAMES.items():
        for i, name in enumerate(names):
            fill[f"name-{kind}{i}"] = [name]
    keys, texts = list(fill), []
    for i in range(90):
        holes = [rng.choice(keys) for _ in range(rng.randrange(0, 4))] if i >= len(keys) // 3 else keys[3 * i : 3 * i + 3]
        texts.append([("plain words here, ", None)] + [x for h in holes for x in (("Dr " if h.startswith("name") else "see ", None), (rng.choice(fill[h]), h), (" ; then\n", None))])
    return texts


def test_surrogates_against_planted_entities(spark):
    texts = planted(1)
    rows = [(i, "".join(t for t, _ in parts)) for i, parts in enumerate(texts)] + [(900, "x " * 200_000 + "Dr Johann Kruse"), (901, None), (902, "")]
    df = spark.createDataFrame([(i, t, "e", "f") for i, t in rows], "doc_id long, text string, kind string, spans string")
    got = {r["doc_id"]: r["text"] for r in pii.replace(df, KEY).select("row.doc_id", "text").collect()}
    assert got[901] is None and got[902] == "" and got[900].startswith("x " * 200_000 + "Dr ") and "Kruse" not in got[900]
    made = {}
    for i, parts in enumerate(texts):
        # what stands between the holes is unchanged, so the holes' new content can be cut out
        pattern = "".join("(.+?)" if h else re.escape(t) for t, h in parts)
        m = re.fullmatch(pattern, got[i], re.S)
        assert m, (rows[i][1], got[i])
        for (old, hole), new in zip([p for p in parts if p[1]], m.groups(), strict=True):
            assert new != old, old
            made.setdefault(hole, set()).add(re.sub(r"[^\w@.+]|(?<=\d)[ -](?=\d)", "", new).lower() if not hole.startswith("name") else new)
            if hole.startswith("card"):
                assert luhn(new) == 0 and shape(new) == shape(old) and new[0] == old[0]
            elif hole.startswith("iban"):
                assert mod97(new) == 1 and new[:2] == "DE" and shape(new) == shape(old)
            elif hole.startswith("phone"):
                assert shape(new) == shape(old) and re.match(r"\+\d+", new)[0] == re.match(r"\+\d+", old)[0]
            elif hole.startswith(("ip", "ssn", "mail")):
                assert shape(new) == shape(old)
            else:
                assert script(new) == script(old) and len(new.split()) == len(old.split())
    assert all(len(x) == 1 for x in made.values()), {k: v for k, v in made.items() if len(v) > 1}  # coreference over texts and formats
    by_kind = {}
    for hole, (new,) in ((h, tuple(x)) for h, x in made.items()):
        by_kind.setdefault(re.match("[a-z]+", hole)[0], []).append(new)
    for kind, new in by_kind.items():
        assert len(set(new)) == len(new), kind  # distinctness
    old = {t.lower() for parts in texts for t, h in parts if h}
    assert not old & {n for x in made.values() for n in x}


def test_calling_codes_and_check_digits():
    assert [pii.calling_code(x) for x in ("+4930123", "+12125550100", "+353861234567", "+74951234567")] == ["+49", "+1", "+353", "+7"]
    assert pii.iban_check("GB", "WEST12345698765432") == "82" and pii.iban_check("DE", "370400440532013000") == "89"
