"""PII surrogates: detected entities get keyed, type-consistent replacements.

An entity is a type and a canonical form (digits of a number, lower case of an address), so that
all its mentions, however written, get one surrogate, in the mention's own format. Surrogates
are drawn from a keyed hash of the entity and keep what makes the type: a card number's first
digit, length and check digit, an address's shape, an IPv4 octet's length, a name's gender,
script and capitals.

Distinctness is checked over the whole corpus: where two entities drew the same surrogate, or a
surrogate is another entity's own form, all but the first draw again, until none collides; later
draws, and those of forms with nothing to vary, grow longer, so that this ends. What is collected is only in tables; texts without entities take no part in any join.

A name is found after a title; wherever the same text has it, or a part of it, in capitals again,
with another title or none, that is a mention of the same person.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored

#: Titles by gender, and given and family names by gender and script.
TITLES = {"m": "Mr Mister Sir Herr Monsieur Señor Sr Don Lord господин", "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Doña Lady госпожа", "n": "Dr Prof Professor Doctor"}
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karl Louis Martin Noel Oscar Peter Ralph Simon Thomas Victor",
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sarah Teresa Vera",
    ("latin", "n"): "Alex Andrea Chris Dominique Jamie Kim Luca Morgan Robin Sacha",
    ("latin", "family"): "Abel Baker Costa Duval Evans Fischer Garcia Hansen Ibarra Jensen Keller Lopez Moreau Novak Olsen Perez Quinn Rossi Santos Turner",
    ("cyrillic", "m"): "Андрей Борис Виктор Георгий Дмитрий Иван Кирилл Максим Николай Олег",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Татьяна",
    ("cyrillic", "n"): "Саша Женя Валя Слава",
    ("greek", "m"): "Αλέξης Βασίλης Γιάννης Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σπύρος Στέλιος",
    ("greek", "f"): "Άννα Βάσω Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χρύσα",
    ("greek", "n"): "Αλεξ Ντόρα Κρις Φωφώ",
    ("greek", "family"): "Αντωνίου Βλάχος Γεωργίου Ιωάννου Κωνσταντίνου Μακρής Νικολάου Οικονόμου Πέτρου Σταύρου",
    ("cyrillic", "family"): "Белов Волков Громов Жуков Зорин Котов Лебедев Морозов Орлов Соколов",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
TITLES = {k: v.split() for k, v in TITLES.items()}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN = {n: g for (_, g), ns in NAMES.items() if g in "mf" for n in ns}
_CAP = r"[^\W\d_a-zß-öø-ÿа-я][^\W\d_]+"

#: The calling codes of one and two digits (all others have three), and the letters of scripts without cases by their ranges.
CALLING_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LETTERS = {
    "armenian": (0x0561, 0x0586), "hebrew": (0x05D0, 0x05EA), "arabic": (0x0621, 0x063A), "devanagari": (0x0905, 0x0939), "bengali": (0x0995, 0x09A8), "tamil": (0x0BAE, 0x0BB9), "thai": (0x0E01, 0x0E2E),
    "georgian": (0x10D0, 0x10F0), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3),
}
#: Where a script's characters lie as a whole.
SCRIPTS = {
    "greek": (0x0370, 0x03FF), "cyrillic": (0x0400, 0x052F), "armenian": (0x0530, 0x058F), "hebrew": (0x0590, 0x05FF), "arabic": (0x0600, 0x06FF), "devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF),
    "tamil": (0x0B80, 0x0BFF), "thai": (0x0E00, 0x0E7F), "georgian": (0x10A0, 0x10FF), "hiragana": (0x3040, 0x309F), "katakana": (0x30A0, 0x30FF), "han": (0x3400, 0x9FFF), "hangul": (0xAC00, 0xD7AF),
}

#: What each type looks like, in the order of precedence.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "secret": r"(?i:\b(?:password|passwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_\-]{8,})|(?P<key>\b(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_\-]{16,})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "name": rf"\b(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.?\s+(?P<name>{_CAP}(?:\s{_CAP}){{0,2}})",
}
_ANY = re.compile("|".join(f"(?P<{k}_>{v})" for k, v in PATTERNS.items()))
_DIGIT = re.compile(r"\d")
_TITLE_WORDS = tuple(t for ts in TITLES.values() for t in ts)
_WORD = re.compile(rf"(?<!\w){_CAP}(?!\w)")
_MARKS = ("password", "passwd", "token", "secret", "api", "sk-", "sk_", "pk-", "pk_", "ghp-", "ghp_", "xoxb", "xoxp")
_SHAPE = {"lower": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "hex": "0123456789abcdef"}


def _may(text: str) -> bool:
    """False only where no entity can be: each has a digit, an @, a title or one of a few words."""
    if "@" in text or _DIGIT.search(text) or any(t in text for t in _TITLE_WORDS):
        return True
    low = text.lower()
    return any(m in low for m in _MARKS)


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of lines that may hold an entity.

    Only names and secrets reach over line ends: where a title or mark is among a line's last four words,
    the next four lines with words belong to its run.
    """
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    first = reach = None
    for k, (start, end) in enumerate(lines):
        line = text[start:end]
        may = _may(line)
        if first is not None and k > reach:
            yield lines[first][0], lines[reach][1]
            first = None
        if not may:
            continue
        first, reach = (k if first is None else first), max(k, reach or 0)
        if _crosses(line):
            left = 4
            while left and reach + 1 < len(lines):
                reach += 1
                left -= not text[slice(*lines[reach])].isspace() and lines[reach][0] < lines[reach][1]
    if first is not None:
        yield lines[first][0], lines[reach][1]


def _crosses(line: str) -> bool:
    last = " ".join(line.rsplit(None, 4)[-4:])
    return any(t in last for t in _TITLE_WORDS) or any(m in last.lower() for m in _MARKS)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of every entity, left to right, none overlapping.

    Only lines that may hold an entity, with those that it may reach into, are searched.
    """
    if not _may(text):
        return []
    found = []
    for start, end in _blocks(text):
        found += [(start + s, start + e, kind, form) for s, e, kind, form in _in_line(text[start:end])]
    return _people(text, found) if any(kind.startswith("name-") for _, _, kind, _ in found) else found


def _people(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` with all mentions of a person under the person's longest name, those without a title too.

    A part that may be several people's is an entity of its own. A single word without a title counts only if
    the text does not have it in small letters as well.
    """
    genders: dict[tuple, set[str]] = {}
    for _, _, kind, form in found:
        if kind.startswith("name-"):
            genders.setdefault(tuple(form.split()), set()).add(kind[-1])
    runs: dict[tuple, set[tuple]] = {}
    for p in genders:
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                runs.setdefault(p[i:j], set()).add(p)
    known: dict[tuple, tuple[str, str]] = {}

    def person(name: tuple, gender: str) -> tuple[str, str]:
        if (name, gender) not in known:
            fits = [p for p in runs[name] if len(runs[p]) == 1 and (p == name or gender == "n" or not genders[p] - {"n"} or gender in genders[p])]
            whole = fits[0] if len(fits) == 1 else name
            told = (genders.get(whole, set()) | {gender}) - {"n"}
            own = gender if gender != "n" else told.pop() if len(told) == 1 else "n"
            if gender != "n" and whole != name and gender not in genders[whole]:
                genders[whole].add(gender)
            known[name, gender] = f"name-{own}", " ".join(whole)
        return known[name, gender]

    # titles that tell a gender first, so that they count for mentions without one
    for _, _, kind, form in sorted(found, key=lambda x: x[2] == "name-n"):
        if kind.startswith("name-"):
            person(tuple(form.split()), kind[-1])
    out = [(s, e, *person(tuple(form.split()), kind[-1])) if kind.startswith("name-") else (s, e, kind, form) for s, e, kind, form in found]
    small = {w for w in re.findall(r"[^\W\d_]+", text) if w.islower()}
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    k = at = 0
    while k < len(words):
        start = words[k][0]
        while at < len(found) and found[at][1] <= start:
            at += 1
        limit = found[at][0] if at < len(found) else len(text)
        n = next((n for n in (3, 2, 1) if _run(text, words, k, n, limit, runs)), 0)
        if n == 1 and (words[k][2].lower() in small or words[k][2] in _GENDER):
            n = 0
        if n:
            out.append((start, words[k + n - 1][1], *person(tuple(w.casefold() for _, _, w in words[k : k + n]), "n")))
        k += n or 1
    return sorted(out)


def _run(text: str, words: list[tuple[int, int, str]], k: int, n: int, limit: int, runs: dict) -> bool:
    """Whether the ``n`` words from the ``k``-th on, up to ``limit``, are a name or a part of one."""
    part = words[k : k + n]
    if len(part) < n or part[-1][1] > limit or tuple(w.casefold() for _, _, w in part) not in runs:
        return False
    return all(text[a[1] : b[0]].isspace() for a, b in zip(part, part[1:], strict=False))


def _in_line(text: str) -> list[tuple[int, int, str, str]]:
    found = []
    for m in _ANY.finditer(text):
        kind = next(k for k in PATTERNS if m.group(f"{k}_") is not None)
        part = {"secret": "secret" if m.group("secret") else "key", "name": "name"}.get(kind, f"{kind}_")
        start, end = m.span(part)
        surface = text[start:end]
        if kind == "name":
            title = m.group(0).split()[0].rstrip(".")
            first = surface.split()[0]
            kind = f"name-{_GIVEN.get(first, _GENDER[title])}"
            form = " ".join(surface.split()).casefold()
        elif kind in ("email", "iban"):
            form = surface.replace(" ", "").lower()
        elif kind in ("card", "phone", "ssn"):
            form = re.sub(r"[^\d+]", "", surface)
        else:
            form = surface
        found.append((start, end, kind, form))
    return found


class Draw:
    """A keyed stream of numbers for an entity."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.key, self.seed, self.n, self.pool = key, f"{kind}\0{form}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + b"\0%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def char(self, c: str) -> str:
        """Another character of the same script, case and kind."""
        if c.isdigit():
            return str(self.below(10))
        if not c.isalpha():
            return c
        script = script_of(c)
        if script in LETTERS:
            low, high = LETTERS[script]
            return chr(low + self.below(high - low + 1))
        alphabet = _SHAPE.get(script, _SHAPE["lower"])
        made = alphabet[self.below(len(alphabet))]
        return made.upper() if c.isupper() else made


def script_of(text: str) -> str:
    """The script of the first letter that is none of Latin; else latin."""
    for c in text:
        for name, (low, high) in SCRIPTS.items():
            if low <= ord(c) <= high:
                return name
    return "latin"


def calling_code(number: str) -> str:
    """The sign and country code that ``number`` (digits after a plus) begins with."""
    return next((number[: n + 1] for n in (1, 2) if number[1 : n + 1] in CALLING_CODES), number[:4])


def iban_check(country: str, account: str) -> str:
    """The two digits that make the whole leave one when divided by 97."""
    rest = int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    return f"{98 - rest:02d}"


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def surrogate(key: bytes, kind: str, form: str, attempt: int = 0) -> str:
    """The canonical form of the replacement of an entity."""
    draw = Draw(key, kind, form, attempt)
    varies = any(c.isdigit() or c.isalpha() for c in (form.rpartition("@")[0] if kind == "email" else form))
    more = max(0, attempt - 3) if varies else attempt + 1  # a space of forms may be full or hold one form only
    if kind == "email":
        local, _, domain = form.rpartition("@")
        hosts, _, top = domain.rpartition(".")
        at = Draw(key, "domain", hosts, 0)  # a domain's mentions agree over all addresses
        return "".join(map(draw.char, local + "a" * more)) + "@" + "".join(map(at.char, hosts)) + "." + top
    if kind == "card":
        digits = form[0] + "".join(map(draw.char, form[1:] + "0" * more))
        if _luhn(form) == 0:
            digits = digits[:-1] + str((10 - _luhn(digits[:-1] + "0")) % 10)
        return digits
    if kind == "ip":
        made = []
        for octet in form.split("."):
            low, high = {1: (0, 9), 2: (10, 99)}.get(len(octet), (100, 254)) if not more else (0, 255)
            made.append(str(low + draw.below(high - low + 1)))
        made += [str(draw.below(256)) for _ in range(max(0, more - 28))]
        return ".".join(made)
    if kind == "phone" and form.startswith("+"):
        code = calling_code(form)
        return code + "".join(map(draw.char, form[len(code) :] + "0" * more))
    if kind == "iban":
        account = "".join(map(draw.char, form[4:] + "0" * more))
        return form[:2] + iban_check(form[:2], account) + account
    if kind == "secret" and set(form) <= set(_SHAPE["hex"]):
        return "".join(_SHAPE["hex"][draw.below(16)] for _ in range(len(form) + more))
    if kind.startswith("name-"):
        script, words = script_of(form), form.split()
        if script in LETTERS:
            return " ".join("".join(map(draw.char, w)) for w in words) + "".join(draw.char(next(c for c in form if script_of(c) == script)) for _ in range(attempt))
        given, family = NAMES[script, kind[-1]], NAMES[script, "family"]
        picked = [given[draw.below(len(given))]] if len(words) > 1 else []
        picked += [family[draw.below(len(family))] for _ in words[len(picked) :]]
        # names are few, entities are not: later attempts grow a family name letter by letter
        picked[-1] += "".join(draw.char({"cyrillic": "а", "greek": "α"}.get(script, "a")) for _ in range(attempt))
        return " ".join(picked).casefold()
    return "".join(map(draw.char, form + ("0" if kind in ("phone", "ssn") else "a") * more))


def styled(kind: str, surface: str, made: str, form: str | None = None) -> str:
    """The surrogate ``made`` in the format of the mention ``surface``; of a name ``form``, ``surface`` may be a part."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(made)
        rest = "".join(next(chars, "") if c.isalnum() or c == "+" else c for c in surface)
        rest += "".join(chars)
        return rest.upper() if kind == "iban" else rest
    if kind == "email" and len(made) == len(surface):
        return "".join(m.upper() if s.isupper() else m for s, m in zip(surface, made, strict=True))
    if kind.startswith("name-"):
        words, own, part = made.split(), (form or "").split(), surface.casefold().split()
        at = next((i for i in range(len(own)) if own[i : i + len(part)] == part), None)
        words = words if at is None else words[at : at + len(part)]
        return " ".join(words).upper() if surface.isupper() else " ".join(w[:1].upper() + w[1:] for w in words)
    return made


SPANS = "array<struct<start:int,end:int,kind:string,form:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("form", pa.string())]))


def _detect(only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose texts have entities, with them; or, for ``only`` false, the rows without."""
        for b in batches:
            spans = [entities(x.as_py() or "") for x in b.column("_text")]
            pick = pa.array([bool(s) == only for s in spans])
            kept = b.filter(pick)
            if only:
                rows = [[dict(zip(("start", "end", "kind", "form"), s, strict=True)) for s in x] for x in spans if x]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rows, _SPANS)], names=[*kept.schema.names, "spans"])
            else:
                yield kept

    return run


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(key, *x) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "form", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "made"])

    return run


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """Distinct surrogates for distinct entities: rows (kind, form, made); ``found`` has kind and form.

    Kinds of one type (names of either gender) share a space of surrogates.
    """
    schema = "kind string, form string, attempt int, made string"
    distinct = found.select("kind", "form").distinct()
    drawn = stored(distinct.withColumn("attempt", F.lit(0)).mapInArrow(_drawn(key), schema), "surrogates")
    own = lambda df: df.withColumn("type", F.substring_index("kind", "-", 1))
    while True:
        first = own(drawn).groupBy("type", "made").agg(F.min(F.struct("form", "kind")).alias("first"), F.count("*").alias("n"))
        twice = own(drawn).join(first.where("n > 1"), ["type", "made"]).where(F.struct("form", "kind") != F.col("first")).select("kind", "form")
        taken = own(drawn).join(own(distinct).select("type", F.col("form").alias("made")).distinct(), ["type", "made"]).select("kind", "form")
        again = stored(twice.union(taken).distinct(), "collisions")
        if not again.limit(1).count():
            return drawn.select("kind", "form", "made")
        redrawn = drawn.join(again, ["kind", "form"]).select("kind", "form", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_drawn(key), schema)
        drawn = stored(drawn.join(again, ["kind", "form"], "left_anti").unionByName(redrawn), "surrogates")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text, spans in zip(b.column("_text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            out, at = [], 0
            for s in sorted(spans, key=lambda s: s["start"]):
                out += [text[at : s["start"]], styled(s["kind"], text[s["start"] : s["end"]], s["made"], s["form"])]
                at = s["end"]
            texts.append("".join([*out, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([len(s) for s in b.column("spans").to_pylist()], pa.int32())], names=["row", "text", "n_entities"])


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Rows (row, text, n_entities): every row as it came, its text with surrogates for entities.

    A null text stays null, with no entities. Rows that repeat are rewritten each for itself; texts are searched
    whole, however long, and columns of any name stay inside ``row``. Two passes search the texts, one for rows with entities and one for
    those without: the second costs less than to write all texts out once.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("_text"))
    kind = f"row {own.schema['row'].dataType.simpleString()}, _text string"
    held = stored(own.mapInArrow(_detect(True), f"{kind}, spans {SPANS}").withColumn("uid", F.monotonically_increasing_id()), "texts-with-entities")
    clean = own.mapInArrow(_detect(False), kind).select("row", F.col("_text").alias("text"), F.lit(0).alias("n_entities"))
    mentions = held.select("uid", F.inline("spans"))
    # a name without a gender is that of the one gender, if any, that other texts tell of it
    told = mentions.where("kind in ('name-m', 'name-f')").groupBy("form").agg(F.min("kind").alias("told"), F.max("kind").alias("most")).where("told = most")
    told = told.select(F.lit("name-n").alias("kind"), "form", "told")
    mentions = mentions.join(told, ["kind", "form"], "left").select("uid", "start", "end", F.coalesce("told", "kind").alias("kind"), "form")
    made = assign(mentions, key)
    spans = mentions.join(made, ["kind", "form"]).groupBy("uid").agg(F.collect_list(F.struct("start", "end", "kind", "form", "made")).alias("spans"))
    rewritten = held.select("uid", "row", "_text").join(spans, "uid").select("row", "_text", "spans")
    rewritten = rewritten.mapInArrow(_rewrite, f"row {own.schema['row'].dataType.simpleString()}, text string, n_entities int")
    return rewritten.unionByName(clean)
