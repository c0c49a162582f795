"""PII surrogates: keyed, type-consistent replacements.

Entities (mail and IP addresses, phone, card and social security numbers, access
keys, labelled secrets, titled person names) are replaced by surrogates of the
same type and format, made with a secret key:

* Structured values go through a keyed Feistel permutation of the values of the
  same format: digits stay digits, capitals capitals, separators stay, card
  numbers keep their first digit and a right check digit, mail addresses are
  replaced part by part. A permutation maps distinct values to distinct ones.
* Names are replaced word by word by names built of syllables of the word's
  script (Latin, Cyrillic or Greek), in the case of the original. They are found
  after titles and after labels ("Contact: John Doe"); a given name or surname found
  so is replaced wherever the document has it. The syllables follow from the word
  alone and the ending from its gender, which is that of its own title, or of a
  title that the document gives the same name elsewhere, or else of the word's own
  ending: so a person who is "Mrs" here and "Dr" there has one name.
* Spellings of one value share a surrogate: mail addresses whatever their case,
  telephone and card numbers however they are written. Each keeps its own spelling.

One value always gets one surrogate, in all documents and runs with the same
key, so coreference is preserved. Collisions are checked over the whole corpus:
of values of one kind that would share a surrogate only one keeps it, and no value
keeps one that the corpus holds itself, be it its own or another's; the others draw
again until none collides.
The few redrawn values are handed to the rewriting pass: as a table of a checked
size, or joined by the text's hash if there are more than ``max_shared``.

Defined results: a structured value that still has no surrogate after ``WIDEN``
draws, or that has no letter or digit to change, gets one of a wider format: more
letters, a phone's or number's extension, an address's port, more digits of a card,
one more with each further draw, so that formats in full use end too. A secret has
a letter or digit. A null text stays null with no entities; texts without entities
are unchanged to the byte. Rows that repeat a doc_id are rewritten alike. Card
numbers are those with a right check digit; other long numbers stay. Texts of any
length are read whole. A column n_entities is replaced; all others are kept. An
empty table has an empty result. Without a key nothing is replaced: it is an error,
as whoever knows the key can undo the permutations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import materialize, small_batches

TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "Г-н", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Señorita", "Doña", "Г-жа", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
#: Labels before the name of a person.
NAME_LABELS = ("Name", "Full name", "Contact", "Contact person", "Patient", "Customer", "Client", "Employee", "Applicant", "Attn", "Signed", "Kontakt", "Kunde", "Contacto", "Cliente", "Nom", "Имя")
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][\w'’]*(?:-[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][\w'’]*)?"
_PERSON = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(_GENDER, key=len, reverse=True))})(?P<gap>\.? )(?P<name>{_NAME}(?: {_NAME}){{0,2}})(?!\w)")
_LABELLED = re.compile(rf"(?<!\w)(?P<title>)(?:{'|'.join(sorted(NAME_LABELS, key=len, reverse=True))})[ \t]*:[ \t]*(?P<name>{_NAME}(?: {_NAME}){{1,2}})(?!\w)")
_ENTITY = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<access>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?P<label>\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]*[=:][ \t]*[\"']?)(?P<secret>(?=[+/_.~-]*[A-Za-z0-9])[A-Za-z0-9+/_.~-]{6,})"
    r"|(?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-]|\.\d))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    re.IGNORECASE,
)
_HINT = re.compile(r"[@=:0-9]")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYLLABLES = {
    "latin": ("bdfgklmnprstv", "aeiou", {"m": "n r s".split(), "f": "a ia na".split(), "n": "el in en".split(), "s": "er man son wick".split()}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "н р м".split(), "f": "а ия на".split(), "n": "ин ен".split(), "s": "енко ский ер ан".split()}),
    "greek": ("βγδζκλμνπρσ", "αειου", {"m": "ος ης ων".split(), "f": "α η ια".split(), "n": "ις ω".split(), "s": "ίδης άκης ου ας".split()}),
}


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=64).digest(), "big")


def permute(key: bytes, tweak: str, values: list[int], radices: list[int]) -> list[int]:
    """A keyed permutation of all lists of digits in these radices (Feistel rounds between two halves)."""
    if len(values) > 64:  # halves of a round must stay below the 512 bits of a digest
        return permute(key, tweak + "/", values[:64], radices[:64]) + permute(key, tweak + "/+", values[64:], radices[64:])
    if len(values) == 1:
        return [(values[0] + _number(key, tweak, radices[0])) % radices[0]]
    cut = len(values) // 2
    halves, sizes = [0, 0], [1, 1]
    for i, (v, r) in enumerate(zip(values, radices, strict=True)):
        halves[i >= cut], sizes[i >= cut] = halves[i >= cut] * r + v, sizes[i >= cut] * r
    for turn in range(8):
        a = turn % 2
        halves[a] = (halves[a] + _number(key, tweak, turn, *radices, halves[1 - a])) % sizes[a]
    out = []
    for half, rs in zip(halves, (radices[:cut], radices[cut:]), strict=True):
        digits = []
        for r in reversed(rs):
            half, d = divmod(half, r)
            digits.append(d)
        out += reversed(digits)
    return out


def same_format(key: bytes, tweak: str, value: str, fixed: frozenset[int] = frozenset(), high: frozenset[int] = frozenset()) -> str:
    """Permute letters and digits within their kind; all else and the places in ``fixed`` stay.

    Digits at the places in ``high`` that aren't 0 or 1 never become so.
    """
    hexlike = bool(re.fullmatch(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}", value))
    kinds = ("0123456789abcdef",) if hexlike else (_DIGITS, _LOWER, _UPPER)
    places, alphabets = [], []
    for i, c in enumerate(value):
        alphabet = _DIGITS[2:] if i in high and c in _DIGITS[2:] else next((a for a in kinds if c in a), "")
        if i not in fixed and alphabet:
            places.append(i)
            alphabets.append(alphabet)
    if not places:
        return value
    shape = f"x{len(value)}" if hexlike else re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value)))
    new = permute(key, f"{tweak}|{shape}", [a.index(value[i]) for i, a in zip(places, alphabets, strict=True)], [len(a) for a in alphabets])
    out = list(value)
    for i, a, d in zip(places, alphabets, new, strict=True):
        out[i] = a[d]
    return "".join(out)


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


#: Draws of a structured value within its own format.
WIDEN = 4


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a value in canonical form; each attempt draws anew, later ones in a wider format."""
    new = _drawn(key, kind, value, attempt)
    if kind.startswith("name") or attempt < WIDEN and (not attempt or new != value):
        return new
    n = _number(key, "wider", kind, attempt, value)
    symbols = _DIGITS if kind in ("ip", "card", "phone", "ssn") else _UPPER if kind == "access" else _LOWER
    more = ""
    for _ in range(max(1, attempt - WIDEN + 1)):
        n, d = divmod(n, len(symbols))
        more += symbols[d]
    if kind == "email":
        return new.replace("@", more + "@", 1)
    if kind == "card":
        return next(x for d in _DIGITS if luhn(re.sub(r"\D", "", x := new[:-1] + more + d)))
    return new + {"ip": ":", "phone": " x", "ssn": " x"}.get(kind, "") + more


def _drawn(key: bytes, kind: str, value: str, attempt: int) -> str:
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] == "example" else 1  # reserved domains stay reserved
        labels[:-keep] = [same_format(key, f"domain|{attempt}", x) for x in labels[:-keep]]
        return f"{same_format(key, tweak, local)}@{'.'.join(labels)}"
    if kind == "ip":
        octets = list(map(int, value.split(".")))
        public = 1 <= octets[0] <= 223
        new = permute(key, f"{tweak}|{public}", [octets[0] - public, *octets[1:]], [223 if public else 256, 256, 256, 256])
        return ".".join(map(str, [new[0] + public, *new[1:]]))
    if kind == "card":
        body = same_format(key, tweak, value[:-1], frozenset([0]))
        return next(body + d for d in _DIGITS if luhn(re.sub(r"\D", "", body + d)))
    if kind == "phone":
        digits = [i for i, c in enumerate(value) if c.isdigit()]
        own = digits[-10:]  # the country stays, and so does the exchange that is set apart for fiction
        stay = set(digits[:-10]) | (set(own[3:6]) if all(value[i] == "5" for i in own[3:6]) else set())
        return same_format(key, tweak, value, frozenset(stay), frozenset([own[0], own[3]]))
    if kind == "access":
        return same_format(key, tweak, value, frozenset(range(4)))
    if kind.startswith("name"):
        _, role, script = kind.split("|")
        letters, vowels, endings = _SYLLABLES[script]
        n = _number(key, f"name|{'s' if role == 's' else 'g'}|{script}", attempt, value)
        out = ""
        for _ in range(2 + (role == "s") + attempt // 2):
            n, c = divmod(n, len(letters))
            n, v = divmod(n, len(vowels))
            out += letters[c] + vowels[v]
        return out + endings[role][n % len(endings[role])]
    return same_format(key, tweak, value)


def _styled(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def canonical(kind: str, value: str) -> str:
    """What all spellings of a value share: a phone's ten last digits, a card's digits, a mail address in small letters."""
    if kind in ("phone", "card"):
        digits = re.sub(r"\D", "", value)
        return digits[-10:] if kind == "phone" else digits
    return value.lower() if kind == "email" else value


def spelled(kind: str, new: str, old: str) -> str:
    """A surrogate written as the original is."""
    if kind.startswith("name"):
        return _styled(new, old)
    if kind == "email":
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, old, strict=False)) + new[len(old) :]
    if kind in ("phone", "card"):
        own = [i for i, c in enumerate(old) if c.isdigit()]
        own = own[-10:] if kind == "phone" else own
        out = list(old)
        for i, c in zip(own, new, strict=False):
            out[i] = c
        return "".join(out) + new[len(own) :]
    return new


def _apparent(word: str) -> str:
    """The gender that a given name's ending suggests."""
    return "f" if word.lower().endswith(("a", "e", "я", "а", "α", "η")) else "m"


def _persons(text: str) -> list[tuple[int, int, str, str, str]]:
    """The words of all names after titles and labels, and the same words elsewhere."""
    found: list[tuple[int, int, str, str, str]] = []
    named = [m for rx in (_PERSON, _LABELLED) for m in rx.finditer(text)]
    gender: dict[tuple[str, ...], str] = {}
    for m in sorted(named, key=lambda m: m.start()):
        words = tuple(w.lower() for w in m["name"].split(" "))
        if len(words) > 1 and (g := _GENDER.get(m["title"], "n")) != "n":
            for w in words[:-1]:
                gender.setdefault((w, words[-1]), g)
                gender.setdefault((w,), g)
    known: dict[str, str] = {}
    given: dict[str, str] = {}
    for m in named:
        words, at = m["name"].split(" "), m.start("name")
        for i, w in enumerate(words):
            own = _GENDER.get(m["title"], "n")
            if i == len(words) - 1:
                role = "s"
            else:
                low = w.lower()
                role = own if own != "n" else gender.get((low, words[-1].lower())) or gender.get((low,)) or _apparent(w)
            kind = f"name|{role}|{script_of(w)}"
            found.append((at, at + len(w), kind, w.lower(), w))
            if role == "s" or len(w) > 2:
                (known if role == "s" else given).setdefault(w.lower(), kind if role == "s" else f"name|{gender.get((w.lower(),)) or role}|{script_of(w)}")
            at += len(w) + 1
    known = {**given, **known}
    if known:
        # as found, in capitals, or with the first letter capital; words all in small letters are other words
        forms = {f: w for w in known for f in (w.upper(), w[:1].upper() + w[1:], w.title())} | {x[4]: x[3] for x in found}
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(forms, key=len, reverse=True))) + r")(?!\w)")
        found += [(m.start(), m.end(), known[forms[m[0]]], forms[m[0]], m[0]) for m in again.finditer(text) if forms[m[0]] in known]
    return found


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical value, original) in order, without overlaps."""
    found: list[tuple[int, int, str, str, str]] = []
    if _HINT.search(text):
        for m in _ENTITY.finditer(text):
            kind = m.lastgroup
            value = m[kind]
            if kind == "card" and not luhn(re.sub(r"\D", "", value)):
                continue
            found.append((m.start(kind), m.end(kind), kind, canonical(kind, value), value))
    if any(t in text for t in (*_GENDER, *NAME_LABELS)):
        found += _persons(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def rewrite(text: str, key: bytes, redrawn: dict[tuple[str, str], int]) -> tuple[str, int]:
    parts, at, found = [], 0, entities(text)
    for start, end, kind, value, old in found:
        new = surrogate(key, kind, value, redrawn.get((kind, value), 0))
        parts += [text[at:start], spelled(kind, new, old)]
        at = end
    return ("".join([*parts, text[at:]]) if found else text), len(found)


def redraws(docs: DataFrame, key: str, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(hash of the text, kind, value) of all entities, and (kind, value, attempt) of those that must draw again."""
    small_batches(docs.sparkSession)
    secret = key.encode()

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = sorted({(h, x[2], x[3]) for h, t in zip(pdf["h"], pdf["text"], strict=True) if t is not None for x in entities(t)})
            if rows:
                yield pd.DataFrame(rows, columns=["h", "kind", "value"])

    @F.pandas_udf("string")
    def draw(kinds: pd.Series, values: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, k, v, int(n)) for k, v, n in zip(kinds, values, attempts, strict=True)], dtype=object)

    where = materialize(docs.select(F.xxhash64("text").alias("h"), "text").mapInPandas(found, "h long, kind string, value string"))
    drawn = materialize(where.groupBy("kind", "value").agg(F.lit(0).alias("attempt")).withColumn("new", draw("kind", "value", "attempt")))
    family = F.when(F.startswith("kind", F.lit("name")), "name").otherwise(F.col("kind")).alias("family")  # names of all kinds differ
    first = Window.partitionBy(family, "new").orderBy("attempt", "value", "kind")
    real = drawn.select(family, F.col("value").alias("new"), F.lit(True).alias("_real")).distinct()
    for _ in range(max_rounds):
        clash = drawn.withColumns({"family": family, "_nth": F.row_number().over(first)}).join(real, ["family", "new"], "left")
        clash = clash.select("kind", "value", "attempt", "new", ((F.col("_nth") > 1) | F.col("_real").isNotNull()).alias("bad"))
        clash = materialize(clash)
        losers = clash.filter("bad")
        if losers.isEmpty():
            return where, drawn.filter("attempt > 0").select("kind", "value", "attempt")
        again = losers.withColumn("attempt", F.col("attempt") + 1).withColumn("new", draw("kind", "value", "attempt"))
        drawn = materialize(clash.filter("NOT bad").unionAll(again).drop("bad"))
    raise RuntimeError("surrogates still collide")


def pseudonymize(docs: DataFrame, key: str, max_shared: int = 50_000) -> DataFrame:
    """Replace the entities in ``text`` of every row and add n_entities."""
    if not key:
        raise ValueError("surrogates need a secret key")
    small_batches(docs.sparkSession)
    secret, docs = key.encode(), docs.drop("n_entities")
    where, again = redraws(docs, key)
    shared = again.limit(max_shared + 1).collect()
    if len(shared) <= max_shared:
        redrawn = {(r["kind"], r["value"]): r["attempt"] for r in shared}

        @F.pandas_udf("text string, n long")
        def rewritten(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(None, 0) if t is None else rewrite(t, secret, redrawn) for t in texts], columns=["text", "n"])

        out = docs.withColumn("_new", rewritten("text"))
    else:
        mine = where.join(again, ["kind", "value"]).groupBy("h").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("_own"))
        hashed = docs.withColumn("_h", F.xxhash64("text"))

        @F.pandas_udf("text string, n long")
        def rewritten(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
            rows = []
            for t, few in zip(texts, own, strict=True):
                redrawn = {(r["kind"], r["value"]): r["attempt"] for r in (few if few is not None else ())}
                rows.append((None, 0) if t is None else rewrite(t, secret, redrawn))
            return pd.DataFrame(rows, columns=["text", "n"])

        out = hashed.join(mine, hashed["_h"] == mine["h"], "left").withColumn("_new", rewritten("text", "_own")).drop("_h", "h", "_own")
    order = [F.col("_new.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*order, F.col("_new.n").alias("n_entities"))
