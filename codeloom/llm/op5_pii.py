"""PII replacement by keyed surrogates of the same type, gender, script and format.

Found are e-mail addresses, IPv4 addresses, IBANs, payment-card numbers (13 to 19 digits), US social
security numbers, telephone numbers, and personal names after a courtesy title. A surrogate depends on
the key and the entity only, so one entity has one surrogate in the whole corpus (coreference) without any
shuffle or state.

Numbers and addresses go through a format-preserving permutation, a Feistel network around a step to the next text of
the form: every digit becomes a digit, every letter another of its alphabet and case (of its Unicode block, where no
alphabet is listed), punctuation stays. A permutation has no collisions, so distinct entities of one form stay distinct
everywhere, and none of this kind maps a text to itself. Valid check digits (Luhn, IBAN) stay valid, a private IPv4 address
stays in its network.

A part of a name has one surrogate whatever its document, title or place in the name. Names that are on the lists by gender
and script change places on their list; others keep their script, length, capitals, last letter (which often tells the
gender) and the places of vowels, by a permutation of all names that are on no list. Both are one to one, so distinct names
stay distinct in the whole corpus. Where a surrogate is another word of the document already, that word is taken for a name
too and gets its own surrogate. Later bare mentions of a name's parts get the same surrogate; numerals after names (III) stay.
Names without a courtesy title aren't found.

Defined cases: a null text stays null and an empty one empty; texts are processed whole; a document without
entities is unchanged; repeated rows are replaced alike; other columns pass through (``n_chars`` is set
anew if there is one); an empty table gives an empty result.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_rows

#: The default key; pass a secret one where surrogates must not be reproducible by others.
KEY = b"codeloom surrogate key"
KINDS = ("email", "ip", "iban", "ssn", "phone", "card", "name")
_ROUNDS = 8

# The alphabets in which a letter or digit finds its surrogate.
_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
# In names, letters with marks change places with those of the same languages only.
_MARKED = ("äöü", "ÄÖÜ", "áéíóú", "ÁÉÍÓÚ", "àèùâêîôûëï", "ÀÈÙÂÊÎÔÛËÏ", "åæø", "ÅÆØ", "çñ", "ÇÑ")
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿаеёиоуыэюяαεηιουω"


def _place(c: str, named: bool = False) -> tuple[str, int] | None:
    """The alphabet of a letter or digit, and its place there; in names, vowels and letters with marks have their own."""
    if named and (marked := next((a for a in _MARKED if c in a), None)):
        return marked, marked.index(c)
    alphabet = next((a for a in _ALPHABETS if c in a), None)
    if alphabet is None and (c.isalpha() or c.isdecimal()):
        alphabet = _block(c)
    if alphabet is not None and named:
        own = "".join(_MARKED)
        alphabet = "".join(x for x in alphabet if (x.lower() in _VOWELS) == (c.lower() in _VOWELS) and x not in own)
    return (alphabet, alphabet.index(c)) if alphabet else None


def _block(c: str) -> str:
    """The letters (or digits) of the character's kind around it: of all Han or Hangul, else of 128 code points."""
    n = ord(c)
    span = next((r for r in (range(0x4E00, 0xA000), range(0xAC00, 0xD7A4)) if n in r), range(n & ~127, (n | 127) + 1))
    return "".join(x for x in map(chr, span) if unicodedata.category(x) == unicodedata.category(c))


# Courtesy titles by gender, and names to choose surrogates from by gender and script.
_TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Sr", "Señor", "господин", "г-н", "κύριος", "κ"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Sra", "Señora", "госпожа", "г-жа", "κυρία", "κα"),
    "n": ("Dr", "Prof", "Mx"),
}
_GIVEN = {
    ("m", "latin"): "Adam Albert Alan Bruno Carl Daniel David Edgar Emil Felix Frank George Henry Hugo Ivan Jack James John Jonas Karl Leon Louis Marc Martin Max Nils Oscar Otto Paul Peter Ralph Robert Simon Stefan Thomas Tim Victor Walter".split(),
    ("f", "latin"): "Ada Alice Anna Bella Carla Clara Daria Diana Edith Ella Emma Eva Fiona Flora Greta Hanna Helen Ida Irene Jana Julia Karin Lara Laura Lena Lucy Maria Martha Mia Nina Nora Olga Paula Rosa Sara Sofia Thea Vera".split(),
    ("n", "latin"): "Alex Andrea Charlie Dana Eden Jamie Jordan Kim Lee Morgan Nikola Robin Sascha Toni Vivian".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Максим Олег Павел Роман Семён Тимур".split(),
    ("f", "cyrillic"): "Алла Анна Вера Дарья Елена Зоя Инна Ирина Ксения Лариса Мария Нина Ольга Полина Софья Юлия".split(),
    ("n", "cyrillic"): "Саша Женя Валя".split(),
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Κώστας Μάριος Νίκος Πέτρος Στέφανος".split(),
    ("f", "greek"): "Άννα Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία".split(),
    ("n", "greek"): "Χάρις Αλέξις".split(),
}
_FAMILY = {
    "latin": "Abbott Adams Anderson Arnold Baker Barker Becker Bergmann Blanc Brandt Brown Carter Castro Clark Costa Cruz Dietrich Dubois Ellis Fischer Fletcher Fontaine Garcia Graf Hansen Hart Hoffmann Jensen Johnson Jones Keller Klein Lambert Lang Laurent Lindner Lopez Marin Mercer Meyer Miller Moreau Müller Navarro Novak Ortega Parker Perrin Reyes Richter Roche Romero Russo Sanders Schubert Serrano Smith Stone Taylor Torres Vargas Vogel Wagner Weber Williams Wilson Winter Ziegler".split(),
    "cyrillic": "Беленко Гнатюк Дейнеко Живаго Карпенко Кравчук Лысенко Мельник Павленко Романенко Савченко Тараненко Франко Шевчук Юрченко Яценко".split(),
    "greek": "Αλεξίου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παπαδάκη Στεφάνου".split(),
}
#: Every listed name with the list that it changes places on: the first that has it.
_LISTED: dict[str, str] = {}
for _kind, _names in (*((f"given {g} {x}", ns) for (g, x), ns in _GIVEN.items()), *((f"family {x}", ns) for x, ns in _FAMILY.items())):
    for _n in _names:
        _LISTED.setdefault(_n, _kind)
_GENDER = {t.lower(): g for g, ts in _TITLES.items() for t in ts}

_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ][\w'’-]*[^\W\d_]"
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted((t for ts in _TITLES.values() for t in ts), key=len, reverse=True))})(\.[ \t]*|[ \t]+)({_CAPITAL}(?:[ \t]{_CAPITAL}){{0,2}})")
#: What follows a name as a number stays.
_NUMERAL = re.compile(r"[IVX]{2,5}")
_EMAIL = r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[\w-]+(?:\.[\w-]+)+)"
_NUMBERS = (
    r"(?P<ip>(?<!\w)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))",
    r"(?P<card>(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-]))",
)
_WITH_AT = re.compile("|".join((_EMAIL, *_NUMBERS)))
_WITHOUT_AT = re.compile("|".join(_NUMBERS))
#: What every numeric entity has; a text without it and without an @ is not searched further.
_NUMERIC = re.compile(r"\+\d|\d(?:[^\n\w]{0,2}\d){6}|\d{1,3}\.\d{1,3}\.\d|[A-Z]{2}\d\d[ A-Z0-9]")


class Surrogates:
    """The keyed mapping; one is built in each task from the key alone."""

    def __init__(self, key: bytes = KEY):
        self.key, self.known, self.places = key, {}, {}

    def _place(self, c: str, named: bool) -> tuple[str, int] | None:
        """:func:`_place`, kept by letter: alphabets of ten thousands of letters are made once a task."""
        if (c, named) not in self.places:
            if len(self.places) > 5_000:
                self.places.clear()
            found = _place(c, named)
            self.places[c, named] = found and (self.places.setdefault(found[0], found[0]), found[1])
        return self.places[c, named]

    def _draw(self, *parts: str) -> bytes:
        return hmac.new(self.key, "\0".join(parts).encode(), sha256).digest()

    def permute(self, text: str, tweak: str, back: bool = False, named: bool = False) -> str:
        """A keyed permutation of the texts of this form, of which none stays: same length, each character in its alphabet."""
        places = [self._place(c, named) for c in text]
        at = [i for i, p in enumerate(places) if p]
        sizes, x = [len(places[i][0]) for i in at], [places[i][1] for i in at]
        form = "".join(p[0][0] if p else c for p, c in zip(places, text, strict=True))
        # Back to the key's own order, one step on in it, and forth again.
        self._rounds(x, sizes, tweak, form, -1)
        step = -1 if back else 1
        for i, size in enumerate(sizes):
            x[i] = (x[i] + step) % size
            if x[i] != (size - 1 if back else 0):
                break
        self._rounds(x, sizes, tweak, form, 1)
        out = list(text)
        for i, v in zip(at, x, strict=True):
            out[i] = places[i][0][v]
        return "".join(out)

    def _rounds(self, x: list[int], sizes: list[int], tweak: str, form: str, sign: int) -> None:
        half = len(x) // 2
        parts = (range(half, len(x)), range(half))
        for r in range(_ROUNDS)[::sign]:
            change, other = parts[r % 2], parts[1 - r % 2]
            told = ",".join(str(x[j]) for j in other)
            stream = b"".join(self._draw(tweak, form, str(r), told, str(b)) for b in range(len(change) // 8 + 1))
            for n, j in enumerate(change):
                x[j] = (x[j] + sign * int.from_bytes(stream[4 * n : 4 * n + 4], "big")) % sizes[j]

    def email(self, text: str, back: bool = False) -> str:
        """Local part and domain are mapped apart, so people of one domain still share one; its last label stays."""
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self.permute(local, 'local', back)}@{self.permute(host, 'host', back)}.{top}"

    def ip(self, text: str, back: bool = False) -> str:
        """A private address keeps its network; a public one stays public (walking the cycle)."""
        n = 0
        for x in text.split("."):
            n = n << 8 | int(x)
        bits = _network_bits(n)
        net = n >> bits << bits
        low = n - net
        while True:
            low = self._bits((self._bits(low, bits, True) + (-1 if back else 1)) % (1 << bits), bits, False)
            if bits < 32 or _network_bits(low) == 32:
                break
        out = net + low
        return ".".join(str(out >> s & 255) for s in (24, 16, 8, 0))

    def _bits(self, n: int, bits: int, back: bool) -> int:
        half = bits // 2
        mask = (1 << half) - 1
        a, b = n >> half, n & mask
        for r in range(_ROUNDS)[:: -1 if back else 1]:
            if r % 2:
                a ^= int.from_bytes(self._draw("ip", str(bits), str(r), str(b))[:4], "big") & mask
            else:
                b ^= int.from_bytes(self._draw("ip", str(bits), str(r), str(a))[:4], "big") & mask
        return a << half | b

    def card(self, text: str, back: bool = False) -> str:
        """All digits but the last are permuted; the last keeps its distance from the right check digit."""
        last = max(i for i, c in enumerate(text) if c.isdigit())
        body = self.permute(text[:last], "card", back)
        off = int(text[last]) - _luhn(text[:last])
        return body + str((_luhn(body) + off) % 10) + text[last + 1 :]

    def iban(self, text: str, back: bool = False) -> str:
        """The country stays, the account is permuted, the check digits keep their distance from the right ones."""
        off = (int(text[2:4]) - _check97(text[:2], text[4:])) % 97
        body = self.permute(text[4:], f"iban{text[:2]}", back)
        return f"{text[:2]}{(_check97(text[:2], body) + off - 2) % 97 + 2:02d}{body}"

    def phone(self, text: str, back: bool = False) -> str:
        """The country code stays."""
        code = m.end() if (m := re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)) else 0
        return text[:code] + self.permute(text[code:], f"phone{text[:code]}", back)

    def ssn(self, text: str, back: bool = False) -> str:
        return self.permute(text, "ssn", back)

    def of(self, kind: str, text: str) -> str:
        """The surrogate of a number or address."""
        if (found := self.known.get((kind, text))) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[kind, text] = getattr(self, kind)(text)
        return found

    def name(self, part: str) -> str:
        """The surrogate of a part of a name, the same in every document."""
        if part.isupper() and len(part) > 1 and (small := part.title()).upper() == part:
            return self.name(small).upper()
        if len(self.known) > 100_000:
            self.known.clear()
        if (found := self.known.get(("name", part))) is None:
            found = self.known["name", part] = self._listed(part) if part in _LISTED else self._made_up(part)
        return found

    def _listed(self, part: str) -> str:
        """The next name in the key's order of the list."""
        kind = _LISTED[part]
        order = sorted((n for n, k in _LISTED.items() if k == kind), key=lambda n: self._draw("name", kind, n))
        return order[(order.index(part) + 1) % len(order)]

    def _made_up(self, part: str) -> str:
        """A name on no list: letters permuted, all but the last, until the result is on none either."""
        pick = part
        while pick == part or pick in _LISTED:
            pick = self.permute(pick[:-1], f"name{pick[-1]}", named=True) + pick[-1]
        return pick

    def names(self, found: list[tuple[str, list[str]]], taken: set[str]) -> dict[str, str]:
        """Surrogates for the parts of a document's names, given as (gender, parts) in order of appearance.

        Each part has the one surrogate that it has everywhere. Where that is another word of the document (``taken``), the word
        is taken for a name too and gets its own, and so on: mappings are one to one, so nothing comes to be called alike.
        """
        out: dict[str, str] = {}
        left = sorted({p for _, parts in found for p in parts if not _NUMERAL.fullmatch(p)})
        while left:
            part = left.pop()
            out[part] = self.name(part)
            if out[part] in taken and out[part] not in out:
                left.append(out[part])
        return out

    def replace(self, text: str | None) -> tuple[str | None, list[int]]:
        """The text with surrogates, and how many entities of each of ``KINDS`` it had."""
        counts = dict.fromkeys(KINDS, 0)
        if not text:
            return text, [0] * len(KINDS)

        def one(m: re.Match) -> str:
            counts[m.lastgroup] += 1
            return self.of(m.lastgroup, m.group())

        if "@" in text or _NUMERIC.search(text):
            text = (_WITH_AT if "@" in text else _WITHOUT_AT).sub(one, text)
        if named := [(_GENDER[m[1].lower()], re.split(r"[ \t]+", m[3])) for m in _NAME.finditer(text)]:
            new = self.names(named, set(re.findall(r"\w[\w'’-]*", text)))
            counts["name"] = len(named)
            mention = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(new, key=len, reverse=True)))})(?!\w)")
            text = mention.sub(lambda m: new[m.group()], text) if new else text
        return text, list(counts.values())


def _network_bits(n: int) -> int:
    """Host bits of the private IPv4 network that an address lies in; 32 for a public one."""
    if n >> 24 in (10, 127):
        return 24
    if n >> 20 == 172 << 4 | 1:
        return 20
    return 16 if n >> 16 in (192 << 8 | 168, 169 << 8 | 254) else 32


def _luhn(digits: str) -> int:
    """The check digit that makes the digits before it valid."""
    ds = [int(c) for c in digits if c.isdigit()][::-1]
    return -sum(d if i % 2 else d // 5 + 2 * d % 10 for i, d in enumerate(ds)) % 10


def _check97(country: str, body: str) -> int:
    """The right check digits of an IBAN, 2 to 98."""
    digits = "".join(str(int(c, 36)) for c in f"{body}{country}00" if c.isalnum())
    return 98 - int(digits) % 97


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _maker(key: bytes) -> Callable[[list[str | None]], list[pa.Array]]:
    kept: list[Surrogates] = []

    def make(texts: list[str | None]) -> list[pa.Array]:
        if not kept:
            kept.append(Surrogates(key))
        got = [kept[0].replace(t) for t in texts]
        cols = zip(*[c for _, c in got], strict=True) if got else [()] * len(KINDS)
        return [pa.array([t for t, _ in got], pa.string()), *[pa.array(c, pa.int64()) for c in cols]]

    return make


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with the text replaced and one column ``n_<kind>`` a kind of entity after the others."""
    new = fresh(docs, "replaced")
    names = [fresh(docs, f"n_{k}") for k in KINDS]
    out = [(new, T.StringType()), *[(n, T.LongType()) for n in names]]
    got = map_rows(docs, text, out, _maker(key))
    cols = [F.col(f"`{new}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return got.select(*cols, *names)


def clean(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The documents with surrogates for their entities, with the same columns."""
    got = pseudonymise(docs, key=key).select(*[F.col(f"`{c}`") for c in docs.columns])
    return got.withColumn("n_chars", F.length("text").cast(got.schema["n_chars"].dataType)) if "n_chars" in got.columns else got


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and the number of its entities by kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs)
