"""PII: keyed surrogates that keep type, gender, script and format."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Used where a caller passes no key of its own; surrogates can be undone by whoever knows the key.
DEFAULT_KEY = b"replace this key in production"

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emily Anna Laura Sophie Julia Claire Marie Camille Ingrid Greta Heike Sabine Lucía Carmen Elena Isabel Chiara Giulia".split(),
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew George Pierre Luc Antoine Hans Jürgen Klaus Dieter Carlos Javier Miguel Diego Marco Luca".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Иван Николай Михаил Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Ιωάννα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης".split(),
}
#: Titles that a surname follows.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Monsieur Madame Señor Señora Sr Sra".split()
#: Words before and after a full name, by which a name without a known given name or title is told.
BEFORE = "dear contact name named signed author attn met called told asked regards sincerely cc".split()
BEFORE_TO = "wrote write writes spoke talked sent letter reply".split()
AFTER = "met said says wrote writes called asked told lives lived works worked born signed replied".split()
#: Capitalised words that aren't parts of names.
NOT_NAMES = (
    "The A An This That These Those In On At It He She We You They I And Or But If When New North South East West United Great Saint San Los Las "
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "University Institute College School Street Avenue Road City State States Kingdom Republic Company Inc Ltd Corp Foundation Software License Licence Public General Creative Commons Project Version"
).split()
#: International calling codes of one and two digits; all others have three.
CODES1, CODES2 = ("1", "7"), ("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98").split()
#: Letters that stand for one another, by script.
VOWELS = ("aeiou", "áàâäãéèêëíìîïóòôöõúùûü", "аеиоуыэюя", "αεηιουω", "άέήίόύώ")
CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "çñß", "бвгджзклмнпрстфхцчшщ", "βγδζθκλμνξπρστφχψ")

_GENDER = {name: kind for kind, names in GIVEN.items() for name in names}
_CLASS = {ch: group for group in (*VOWELS, *CONSONANTS, "0123456789") for ch in group}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]+"
#: Kinds in the order in which they claim text.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"),
    "ip": re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w.])\+\d{1,3}(?:[ ./-]?(?:\(\d{1,4}\)|\d{1,4})){2,6}(?!\w)"  # any grouping after a +
        r"|(?<![\w.])\+\d{8,15}(?!\w)"
        r"|(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)"
        r"|(?<![\w.,/-])0\d(?: \d\d){4}(?! ?\w|[.,/-]\d)"  # pairs
        r"|(?<![\w.,/-])0\d{1,4}/\d{3,4}[ -]?\d{3,5}(?!\w|[.,/-]\d)"  # an area code before a slash
        r"|(?<=\w[ :.])(?<![\w.])\d{8,15}(?!\w)"  # bare digits, if a word for a telephone stands before them
    ),
}
_BARE = re.compile(r"\d{8,15}")
_TELEPHONE = re.compile(r"(?i:\b(?:tel|tele?phone|phone|call|mobile|cell|fax|whatsapp|text|ring)\w*)(?:\.|:| at| on| no\.?| number)*[ :.]$")
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? (?=({_CAPITAL})(?!\w))")
_NEXT = re.compile(rf" ({_CAPITAL})(?!\w)")
_WORD = re.compile(rf"(?<!\w){_CAPITAL}(?!\w)")
_FULL = re.compile(rf"(?<![\w@.-])({_CAPITAL}) (?:[A-Z]\. )?({_CAPITAL})(?![\w@])")
_LAST = re.compile(r"([^\W\d_]+)(?:( to)|( by)|:|,)? ?$")
_FIRST = re.compile(r",? ([^\W\d_]+)")


class Surrogates:
    """A keyed, fixed-point-free permutation of the values of each kind and format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mask(self, tag: str, n: int, value: int, modulus: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tag}|{n}|{value}".encode(), key=self.key, digest_size=32).digest(), "big") % modulus

    def shift(self, values: list[int], radices: list[int], tag: str) -> list[int]:
        """The next value on a keyed cycle through all of a mixed-radix domain.

        A Feistel network that adds in two halves permutes the domain; stepping
        by one inside it makes a single cycle. So different values stay
        different and none stays itself, if there is more than one.
        """
        tag = f"{tag}|{radices}"
        half = len(values) // 2
        sides = []
        for part in (slice(0, half), slice(half, None)):
            number, size = 0, 1
            for v, r in zip(values[part], radices[part], strict=True):
                number, size = number * r + v, size * r
            sides.append([number, size])
        (a, m), (b, n) = sides  # a part without letters has one value
        for k in range(0, 8, 2):
            a = (a + self._mask(tag, k, b, m)) % m
            b = (b + self._mask(tag, k + 1, a, n)) % n
        a, b = divmod((a * n + b + 1) % (m * n), n)
        for k in range(6, -1, -2):
            b = (b - self._mask(tag, k + 1, a, n)) % n
            a = (a - self._mask(tag, k, b, m)) % m
        out: list[int] = []
        for number, part in ((b, radices[half:]), (a, radices[:half])):
            for r in reversed(part):
                number, v = divmod(number, r)
                out.append(v)
        return out[::-1]

    def letters(self, text: str, tag: str) -> str:
        """``text`` with letters and digits replaced within their class; case and other characters stay."""
        low = [ch.lower() if len(ch.lower()) == 1 else ch for ch in text]
        at = [i for i, ch in enumerate(low) if ch in _CLASS]
        shape = "".join("." if ch in _CLASS else ch for ch in low)
        new = self.shift([_CLASS[low[i]].index(low[i]) for i in at], [len(_CLASS[low[i]]) for i in at], f"{tag}|{shape}") if at else []
        out = list(text)
        for i, v in zip(at, new, strict=True):
            ch = _CLASS[low[i]][v]
            out[i] = ch.upper() if text[i] != low[i] and len(ch.upper()) == 1 else ch
        return "".join(out)

    def digits(self, text: str, tag: str, keep: int = 0) -> str:
        """``text`` with its digits after the first ``keep`` replaced."""
        old = [int(ch) for ch in text if ch.isdigit()]
        new = iter(old[:keep] + self.shift(old[keep:], [10] * (len(old) - keep), f"{tag}|{old[:keep]}"))
        return "".join(str(next(new)) if ch.isdigit() else ch for ch in text)

    def card(self, text: str) -> str:
        """Numbers with a valid check digit map to such ones, others to others."""
        valid, new = luhn(text), self.digits(text, "card")
        while luhn(new) != valid:
            new = self.digits(new, "card")
        return new

    def iban(self, text: str) -> str:
        """Numbers with valid check digits map to such ones; others keep their distance from the right ones, so that none meet."""
        bare = text.replace(" ", "")
        right = lambda body: 98 - mod97(f"{body}{bare[:2]}00")
        body = self.letters(bare[4:], f"iban|{bare[:2]}")
        new = iter(f"{bare[:2]}{(int(bare[2:4]) - right(bare[4:]) + right(body)) % 100:02d}{body}")
        return "".join(ch if ch == " " else next(new) for ch in text)

    def phone(self, text: str) -> str:
        """An international number keeps its country; the grouping stays and doesn't matter."""
        digits = "".join(ch for ch in text if ch.isdigit())
        keep = 0 if text[0] != "+" else 1 if digits[0] in CODES1 else 2 if digits[:2] in CODES2 else 3
        return self.digits(text, f"phone{text[0] == '+'}", keep)

    def given(self, name: str) -> str:
        """Another given name of the same script and gender."""
        names = GIVEN[_GENDER[name]]
        ring = sorted(names, key=lambda x: hashlib.blake2b(x.encode(), key=self.key).digest())
        return ring[(ring.index(name) + 1) % len(ring)]

    def of(self, kind: str, text: str) -> str:
        if kind == "email":
            name, _, last = text.rpartition(".")
            return f"{self.letters(name, f'email|{last.lower()}')}.{last}"
        if kind == "ip":
            return ".".join(map(str, self.shift([int(x) for x in text.split(".")], [256] * 4, "ip")))
        if kind == "iban":
            return self.iban(text)
        if kind == "card":
            return self.card(text)
        if kind == "phone":
            return self.phone(text)
        if kind == "given":
            return self.given(text)
        return self.letters(text, kind) if kind in ("forename", "surname") else self.digits(text, kind)


def luhn(text: str) -> bool:
    digits = [int(ch) for ch in text if ch.isdigit()][::-1]
    return (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def mod97(text: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in text)) % 97


def canonical(kind: str, value: str) -> str:
    """The form in which two mentions of one entity are equal."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
    return value.replace(" ", "") if kind == "iban" else value


def _is(kind: str, text: str, m: re.Match) -> bool:
    """What a pattern can't tell of a match."""
    if kind != "phone":
        return True
    if not 7 <= sum(map(str.isdigit, m[0])) <= 15:
        return False
    return not _BARE.fullmatch(m[0]) or bool(_TELEPHONE.search(text[max(0, m.start() - 32) : m.start()]))


def _claim(taken: list[tuple[int, int, str]], text: str, kind: str, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """``taken``, in order and without overlaps, with the matches of a pattern that are clear of it; after one that isn't the search goes on."""
    starts, more, at = [s for s, _, _ in taken], [], 0
    while m := pattern.search(text, at):
        s, e = m.span()
        k = bisect_right(starts, s)
        met = taken[k - 1] if k and taken[k - 1][1] > s else taken[k] if k < len(taken) and taken[k][0] < e else None
        if met:
            at = max(met[1], s + 1)
        elif _is(kind, text, m):
            more.append((s, e, kind))
            at = e
        else:
            at = s + 1
    return sorted([*taken, *more]) if more else taken


def names(text: str) -> list[tuple[int, int, str]]:
    """Names: a known given name with or without a surname, a title and a surname, and two capitalised words beside a word of BEFORE or AFTER.

    Other mentions of a given name or surname that was found count too. Names in
    scripts without capitals, and single unknown names, aren't found.
    """
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    if len(words) < 2 and not any(w in _GENDER for _, _, w in words):
        return []
    last = {m[1] for m in _TITLED.finditer(text)} - _GENDER.keys()
    first: set[str] = set()
    common: set[str] = set()  # words that the text also has in lower case are no names

    def proper(word: str) -> bool:
        if word in NOT_NAMES or word in TITLES or word in _GENDER:
            return False
        if not common:
            common.update(text.split())
        return word.lower() not in common

    for (s, e, a), (s2, _, b) in pairwise([*words, (len(text) + 9, 0, "")]):
        if a in _GENDER and s2 == e + 1 and text[e] == " " and proper(b):
            last.add(b)
        elif s2 - e in (1, 4) and len(a) > 2 and len(b) > 2 and (m := _FULL.match(text, s)) and m[2] == b:
            before, after = _LAST.search(text[max(0, s - 20) : s]), _FIRST.match(text, m.end())
            cue = before and before[1].lower() in (BEFORE_TO if before[2] or before[3] else BEFORE)
            if (cue or (after and after[1] in AFTER)) and proper(a) and proper(b):
                first.add(a)
                last.add(b)
    kind = lambda w: "given" if w in _GENDER else "surname" if w in last else "forename" if w in first else None
    return [(s, e, k) for s, e, w in words if (k := kind(w))]


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found, in order, without overlaps; kinds claim text in the order of PATTERNS, names come last."""
    found: list[tuple[int, int, str]] = []
    if any(map(text.__contains__, "0123456789")):
        for kind, pattern in PATTERNS.items():
            found = _claim(found, text, kind, pattern)
    elif "@" in text:
        found = _claim(found, text, "email", PATTERNS["email"])
    named = names(text)
    if found:
        starts = [s for s, _, _ in found]
        clear = lambda s, e: (not (k := bisect_right(starts, s)) or found[k - 1][1] <= s) and (k >= len(found) or found[k][0] >= e)
        named = [x for x in named if clear(x[0], x[1])]
    return sorted([*found, *named])


def replace(text: str | None, surrogates: Surrogates, known: dict) -> tuple[str | None, int, int, int]:
    """The text with surrogates, and the numbers of mentions, different entities and different surrogates."""
    found = entities(text) if text else []
    if not found:
        return text, 0, 0, 0
    out, at, pairs = [], 0, set()
    for s, e, kind in found:
        value = text[s:e]
        new = known.get((kind, value))
        if new is None:
            new = surrogates.of(kind, value)
            if len(known) < 200_000:
                known[kind, value] = new
        pairs.add((kind, canonical(kind, value), canonical(kind, new)))
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), len(found), len({p[:2] for p in pairs}), len({(p[0], p[2]) for p in pairs})


COUNTS = ("n_entities", "n_distinct", "n_surrogates")


def anonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with ``text`` in which entities are replaced, n_entities, n_distinct and n_surrogates.

    A surrogate depends on the key, the kind and the entity only, so an entity
    has the same one in every document (coreference), whatever its case or
    separators. It is the entity's successor on a keyed cycle through all values
    of its kind and format, so two entities never share one and none keeps its
    own; the check counts both sides in each document (n_distinct =
    n_surrogates), ``collisions`` over a table. Given names stay in their script
    and gender, other names in their script and pattern of vowels; card numbers
    and IBANs keep valid check digits.

    Null texts stay null, empty ones empty; very long ones are read whole;
    repeated rows are treated alike; an empty table gives no rows; a text without
    entities comes back unchanged; columns of ``docs`` that aren't asked for,
    whatever their names, are ignored.
    """
    columns = tuple(c for c in columns if c != "text")

    def make():
        surrogates, known = Surrogates(key), {}
        return lambda texts: list(zip(*(replace(t, surrogates, known) for t in texts), strict=True)) or [[]] * 4

    return per_text(docs, columns, ", ".join(["text string", *(f"{c} long" for c in COUNTS)]), make)


def anonymise_documents(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and, where there is such a column, n_chars of the new text; all other columns stay as they are."""

    def make():
        surrogates, known = Surrogates(key), {}
        return lambda texts: ([replace(t, surrogates, known)[0] for t in texts],)

    out = per_text(docs, [c for c in docs.columns if c != "text"], "text string", make)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def collisions(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """Check over a whole table: (kind, surrogate, n, is_real) of surrogates that stand for several entities or equal one of the table.

    n is the number of entities; over 1 it is a collision, of which there are
    none by construction. A surrogate may be another entity's value (is_real):
    given names always are, others by chance.
    """

    def of(batches):
        surrogates = Surrogates(key)
        for pdf in batches:
            rows = {(kind, t[s:e]) for t in pdf["text"] if isinstance(t, str) for s, e, kind in entities(t)}
            yield pd.DataFrame([(k, canonical(k, v), canonical(k, surrogates.of(k, v))) for k, v in rows], columns=["kind", "value", "surrogate"])

    each = docs.select("text").mapInPandas(of, "kind string, value string, surrogate string").distinct()
    real = each.select("kind", F.col("value").alias("surrogate")).distinct().withColumn("is_real", F.lit(True))
    counted = each.groupBy("kind", "surrogate").agg(F.count_distinct("value").alias("n")).join(real, ["kind", "surrogate"], "left")
    return counted.select("kind", "surrogate", "n", F.coalesce("is_real", F.lit(False)).alias("is_real")).where("n > 1 OR is_real")
