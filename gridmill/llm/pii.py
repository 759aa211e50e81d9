"""Personal data and secrets, replaced by surrogates of the same kind, script and format.

A surrogate is the next of all strings of the entity's own form in a keyed order: the form's strings are numbered, a keyed
permutation gives each a place, and the surrogate is the string at the next place. So equal entities get equal surrogates
wherever they stand, distinct ones get distinct ones, none is its own, and no table of what was replaced is gathered. Digits
stay digits, vowels vowels, letters of a script letters of that script, and marks stay where they are. Where the next string
is of another sort (an invalid card number, a private address), the one after it is taken: a walk along one cycle, which is
again one-to-one among entities of one sort.

Entities that are written in two ways are one: phone numbers, cards and bank accounts are permuted as their digits, e-mail
addresses without case, and network addresses as numbers; the result is written in the way of the entity. ``check_collisions``
counts what is not distinct over a whole corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import batch, strings

#: Given names by gender and script.
NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carla Clara Diana Elena Emma Eva Greta Hannah Helen Ida Irene Jane Julia Karen Laura Lena Linda Lucia Maria Marta Mary Mia Nina Nora Olga Paula Petra Rosa Sarah Sofia Susan Teresa Vera".split(),
    ("m", "latin"): "Adam Albert Andreas Anton Bruno Carlos Daniel David Diego Emil Erik Felix Frank Georg Hans Henry Ivan Jack James Jan John Jonas Karl Leo Louis Luis Marco Mark Martin Max Michael Oscar Otto Paul Peter Robert Thomas Tom Victor William".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Татьяна".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
GENDER_OF = {name: key for key, names in NAMES.items() for name in names}
#: Titles before a name, by the gender that they tell (u: none).
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Госпожа госпожа г-жа Κυρία κυρία",
    "m": "Mr Herr Monsieur Señor Sr Don Господин господин г-н Κύριος κύριος",
    "u": "Dr Prof Доктор доктор Профессор профессор",
}
TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles.split()}
#: Titles after a name, in scripts that have no space before them.
TITLES_AFTER = "先生 女士 小姐 博士 教授 さん 様 씨 님".split()
#: Country calling codes of one and two digits; all others have three.
SHORT_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

WORD = r"[^\W\d_]"
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[^\W_](?:[^\W_]|-){0,62}(?:\.[^\W_](?:[^\W_]|-){0,62}){0,8}\.[^\W\d_]{2,24}(?![\w-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:sk|pk|rk)[-_](?:live[-_]|test[-_])?[A-Za-z0-9]{16,}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9_-])")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:.])")
IPV4 = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)")
INTERNATIONAL = re.compile(r"(?<![\w.])\+(?:\d{7,15}|\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6})(?![\w]|[.-]\d)")
LOCAL = re.compile(r"(?<![\w.-])(?:\(\d{2,4}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)")
#: A number with a trunk zero, as many countries write it at home.
NATIONAL = re.compile(r"(?<![\w.+/-])0\d{1,4}(?:[ ./-]\d{2,4}){2,5}(?![\w]|[./-]\d)")
_PART = rf"{WORD}[\w'’-]{{0,30}}"
TITLED = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, TITLE_GENDER))})\.?[ \u00a0]+({_PART}(?:[ \u00a0]{_PART})?)")
FOLLOWED = re.compile(rf"([\u4e00-\u9fff\u30a0-\u30ff\uac00-\ud7a3]{{2,3}})[ \u00a0]?(?:{'|'.join(TITLES_AFTER)})")
#: Listed names that are words too, and in capitals no sign of a person.
WORDS_TOO = set("Mark Max Frank Jack Victor Rosa".split())
_LISTED = [*GENDER_OF, *(n.upper() for n in GENDER_OF if n not in WORDS_TOO)]
GIVEN = re.compile(rf"(?:{'|'.join(sorted(_LISTED, key=len, reverse=True))})[ \u00a0]{_PART}(?:[ \u00a0]{_PART})?")  # begins with its letters, which are looked for fast
#: What people say before their own names, and what follows a name that is a place's.
SAID_BEFORE = "my name is|name's|je m['’]appelle|mon nom est|ich heiße|ich heisse|mein name ist|me llamo|mi nombre es|mi chiamo|меня зовут"
CALLED = re.compile(rf"(?i:(?<!\w)(?:{SAID_BEFORE}))[ \u00a0]+({_PART}(?:[ \u00a0]{_PART})?)")
PLACES = set("Street St Avenue Ave Road Rd Lane Square Boulevard Bridge Park Airport Straße Strasse Platz Allee".split())
#: Kinds in the order in which they take a place in the text.
DETECTORS: list[tuple[str, re.Pattern]] = [("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ipv6", IPV6), ("ipv4", IPV4), ("ssn", SSN), ("phone", INTERNATIONAL), ("card", CARD), ("phone", LOCAL), ("phone", NATIONAL)]

# Classes of letters; a letter is replaced by one of its own class.
_CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "ÇÑ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_CLASS = {c: chars for chars in _CLASSES for c in chars}


@cache
def class_of(c: str) -> str:
    """The letters or digits among which ``c`` is replaced: its fixed class, else those of its script and case in its block of 128. Empty for a mark."""
    if c in _CLASS or unicodedata.category(c)[0] not in "LN":
        return _CLASS.get(c, "")
    kind = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0])
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if x not in _CLASS and kind(x) == kind(c))


def _rounds(half: int, key: bytes) -> Callable[[int, int], int]:
    mask, size = (1 << half) - 1, (half + 7) // 8

    def f(i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(size, "big"), key=key, person=b"%d/%d" % (i, half), digest_size=min(64, size)).digest(), "big") & mask

    return f


def permuted(value: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 to size - 1, or its inverse: a Feistel network over the next even number of bits, walked until it is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, f = (1 << half) - 1, _rounds(half, key)
    while True:
        left, right = value >> half, value & mask
        if back:
            for i in reversed(range(8)):
                left, right = right ^ f(i, left), left
        else:
            for i in range(8):
                left, right = right, left ^ f(i, right)
        value = left << half | right
        if value < size:
            return value


def following(value: int, size: int, key: bytes) -> int:
    """The value at the next place of a keyed order of 0 to size - 1: one cycle through all, so never ``value`` itself if there is another."""
    return permuted((permuted(value, size, key) + 1) % size, size, key, back=True) if size > 1 else value


def reformatted(text: str, key: bytes, classes: Callable[[str], str] = class_of) -> str:
    """The next text of the same form: each character inside its class, all places together. At most 256 such places at a time."""
    out, at = list(text), [i for i, c in enumerate(text) if classes(c)]
    for start in range(0, len(at), 256):
        part = at[start : start + 256]
        value, size = 0, 1
        for i in part:
            chars = classes(text[i])
            value, size = value * len(chars) + chars.index(text[i]), size * len(chars)
        shape = "".join(classes(text[i])[0] for i in part).encode()
        value = following(value, size, hashlib.blake2b(shape, key=key, digest_size=32).digest())
        for i in reversed(part):
            chars = classes(text[i])
            value, k = divmod(value, len(chars))
            out[i] = chars[k]
    return "".join(out)


def among(chars: str) -> Callable[[str], str]:
    return lambda c: chars if c in chars else ""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_check(account: str) -> int:
    """What the two check digits of a bank account must be."""
    return 98 - int("".join(str(int(c, 36)) for c in account[4:] + account[:2] + "00")) % 97


def private(octets: list[int]) -> bool:
    a, b = octets[:2]
    return a in (0, 10, 127) or a >= 224 or (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _plain(s: str) -> str:
    return "".join(c for c in s if c.isalnum())


def _put(form: str, chars: str) -> str:
    """``chars`` in the places of the letters and digits of ``form``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _valid(kind: str, text: str) -> bool:
    if kind == "ipv4":
        return all(len(x) == 1 or x[0] != "0" for x in text.split(".")) and all(int(x) < 256 for x in text.split("."))
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(text) is not None and any(c.isdigit() for c in text)
        except ValueError:
            return False
    if kind == "card":
        return 13 <= len(_digits(text)) <= 19
    if kind == "phone":
        return 7 <= len(_digits(text)) <= 15 if text[0] != "0" or LOCAL.fullmatch(text) else 9 <= len(_digits(text)) <= 11
    if kind == "secret":
        return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)
    return True


def _number(text: str) -> tuple[str, int]:
    """The calling code of a phone number, and where in its text the number itself begins; 0 is a trunk zero, other local forms are those of code 1."""
    if not text.startswith("+"):
        return ("0", 1) if text[0] == "0" and not LOCAL.fullmatch(text) else ("1", 0)
    digits = _digits(text)
    code = next((digits[:k] for k in (1, 2) if digits[:k] in SHORT_CODES), digits[:3])
    at, left = 0, len(code)
    while left:
        left -= text[at].isdigit()
        at += 1
    return code, at


def _length(text: str) -> int:
    """How much of a match is the phone number: codes of one digit have ten more, and a number that follows is not part of it."""
    if _number(text)[0] in ("1", "7") and len(_digits(text)) > 11:
        at = [i for i, c in enumerate(text) if c.isdigit()][10] + 1
        if not text[at].isdigit():
            return at + (text[at] == ")")
    return len(text)


@dataclass(frozen=True)
class Surrogates:
    """Surrogates under one key."""

    key: bytes

    def _of(self, kind: str) -> bytes:
        return hashlib.blake2b(kind.encode(), key=self.key, digest_size=32).digest()

    def step(self, kind: str, text: str) -> str:
        """The next entity of this kind and form."""
        key = self._of(kind)
        if kind == "ipv4":
            return ".".join(map(str, following(int.from_bytes(bytes(map(int, text.split("."))), "big"), 1 << 32, key).to_bytes(4, "big")))
        if kind == "ipv6":
            return self._ipv6(text, key)
        if kind == "secret":
            for digits in ("0123456789abcdef", "0123456789ABCDEF"):
                if all(c in digits for c in text):
                    return reformatted(text, key, among(digits))
            head = re.match(r"(?:sk|pk|rk)[-_](?:live[-_]|test[-_])?|AKIA|gh[pousr]_|xox[abprs]-|AIza", text)
            cut = head.end() if head else 0
            return text[:cut] + reformatted(text[cut:], key)
        if kind == "email":
            local, _, domain = text.lower().rpartition("@")
            host, _, top = domain.rpartition(".")
            new = f"{reformatted(local, key)}@{reformatted(host, key)}.{top}"
            return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(text, new, strict=True)) if len(new) == len(text) else new
        if kind == "iban":
            account = _plain(text)
            new = account[:4] + reformatted(account[4:], key)
            return _put(text, new[:2] + f"{iban_check(new):02}" + new[4:] if iban_check(account) == int(account[2:4]) else new)
        if kind == "phone":
            code, at = _number(text)
            trunk = re.match(r"[ .-]?\(0\)", text[at:])
            at += trunk.end() if trunk else 0
            return text[:at] + _put(text[at:], reformatted(_digits(text[at:]), self._of(f"phone {code}")))
        if kind == "card":
            return _put(text, reformatted(_digits(text), key))
        return reformatted(text, key)

    @staticmethod
    def _ipv6(text: str, key: bytes) -> str:
        """Groups that are zero stay so; the first group says what an address is for, and stays if there is another."""
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        at = [i for i, g in enumerate(groups) if g]
        at = at[1:] if len(at) > 1 and at[0] == 0 else at
        value = 0
        for i in at:
            value = value * 65_535 + groups[i] - 1
        value = following(value, 65_535 ** len(at), hashlib.blake2b(bytes([*at, groups[0] >> 8, groups[0] & 255] if at and at[0] else at), key=key, digest_size=32).digest())
        for i in reversed(at):
            value, g = divmod(value, 65_535)
            groups[i] = g + 1
        new = ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups))
        out = new.compressed if "::" in text else new.exploded if all(len(g) == 4 for g in text.split(":")) else ":".join(f"{g:x}" for g in groups)
        return out.upper() if any(c.isupper() for c in text) else out

    def same_sort(self, kind: str, old: str, new: str) -> bool:
        """Whether the replacement is of the entity's own sort: a valid card number for a valid one, a public address for a public one."""
        if kind == "card":
            return luhn(_digits(old)) == luhn(_digits(new))
        if kind == "iban":
            right = lambda x: iban_check(_plain(x)) == int(_plain(x)[2:4])
            return right(old) == right(new)
        if kind == "ipv4":
            return private([int(x) for x in old.split(".")]) == private([int(x) for x in new.split(".")])
        return kind != "secret" or _valid(kind, new)

    def __call__(self, kind: str, text: str) -> str:
        """The first entity of the same sort along the cycle. That is one-to-one, among the entities of one sort."""
        if kind == "name":
            return self.name(text)
        new = self.step(kind, text)
        while not self.same_sort(kind, text, new):
            new = self.step(kind, new)
        return new

    def name(self, text: str) -> str:
        """A listed given name by another of its gender and script; any other word by letters of their own classes, all but the last.

        A word's surrogate depends on the word alone, not on titles or its place, so a person has one everywhere. All words
        that are not listed go through one one-to-one order, so no two fall together, and none becomes a listed name. The last
        letter stays, as it tells a name's gender in many languages. A word in capitals is the same word.
        """
        words = re.split(r"([ \u00a0])", text)
        for i in range(0, len(words), 2):
            base = canonical(words[i])
            new = self._word(base)
            words[i] = new if base == words[i] else new.upper()
        return "".join(words)

    def _word(self, word: str) -> str:
        if word in GENDER_OF:
            names = NAMES[GENDER_OF[word]]
            return names[following(names.index(word), len(names), self._of("".join(GENDER_OF[word])))]
        new = self._letters(word)
        while new in GENDER_OF:
            new = self._letters(new)
        return new

    def _letters(self, word: str) -> str:
        cut = len(word) - (len(word) > 2 and script_of(word) in ALPHABETS)
        return reformatted(word[:cut], self._of(f"name {word[cut:]}")) + word[cut:] if word else word


#: Scripts in which a name's end may tell its gender.
ALPHABETS = {"latin", "cyrillic", "greek"}


def canonical(word: str) -> str:
    """A word in capitals as it is written otherwise, if that can be undone."""
    plain = word[:1] + word[1:].lower()
    return plain if len(word) > 1 and word.isupper() and plain.upper() == word and len(plain) == len(word) else word


def script_of(word: str) -> str:
    return unicodedata.name(word[0], "").split(" ")[0].lower()


def _named(word: str) -> bool:
    """Whether a word may be a name: a capital first, or a script without capitals."""
    return word[0].isupper() or word[0].lower() == word[0].upper() or word[0].istitle()


def given_names(text: str) -> Iterator[re.Match]:
    """Listed given names that begin a word, with one or two words after them."""
    at = 0
    while m := GIVEN.search(text, at):
        begins = not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_'’-")
        at = m.end() if begins else m.start() + 1
        if begins:
            yield m


def _bare(words: list[str]) -> list[str]:
    """The words of a name without a possessive ending; nothing after one belongs to the name."""
    for i, w in enumerate(words):
        if len(w) > 3 and w[-2:] in ("'s", "’s", "'S", "’S"):
            return [*words[:i], w[:-2]]
    return words


def persons(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of names with a title, after words by which people give their names, or of a listed given name and what follows."""
    titled = TITLED.finditer(text) if any(t in text for t in TITLE_GENDER) else ()
    for m, at in itertools.chain(((m, 2) for m in titled), ((m, 1) for m in CALLED.finditer(text))):
        words = _bare(re.split(r"[ \u00a0]", m[at]))
        if _named(words[0]):
            if len(words) == 2 and not _named(words[1]):
                words.pop()
            yield m.start(at), m.start(at) + len(" ".join(words))
    for m in given_names(text):
        words = _bare(re.split(r"[ \u00a0]", m[0]))
        if any(w.rstrip(".") in PLACES for w in words[1:]):
            continue
        while len(words) > 1 and not words[-1][0].isupper():
            words.pop()
        shouted = words[0] not in GENDER_OF
        if len(words) > 1 and words[1][0].isupper() and (not shouted or words[1].isupper() and len(words[1]) > 1):
            yield m.start(), m.start() + len(" ".join(words))
    for m in FOLLOWED.finditer(text) if any(t in text for t in TITLES_AFTER) else ():
        yield m.start(1), m.end(1)


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, in order, none over another."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    has_digit, has_at, has_colons = re.search(r"\d", text), "@" in text, text.count(":") > 1
    for kind, pattern in DETECTORS:
        if not (has_at if kind == "email" else has_digit and (has_colons or kind != "ipv6")):
            continue
        for m in pattern.finditer(text):
            a, b = m.start(), m.start() + (_length(m[0]) if pattern is INTERNATIONAL else len(m[0]))
            if _valid(kind, text[a:b]) and 1 not in taken[a:b]:
                found.append((a, b, kind))
                taken[a:b] = b"\1" * (b - a)
    names: set[str] = set()
    for a, b in persons(text):
        words = [w for w in re.split(r"[ \u00a0]", text[a:b]) if len(w) > 2 or script_of(w) not in ALPHABETS]
        names |= {x for w in words for x in (w, canonical(w), w.upper())}
        if 1 not in taken[a:b]:
            found.append((a, b, "name"))
            taken[a:b] = b"\1" * (b - a)
    if names:  # the same person without the title; a possessive ending stays
        for m in re.finditer(rf"(?<![\w'’-])(?:{'|'.join(sorted(map(re.escape, names), key=len, reverse=True))})(?![\w-])(?!['’](?![sS](?!\w))\w)", text):
            if 1 not in taken[m.start() : m.end()]:
                found.append((m.start(), m.end(), "name"))
    return sorted(found)


def replacer(key: bytes) -> Callable[[str], tuple[str, dict[str, int]]]:
    """A function from a text to its replacement and the number of entities of each kind."""
    surrogate = lru_cache(100_000)(Surrogates(key))

    def replace(text: str) -> tuple[str, dict[str, int]]:
        out, at, counts = [], 0, {}
        for a, b, kind in entities(text):
            out += [text[at:a], surrogate(kind, text[a:b])]
            at = b
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[at:]]) if out else text, counts

    return replace


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replaces personal data and secrets by surrogates under ``key``, a secret of the caller's.

    Returns ``doc_id, text, n_entities, kinds``, one row for each row of ``docs``, without an exchange; ``kinds`` counts the
    entities of each kind as ``kind:n``, in order of kind. Found are: e-mail addresses, keys and hex secrets, bank accounts,
    network addresses, US social security numbers, card and phone numbers (international, of three, three and four digits, or
    with a trunk zero), names after a title or a phrase such as "my name is", listed given names with a surname, names before
    an East Asian title, and these names' words wherever else they stand in the text, in capitals and with a possessive too;
    not found are other names, and postal addresses. A name has one surrogate in all texts. A null text stays null with 0 entities.
    A very long text is searched whole. Repeated rows get the same answer; null ids stay; an empty table gives no row; other
    columns are not read, whatever their names.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("kinds", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = replacer(key)
        for b in batches:
            said = [act(t) if t is not None else (None, {}) for t in b.column(1).to_pylist()]
            yield batch(schema, [b.column(0), [t for t, _ in said], [sum(c.values()) for _, c in said], [",".join(f"{k}:{c[k]}" for k in sorted(c)) for _, c in said]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, n_entities long, kinds string")


def replace_in_place(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, whatever their names, the text replaced as by ``replace``; ``n_chars``, if there, counts the new text.

    A null text stays null, with a null ``n_chars``; repeated rows stay, each with the same answer; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = replacer(key)
        for b in batches:
            new = [None if t is None else act(t)[0] for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def check_collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """For each kind: how many distinct entities, how many distinct surrogates, and how many surrogates are entities of the corpus.

    Entities are counted by an exchange of their digests, of the form in which two writings of one entity are the same; as
    many surrogates as entities means that none fell together. The words of names are counted by themselves as well, as the
    kind ``name word``. Listed names stand for one another, so they are met. A null or empty text, like an empty table,
    gives nothing to count; other columns are not read; very long texts are searched whole, and rows that repeat count once.
    """

    def plain(kind: str, text: str) -> str:
        if kind == "email":
            return text.lower()
        if kind == "ipv6":
            return ipaddress.IPv6Address(text).compressed
        if kind in ("name", "name word"):
            return " ".join(map(canonical, re.split(r"[ \u00a0]", text)))
        return (_number(text)[0] + " " + _digits(text[_number(text)[1] :])) if kind == "phone" else _plain(text) if kind in ("card", "iban") else text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogate = lru_cache(100_000)(Surrogates(key))
        names = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())])
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()
        for b in batches:
            seen = {(k, t[a:e]) for t in strings(b.column(0)) for a, e, k in entities(t)}
            said = [(k, x, surrogate(k, x)) for k, x in seen]
            parts = {("name word", w, n) for k, x, y in said if k == "name" for w, n in zip(re.split(r"[ \u00a0]", x), re.split(r"[ \u00a0]", y), strict=True)}
            said += sorted(parts)
            yield batch(names, [[k for k, _, _ in said], [digest(plain(k, x)) for k, x, _ in said], [digest(plain(k, y)) for k, _, y in said]])

    pairs = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    known = pairs.select("kind", F.col("entity").alias("surrogate")).distinct().withColumn("known", F.lit(1))
    return pairs.join(known, ["kind", "surrogate"], "left").groupBy("kind").agg(F.countDistinct("entity").alias("entities"), F.countDistinct("surrogate").alias("surrogates"), F.count("known").alias("met"))
