"""Personal data: every detected entity gets a keyed surrogate of its own type, script, gender and format.

Numbers and other character data go through a keyed permutation of all strings of the same shape (a Feistel
network over each shape, cycle-walked to valid values), so different entities of a shape get different
surrogates by construction; names are drawn by a keyed digest from lists of their script and gender.  A
surrogate belongs to the canonical form of an entity (digits of a phone number, lower-cased address, ...) and
is written in the format of each occurrence, so an entity keeps one surrogate in all documents.

A name is the words with a capital after a title (of any number; small words like "de" and initials stay); its
words are then found everywhere in the same text where they stand with a capital.  Without a title a name is
seen where a common given name with a capital stands before a family name.  Other names are not seen.  A neutral title leaves the gender to the text's other titles, then to
the lists of names.  In a text all in capitals a name ends at punctuation or a common function word only.

Collision checks run in Spark over all distinct entities of the corpus: an entity whose surrogate is its own
text, the text of any other entity, or the surrogate of a smaller one is drawn again under the next attempt,
until none is left.  Where the corpus holds more than a CROWDED share of all strings of a shape (all of 192.168.*.*, say),
no such strings are left to give; there every entity keeps attempt 0, whose permutation still tells them all apart.
Only those redrawn leave attempt 0; they are sent to every executor where they are few bytes (checked), else joined to
the documents that hold them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import lru_cache
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh, text_bytes, with_row_key, written

#: Bytes of redrawn entities that may be sent to every executor.
BROADCAST_BYTES = 16 << 20
#: Share of a shape's strings that may be entities of the corpus.
CROWDED = 0.25

GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Emma Clara Nora Elena Alice Irene Marta Sofia Lucia Helena Teresa Olivia Johanna Camille Amelie Ingrid".split(),
    ("latin", "m"): "Peter Martin David Simon Thomas Daniel Paul Victor Hugo Oscar Anton Felix Henri Louis Carlos Diego Stefan Walter Robert Philip".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана Вера Нина".split(),
    ("cyrillic", "m"): "Пётр Иван Сергей Андрей Николай Михаил Алексей Дмитрий Павел Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη".split(),
    ("greek", "m"): "Νίκος Γιώργος Πέτρος Ανδρέας Κώστας Δημήτρης".split(),
}
_TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Srta Dña Госпожа Г-жа Κυρία".split(),
    "m": "Mr Sir Herr Monsieur Señor Sr Don Господин Г-н Κύριος".split(),
    "n": "Dr Doctor Doktor Docteur Prof Professor Professeur Mx Доктор Профессор Δρ".split(),
}
_GENDER = {x: g for g, ts in _TITLES.items() for t in ts for x in (t, t.upper())}
#: Common given names; before a word with a capital they make a name without a title.
_FIRST = {
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie
        Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Ruth Katherine Samantha Christine Rachel Catherine Carolyn Janet Heather Diane Virginia Julie Joyce Jane Hannah
        Ursula Monika Petra Sabine Renate Karin Brigitte Heike Andrea Gabriele Susanne Claudia Birgit Kerstin Silke Anja Ulrike Gisela Katrin Nathalie Isabelle Sylvie Françoise Véronique Monique
        Céline Sandrine Chantal Aurélie Hélène Élodie Léa Chloé Manon Carmen Isabel Pilar Dolores Josefa Teresa Rosario Cristina Lucía María Raquel Beatriz Rocío Mercedes Inés Paula""".split(),
    "m": """James John Michael William Richard Joseph Charles Christopher Matthew Anthony Donald Steven Andrew Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob
        Nicholas Gary Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Patrick Alexander Jack Dennis Jerry Tyler Aaron Adam Nathan Henry Douglas Zachary Kyle Noah Ethan
        Hans Jürgen Klaus Wolfgang Uwe Dieter Manfred Helmut Günter Gerhard Heinz Werner Bernd Rainer Jens Ralf Andreas Matthias Jörg Sebastian Johannes Pierre Jean Michel Alain Philippe Jacques
        Nicolas François Laurent Julien Olivier Thierry Guillaume Étienne Mathieu Antonio José Manuel Francisco Javier Jesús Miguel Alejandro Rafael Fernando Pablo Jorge Alberto Sergio Álvaro Luis""".split(),
}
_FIRST = {g: set(ns) | {n for (_, x), listed in GIVEN.items() if x == g for n in listed} for g, ns in _FIRST.items()}
_FIRSTS = _FIRST["f"] | _FIRST["m"]
_LISTED = {n.lower(): g for g, ns in _FIRST.items() for n in ns} | {n.lower(): g for (_, g), ns in GIVEN.items() for n in ns}
#: Small words inside a name; kept as they are.
_PARTICLES = "de del la las los von van der den dem zu zur di da dal della dos das du le ter ten af av al el bin ibn".split()
#: In capitals these end a name, which no lower case shows there.
_NO_NAME = frozenset(
    "A AN THE AND OR OF TO IN ON AT BY FOR FROM WITH AS IS ARE WAS WERE BE HAS HAVE HAD WILL WOULD CAN MAY MUST NOT WHO SAID I YOU HE SHE IT WE THEY HIS HER UND ODER DER DIE DAS IST WAR HAT MIT EL LOS Y O ES CON QUE ET OU LE LES EST A POUR".split()
)
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we".split(),
    "cyrillic": "ба бе бо да де до га ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве".split(),
    "greek": "βα βε βο δα δε δο γα κα κο λα λε λο μα με μο να νε νο πα πε ρα ρε σα σε τα τε".split(),
}
_ENDING = {("latin", "f"): "ina", ("latin", "m"): "an", ("latin", "n"): "is", ("latin", "s"): "ner", ("cyrillic", "f"): "ина", ("cyrillic", "m"): "ан", ("cyrillic", "n"): "ей", ("cyrillic", "s"): "нов", ("greek", "f"): "ίνα", ("greek", "m"): "ος", ("greek", "n"): "ις", ("greek", "s"): "ίδης"}

_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])")
_LOCAL = re.compile(r"[\w.+%-]+")
_KEY = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"
    r"|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    re.S,
)
_KEY_HINTS = ("-----BEGIN ", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza", "eyJ")
_SECRET = re.compile(r"(?i:(?<![^\W_])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)[\"']?\s*[=:]\s*[\"']?)([^\s\"',;]{6,})")
_SECRET_HINTS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "key")
#: What begins with a digit, a plus or a bracket; tried at such characters only.
_NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|-(?!\d)))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w))"
)
_US_PHONE = re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)")
_STARTS = re.compile(r"[0-9+(]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])")
_TITLE = rf"(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})"
_NEUTRAL = rf"(?:{'|'.join(sorted((x for x, g in _GENDER.items() if g == 'n'), key=len, reverse=True))})"
_TITLED = re.compile(rf"(?<!\w)({_TITLE}(?:\.? {_NEUTRAL})*)(?!\w)(?=\.? )")
_PART = re.compile(rf" (?:(?:{'|'.join(_PARTICLES)}) ){{0,3}}({_NAME})")
#: Words with a capital next to each other, initials between them.
_FULL = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-ÞΆ-ΫА-Я][^\W\d_]+(?:[-'’][^\W\d_]+)*(?: (?:[A-Z]\.? )?[A-ZÀ-ÖØ-ÞΆ-ΫА-Я][^\W\d_]+(?:[-'’][^\W\d_]+)*)+")
_OWNER = re.compile(r"(?<=.)['’][sS]\Z")
_DIGIT = re.compile(r"[0-9]")
#: What stands before four numbers that are no address.
_VERSION = re.compile(r"(?i:\b(?:version|versión|versions?nummer|ver|release|build|revision|rev|firmware|section|abschnitt|chapter|kapitel)[.:]? ?)\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _shorter_card(run: str) -> str | None:
    """The longest card number (13 digits or more) that begins the run and ends before one of its separators."""
    for m in reversed(list(re.finditer(r"[ -]", run))):
        digits = re.sub(r"\D", "", run[: m.start()])
        if len(digits) < 13:
            return None
        if luhn(digits):
            return run[: m.start()]
    return None


def _people(text: str):
    """(start, end, kind) of the words of names: those after a title, then other mentions of them with a capital."""
    people = []
    for m in _TITLED.finditer(text):
        gender = next((g for t in re.split(r"\.? ", m[1]) if (g := _GENDER[t]) != "n"), "n")
        words, at, dot = [], m.end(), True
        while True:
            at += dot and text[at : at + 1] == "."
            w = _PART.match(text, at)
            if not w or not text[w.start(1)].isupper():
                break
            a, at = w.span(1)
            dot = at == a + 1 and text[at : at + 1] == "."  # an initial stays
            if dot:
                continue
            if w[1] in _NO_NAME and (words or m[1].isupper()):
                break
            words.append((a, a + len(_OWNER.sub("", w[1]))))
        people.append((gender, words))
    taken = {a for _, words in people for a, _ in words}
    for m in _FULL.finditer(text):  # given names that are listed, then a family name
        words = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(_NAME, m[0]) if len(w[0]) > 1]
        while len(words) > 1 and text[slice(*words[0])] not in _FIRSTS:
            words.pop(0)
        if len(words) > 1 and not taken.intersection(a for a, _ in words):
            last = words[-1]
            words[-1] = (last[0], last[0] + len(_OWNER.sub("", text[slice(*last)])))
            people.append((_LISTED[text[slice(*words[0])].lower()], words))
    genders = {text[a:e].lower(): g for g, words in people if g != "n" for a, e in words[:-1]}
    kinds: dict[str, str] = {}
    for gender, words in people:
        for k, (a, e) in enumerate(words):
            name = text[a:e].lower()
            own = genders.get(name) or _LISTED.get(name, "n") if gender == "n" else gender
            kind = f"name-{_script(name)}-{'s' if k == len(words) - 1 else own}"
            kinds.setdefault(name, kind)
            yield a, e, kind
    if names := {f for n in kinds if len(n) > 1 for f in (n.title(), n.upper(), n.capitalize())} | {text[a:e] for _, words in people for a, e in words if e > a + 1}:
        titled = {a for _, words in people for a, _ in words}
        for m in re.finditer(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?![^\W_])", text):
            if m.start() not in titled and (kind := kinds.get(m[0].lower())):
                yield m.start(), m.end(), kind


def _spans(text: str):
    """(start, priority, end, kind, canonical form) of whatever looks like an entity; may overlap."""
    at, last = text.find("@"), 0
    while at >= 0:
        if local := _LOCAL.match(text[last:at][::-1]):  # backwards; what lies before the "@" before is never looked at again
            if m := _EMAIL.match(text, at - local.end()):
                yield m.start(), 1, m.end(), "email", m[0].lower()
        last = at + 1
        at = text.find("@", last)
    if any(x in text for x in _KEY_HINTS):
        for m in _KEY.finditer(text):
            yield m.start(), 0, m.end(), "secret", m[0]
    low = text.lower()
    if any(x in low for x in _SECRET_HINTS):
        for m in _SECRET.finditer(text):
            yield m.start(1), 2, m.end(1), "secret", m[1]
    if any(x in text for x in _GENDER) or not _FIRSTS.isdisjoint(re.split(r"[\s\"'(\[]", text)):
        for a, e, kind in _people(text):
            yield a, 8, e, kind, text[a:e].lower()
    if not _DIGIT.search(text):
        return
    for m in _HEX.finditer(text):
        if not m[0].isdigit() and not m[0].isalpha():
            yield m.start(), 3, m.end(), "secret", m[0]
    for m in _IBAN.finditer(text):
        if iban(m[0].replace(" ", "")):
            yield m.start(), 4, m.end(), "iban", m[0].replace(" ", "")
    done = 0
    for c in _STARTS.finditer(text):
        if c.start() < done or not (m := _NUMBER.match(text, c.start())):
            continue
        kind, s = m.lastgroup, m[0]
        if kind == "ip" and _VERSION.search(text, max(0, m.start() - 16), m.start()):
            done = m.end()
            continue
        digits = re.sub(r"\D", "", s)
        end = m.end()
        if kind == "card" and not luhn(digits):
            if m := _US_PHONE.match(text, c.start()):
                kind, s = "phone", m[0]
            elif short := _shorter_card(s):
                s = short
            else:
                continue
            end = c.start() + len(s)
            digits = re.sub(r"\D", "", s)
        if kind == "phone" and not 8 <= len(digits) <= 15:
            continue
        done = end
        canonical = {"ip": ".".join(str(int(x)) for x in s.split(".")) if kind == "ip" else ""}.get(kind, digits)
        if kind == "phone" and len(digits) == 11 and digits[0] == "1":
            canonical = digits[1:]
        yield c.start(), 5, end, kind, canonical


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, in order; of overlapping ones the first, then the more special."""
    out: list[tuple[int, int, str, str]] = []
    at = 0
    for a, _, e, kind, canonical in sorted(set(_spans(text))):
        if a >= at:
            out.append((a, e, kind, canonical))
            at = e
    return out


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


class Keyed:
    """Surrogates under a key."""

    def __init__(self, key: bytes):
        self.key = key
        self.draw = lru_cache(200_000)(self._draw)

    def _number(self, *parts) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=self.key, digest_size=16).digest(), "big")

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A keyed permutation of 0..n-1: a Feistel network over a square not much larger, walked back into it."""
        side = 1
        while side * side < n:
            side *= 2
        if side * side // 4 >= n:
            side //= 2
        while True:
            a, b = divmod(x, side)
            for r in range(6):
                a, b = b, (a + self._number("round", r, tweak, n, b)) % side
            x = a * side + b
            if x < n:
                return x

    def shape(self, s: str, tweak: str) -> str:
        """Letters and digits permuted within all strings of the same shape; other characters stay."""
        out = list(s)
        value, n, places = 0, 1, []
        for i, c in enumerate(s):
            size, base = (10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (0, "")
            if size:
                value, n = value * size + ord(c) - ord(base), n * size
                places.append((i, size, base))
        value = self.permute(value, n, tweak + re.sub(r"[A-Za-z0-9]", "", s)) if n > 1 else 0
        for i, size, base in reversed(places):
            value, d = divmod(value, size)
            out[i] = chr(ord(base) + d)
        return "".join(out)

    def _walk(self, s: str, tweak: str, good) -> str:
        """shape() applied until the value is valid again, which keeps it one-to-one on valid values."""
        for _ in range(10_000):
            s = self.shape(s, tweak)
            if good(s):
                return s
        raise ValueError(f"no valid surrogate of the shape of a {tweak}")

    def _draw(self, kind: str, canonical: str, attempt: int) -> str:
        tweak = f"{kind}/{attempt}"
        if kind == "email":
            local, _, domain = canonical.partition("@")
            head, _, top = domain.rpartition(".")
            if self.shape(local, tweak) == local and not re.search(r"[a-z0-9]", local):  # nothing there to permute
                local = "user" + str(self._number("email", canonical, attempt) % 10**12)
            labels = ".".join(x if x == "example" else self.shape(x, tweak) for x in head.split("."))
            return f"{self.shape(local, tweak)}@{labels}.{top}"
        if kind == "card":
            head, body = canonical[0], self.shape(canonical[1:-1], tweak + canonical[0])
            return next(head + body + str(d) for d in range(10) if luhn(head + body + str(d)))
        if kind == "ssn":
            return self._walk(canonical, tweak, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000") if canonical[0] != "9" else canonical[0] + self.shape(canonical[1:], tweak)
        if kind == "phone":
            head = "" if len(canonical) == 10 else canonical[:2]
            body = canonical[len(head) :]
            return head + (self._walk(body, tweak + head, lambda s: s[0] not in "01") if body[0] not in "01" else self.shape(body, tweak + head))
        if kind == "ip":
            x = int(ipaddress.IPv4Address(canonical))
            for net in _PRIVATE:
                if x in range(int(net[0]), int(net[-1]) + 1):
                    return str(net[self.permute(x - int(net[0]), net.num_addresses, tweak)])
            public = ipaddress.IPv4Address(x).is_global
            while True:
                x = self.permute(x, 1 << 32, tweak)
                a = ipaddress.IPv4Address(x)
                if a.is_global == public and not any(a in net for net in _PRIVATE):
                    return str(a)
        if kind == "iban":
            body = self.shape(canonical[4:], tweak + canonical[:2])
            check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
            return f"{canonical[:2]}{check:02d}{body}"
        if kind.startswith("name-"):
            _, script, gender = kind.split("-")
            listed = GIVEN.get((script, gender))
            n = self._number("name", kind, canonical, attempt)
            if listed and not attempt:
                return listed[n % len(listed)].lower()
            out = []
            for _ in range(2 + max(1, attempt)):  # some 30 times as many names with each attempt
                n, k = divmod(n, len(_SYLLABLES[script]))
                out.append(_SYLLABLES[script][k])
            return "".join(out) + _ENDING[script, gender]
        if not re.search(r"[A-Za-z0-9]", canonical):
            return "".join("*" for _ in canonical)
        if canonical[:4] in ("AKIA", "ASIA"):
            return canonical[:4] + self.shape(canonical[4:], tweak)
        m = re.match(r"gh[pousr]_|sk-|xox[abprs]-|AIza|-----BEGIN [A-Z ]*-----", canonical)
        head = m[0] if m else ""
        tail = m2[0] if (m2 := re.search(r"-----END [A-Z ]*-----\Z", canonical)) else ""
        body = canonical[len(head) : len(canonical) - len(tail)]
        if re.fullmatch(r"[0-9a-f]+", body):
            return head + f"{self.permute(int(body, 16), 16 ** len(body), tweak):0{len(body)}x}" + tail
        return head + self.shape(body, tweak) + tail


def shape_of(kind: str, canonical: str) -> tuple[str, float]:
    """The strings among which attempt 0 permutes an entity: a name for them, and how many there are."""
    if kind.startswith("name-"):
        return "", inf  # drawn anew with ever longer names
    if kind == "ip":
        x = ipaddress.IPv4Address(canonical)
        net = next((n for n in _PRIVATE if x in n), None)
        return str(net or x.is_global), float(net.num_addresses if net else 1 << 31)
    head, fixed = {"card": (1, 2), "iban": (4, 4), "phone": (0 if len(canonical) == 10 else 2, 0)}.get(kind, (0, 0))
    if kind == "email":
        canonical, _, top = canonical.rpartition(".")
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", canonical[head:])))
    room = 26.0 ** sum(c in "aA" for c in shape[:200]) * 10.0 ** (shape.count("0", 0, 200) - (fixed == 2))
    return canonical[: head if kind != "iban" else 2] + shape + (f".{top}" if kind == "email" else ""), room


_PRIVATE = [ipaddress.IPv4Network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")]


def render(kind: str, surrogate: str, written_: str) -> str:
    """The surrogate in the format of an occurrence: its separators, prefix and case."""
    if kind in ("phone", "card", "ssn"):
        held = re.sub(r"\D", "", written_)
        digits = iter(held[: len(held) - len(surrogate)] + surrogate)
        return re.sub(r"\d", lambda _: next(digits), written_)
    if kind == "iban":
        chars = iter(surrogate)
        return re.sub(r"[A-Z0-9]", lambda _: next(chars), written_)
    if kind.startswith("name-"):
        return surrogate.upper() if written_.isupper() and len(written_) > 1 else surrogate.title() if written_[0].isupper() else surrogate
    if kind == "email":
        return surrogate.upper() if written_.isupper() else surrogate
    return surrogate


def _entities(batches):
    for b in batches:
        found = {(k, c) for t in text_bytes(b.column("text")) if t for _, _, k, c in find(t.decode("utf-8", "replace"))}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["kind", "canonical"])


def _drawer(key: bytes):
    def draw(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        keyed = Keyed(key)
        return pd.Series([keyed.draw(k, c, int(a)) for k, c, a in zip(kind, canonical, attempt)], dtype=object)

    return F.pandas_udf(draw, "string")


def _shapes():
    def shapes(kind: pd.Series, canonical: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape_of(k, c) for k, c in zip(kind, canonical)], columns=["shape", "room"])

    return F.pandas_udf(shapes, "struct<shape:string,room:double>")


def redraws(documents: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt) of the entities that don't keep attempt 0, so that no two share a surrogate and none is a real entity.

    Entities of crowded shapes keep it, and share no surrogates all the same.
    """
    draw = _drawer(key)
    entities = written(documents.select("text").mapInArrow(_entities, "kind string, canonical string").distinct(), "entities")
    family = lambda c: F.regexp_replace(c, "^(name-[a-z]+)-.*", "$1")
    first = entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw("kind", "canonical", "attempt"))
    settled = written(first.withColumn("s", _shapes()("kind", "canonical")).select("kind", "canonical", "attempt", "surrogate", F.sha2("s.shape", 256).alias("shape"), "s.room"), "surrogates")
    crowded = settled.where(f"room < {1e15 / CROWDED}").groupBy("kind", "shape").agg((F.count("*") > F.lit(CROWDED) * F.first("room")).alias("crowded")).where("crowded")
    settled = written(settled.join(crowded, ["kind", "shape"], "left").select("kind", "canonical", "attempt", "surrogate", F.coalesce("crowded", F.lit(False)).alias("crowded")), "settled")
    real = entities.select(family(F.col("kind")).alias("family"), F.col("canonical").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    moved, attempt = None, 0
    while True:
        attempt += 1
        now = settled if moved is None else settled.join(moved.select("kind", "canonical"), ["kind", "canonical"], "left_anti").unionByName(moved)
        now = now.withColumn("family", family(F.col("kind")))
        # of those that share a surrogate the crowded one stays (no two do), else the one of the least attempt
        order = F.struct((~F.col("crowded")).alias("free"), "attempt", "kind", "canonical")
        least = now.groupBy("family", "surrogate").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1")
        bad = now.join(least, ["family", "surrogate"], "left").join(real, ["family", "surrogate"], "left").where(~F.col("crowded") & (F.col("real").isNotNull() | (F.col("n").isNotNull() & (order != F.col("least")))))
        bad = durable(bad.select("kind", "canonical"))
        if bad.isEmpty():
            break
        again = bad.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", draw("kind", "canonical", "attempt")).withColumn("crowded", F.lit(False))
        moved = durable(again if moved is None else moved.join(bad, ["kind", "canonical"], "left_anti").unionByName(again))
    return (moved if moved is not None else settled.limit(0)).select("kind", "canonical", "attempt")


def _replace(key: bytes, shared: dict[tuple[str, str], int], row: str | None = None, redraw: str | None = None):
    def run(batches):
        keyed = Keyed(key)
        for b in batches:
            own = b.column(redraw).to_pylist() if redraw else None
            texts, spans = [], []
            for i, t in enumerate(text_bytes(b.column("text"))):
                if t is None:
                    texts.append(None)
                    spans.append([])
                    continue
                text = t.decode("utf-8", "replace")
                redrawn = shared if own is None else {(x["kind"], x["canonical"]): x["attempt"] for x in own[i] or []}
                out, at, made, found = [], 0, 0, []
                for a, e, kind, canonical in find(text):
                    new = render(kind, keyed.draw(kind, canonical, redrawn.get((kind, canonical), 0)), text[a:e])
                    out += [text[at:a], new]
                    made += a - at
                    found.append({"from": made, "to": made + len(new), "kind": kind.split("-")[0]})
                    made += len(new)
                    at = e
                out.append(text[at:])
                texts.append("".join(out))
                spans.append(found)
            names = [c for c in b.schema.names if c not in ("text", row, redraw)]
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string()), pa.array(spans, kind)], [*names, "text", "spans"])

    return run


def _kinds(batches):
    for b in batches:
        rows = [(r, k, c) for r, t in zip(b.column("__rid").to_pylist(), text_bytes(b.column("text"))) if t for _, _, k, c in find(t.decode("utf-8", "replace"))]
        rows = list(dict.fromkeys(rows))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["__rid", "kind", "canonical"])


def pseudonymize(documents: DataFrame, key: bytes, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents(doc_id, text, ...) with surrogates in text, and spans array<struct<from,to,kind>> (characters of the new text).

    All other columns are handed through, whatever their names (but ``spans``, which is replaced).  A null text
    stays null, a text without entities stays as it is; equal entities get equal surrogates in all rows,
    repeated rows stay equal; no rows give no rows.
    """
    docs = documents.drop("spans")
    again = redraws(docs, key)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), *T._parse_datatype_string("spans array<struct<from:bigint,to:bigint,kind:string>>").fields])
    order = [*docs.columns, "spans"]
    held = again.agg(F.coalesce(F.sum(F.octet_length("kind") + F.octet_length("canonical") + 8), F.lit(0))).first()[0]
    if held <= broadcast_bytes:
        shared = {(r["kind"], r["canonical"]): r["attempt"] for r in again.collect()}  # checked
        return docs.mapInArrow(_replace(key, shared), schema).select(*order)
    row, redraw = fresh(docs, "__row"), fresh(docs, "__redrawn")
    keyed = written(with_row_key(docs, row), "keyed")
    found = keyed.select(F.col(row).alias("__rid"), "text").mapInArrow(_kinds, "__rid long, kind string, canonical string").join(again, ["kind", "canonical"])
    found = found.groupBy("__rid").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(redraw)).withColumnRenamed("__rid", row)
    return keyed.join(found, row, "left").mapInArrow(_replace(key, {}, row, redraw), schema).select(*order)
