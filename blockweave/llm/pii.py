"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation.

Validated numbers and dates are permuted among all values of their own format,
so a pseudonym is again a valid value of the format and equal values stay
linked across documents without any table: card numbers keep their length and
a right check digit, phone numbers and addresses their separators, dates stay
real dates in the same notation. Mail addresses keep their domain, and letters
stay letters and digits digits in their local part. Different values of a
format never share a pseudonym. Values that are equal in another notation stay
linked: phone numbers whatever their separators, mail addresses whatever their
case, dates with the year first and with dots. Dates with slashes may be meant
in two ways, so their notation is permuted on its own.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import math
import re
from hashlib import blake2b

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_batches

MAIL = r"(?P<mail>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,200}\.[A-Za-z]{2,24}(?![A-Za-z0-9]))"
DATE = r"(?P<date>(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d-]|\.\d))"
ADDRESS = r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
PHONE = r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
SSN = r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
CARD = r"(?P<card>(?<![\d.-])(?:\d[ -]?){12,18}\d(?![\d-]))"
FIND = re.compile("|".join((MAIL, DATE, ADDRESS, SSN, PHONE, CARD)))
KINDS = ("mail", "date", "ip", "phone", "ssn", "card")
#: The patterns one by one, in the order in which they are tried at a place.
EACH = tuple((p[4 : p.index(">")], re.compile(p)) for p in (MAIL, DATE, ADDRESS, SSN, PHONE, CARD))
#: Cards as they are usually written: in one run, by fours, or 4-6-4 and 4-6-5.
USUAL = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}")
#: Every match holds two digits in a row, or a mail sign.
HINT = r"[0-9][0-9 ().-]*[0-9]|@"


class Feistel:
    """A keyed permutation of 0 .. n-1 by an unbalanced Feistel network with cycle walking."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    def _round(self, r: int, label: bytes, value: int, size: int) -> int:
        digest = blake2b(b"%d|%s|%d" % (r, label, value), key=self.key, digest_size=64).digest()
        return int.from_bytes(digest, "big") % size

    def permute(self, x: int, n: int, label: str) -> int:
        """x's image among n values; each label has its own permutation."""
        if n <= 1:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        name = f"{label}|{n}".encode()
        while True:
            left, right = divmod(x, b)
            for r in range(0, self.rounds, 2):
                left = (left + self._round(r, name, right, a)) % a
                right = (right + self._round(r + 1, name, left, b)) % b
            x = left * b + right
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a right check digit."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


FIRST, LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
#: Notations of dates that name one day each.
NOTATIONS = (("-", "%Y-%m-%d"), (".", "%d.%m.%Y"))
#: The calling codes of one and of two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


@functools.lru_cache(maxsize=2)
def slashed(leap: bool) -> tuple[tuple[int, int], ...]:
    """The pairs a/b of a year that are a day in one of the two orders, sorted."""
    days = [(datetime.date(2000 if leap else 2001, 1, 1) + datetime.timedelta(k)) for k in range(365 + leap)]
    return tuple(sorted({(d.month, d.day) for d in days} | {(d.day, d.month) for d in days}))


def slash_rank(first: int, second: int, year: int) -> tuple[int | None, int]:
    """The place of first/second/year among all such strings of the years, None if it is none, and how many there are."""
    place = total = None
    total = 0
    for y in range(FIRST.year, LAST.year + 1):
        pairs = slashed(calendar.isleap(y))
        if y == year:
            k = bisect.bisect_left(pairs, (first, second))
            place = total + k if k < len(pairs) and pairs[k] == (first, second) else None
        total += len(pairs)
    return place, total


def slash_at(place: int) -> str:
    for y in range(FIRST.year, LAST.year + 1):
        pairs = slashed(calendar.isleap(y))
        if place < len(pairs):
            return f"{pairs[place][0]:02d}/{pairs[place][1]:02d}/{y}"
        place -= len(pairs)
    raise ValueError(place)


def fill(template: str, digits: str) -> str:
    """The template with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in template)


class Pseudonyms:
    def __init__(self, key: bytes, memo_limit: int = 200_000):
        self.feistel, self.key = Feistel(key), key
        self.of = functools.lru_cache(memo_limit)(self._of)

    def number(self, digits: str, label: str) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), label)).zfill(len(digits))

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None if it is not a valid one."""
        return getattr(self, f"_{kind}")(text)

    def _mail(self, text: str) -> str:
        """Letters among letters and digits among digits, for each domain and form; case is folded."""
        local, _, domain = text.lower().rpartition("@")
        value, n = 0, 1
        for c in local:
            if c.isalnum():
                size, first = (10, "0") if c.isdigit() else (26, "a")
                value, n = value * size + ord(c) - ord(first), n * size
        form = re.sub("[0-9]", "9", re.sub("[a-z]", "a", local))
        value, out = self.feistel.permute(value, n, f"mail|{domain}|{form}"), []
        for c in reversed(form):
            if c in "a9":
                value, k = divmod(value, 26 if c == "a" else 10)
                c = chr(ord("a" if c == "a" else "0") + k)
            out.append(c)
        return f"{''.join(reversed(out))}@{domain}"

    def _date(self, text: str) -> str | None:
        if "/" in text:
            place, n = slash_rank(*map(int, text.split("/")))
            return None if place is None else slash_at(self.feistel.permute(place, n, "date/"))
        for mark, notation in NOTATIONS:
            if mark in text:
                try:
                    day = datetime.datetime.strptime(text, notation).date()
                except ValueError:
                    continue
                if FIRST <= day <= LAST:
                    n = (LAST - FIRST).days + 1
                    return (FIRST + datetime.timedelta(self.feistel.permute((day - FIRST).days, n, "date"))).strftime(notation)
        return None

    def _ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.feistel.permute(x, 1 << 32, "ip").to_bytes(4, "big")))

    def _phone(self, text: str) -> str | None:
        """The calling code stays, and all digits after it are permuted. Without one, the notation is that of country 1."""
        digits = re.sub(r"\D", "", text)
        if not 7 <= len(digits) <= 15:
            return None
        code = next((digits[:k] for k in (1, 2) if digits[:k] in SHORT_CODES), digits[:3]) if text[0] == "+" else ""
        # a trunk zero in brackets is no part of the number
        trunk = "0" if code and re.match(rf"\+{code}[ .-]?\(0\)", text) else ""
        rest = digits[len(code + trunk) :]
        return fill(text, code + trunk + self.number(rest, f"phone{code or 1}"))

    def _ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = self.feistel.permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        return f"{areas[x // (99 * 9999)]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"

    def _card(self, text: str) -> str | None:
        """All digits but the check digit are permuted; the check digit is made right again. Wrong ones are no card numbers."""
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn(digits) % 10:
            return None
        body = self.number(digits[:-1], "card")
        return fill(text, body + str(-luhn(body + "0") % 10))

    def _phone_ends(self, text: str, start: int, end: int) -> list[int]:
        """Ends of the readings of a phone number, the best first.

        Digits that begin a valid value of another kind, or another phone, are
        not taken. Numbers of country 1 have eleven digits; otherwise the
        longest reading that does not end inside a token goes first.
        """
        pattern = dict(EACH)["phone"]
        ends = [e for e in range(end, start, -1) if text[e - 1].isdigit() and not text[e : e + 1].isdigit() and pattern.fullmatch(text, start, e) and 7 <= sum(map(str.isdigit, text[start:e])) <= 15]
        for q in sorted(e + 1 for e in ends if e < end):
            if self._value_at(text, q):
                ends = [e for e in ends if e < q]
                break
        eleven = re.match(r"\+1(?!\d)", text[start:end]) is not None

        def order(e: int):
            return (eleven and sum(map(str.isdigit, text[start:e])) != 11, re.match(r"[./:-]\d", text[e : e + 2]) is not None, -e)

        return sorted(ends, key=order)

    def _value_at(self, text: str, at: int) -> bool:
        for kind, pattern in EACH:
            m = pattern.match(text, at)
            if m and (any(USUAL.fullmatch(text, at, e) and self.of(kind, text[at:e]) for e in self._card_cuts(text, at, m.end())) if kind == "card" else self.of(kind, m[0])):
                return True
        return False

    def _card_cuts(self, text: str, start: int, end: int) -> list[int]:
        return [e for e in range(end, start + 12, -1) if text[e - 1].isdigit() and not (text[e : e + 1].isdigit() or text[e : e + 1] == "-")]

    def _card_ends(self, text: str, start: int, end: int, again: bool) -> list[int]:
        """Ends of the readings of a card number, the best first.

        Usual notations go before the whole match, and one that begins inside
        the match goes before any other reading at this place. Shorter readings,
        and any reading inside a match that failed (again), need groups of three
        digits or more: among lists of small numbers some always pass the check.
        """
        cuts = self._card_cuts(text, start, end)
        usual = [e for e in cuts if USUAL.fullmatch(text, start, e)]
        for q in range(start + 1, end):
            m = EACH[-1][1].match(text, q)
            if m and not any(self.of("card", text[start:e]) for e in usual) and any(USUAL.fullmatch(text, q, e) and self.of("card", text[q:e]) for e in self._card_cuts(text, q, m.end())):
                return []
        wide = [e for e in cuts if e not in usual and all(len(g) >= 3 for g in re.split("[ -]", text[start:e]))]
        return usual + ([] if again else [end]) + wide

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind.

        Where no reading of a match passes its check, other kinds are tried at
        that place, and then the search goes on at the next character.
        """
        counts = dict.fromkeys(KINDS, 0)
        out, kept, at, failed = [], 0, 0, 0
        while m := FIND.search(text, at):
            start, done = m.start(), False
            for kind, pattern in EACH:
                one = m if kind == m.lastgroup else pattern.match(text, start)
                if not one:
                    continue
                end = one.end()
                ends = self._phone_ends(text, start, end) if kind == "phone" else self._card_ends(text, start, end, start < failed) if kind == "card" else [end]
                for e in ends:
                    new = self.of(kind, text[start:e])
                    if new is not None:
                        out += (text[kept:start], new)
                        kept = at = e
                        counts[kind] += 1
                        done = True
                        break
                if done:
                    break
                if kind == "card":
                    failed = max(failed, end)
            if not done:
                at = start + 1
        return "".join([*out, text[kept:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, text with pseudonyms, and n_mail, n_date, n_ip, n_phone, n_ssn, n_card.

    One row for each row of docs. Null texts stay null; values that fail their
    check (check digits, ranges of dates and addresses, lengths) stay as they are;
    rows that repeat get the same pseudonyms; other columns are ignored; an
    empty table gives no rows. The key must stay secret.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("text", StringType()), *[StructField(f"n_{k}", LongType()) for k in KINDS]])

    def make():
        own, hint = Pseudonyms(key), re.compile(HINT)

        def step(batch):
            texts, counts = [], []
            for text in batch.column(1).to_pylist():
                new, n = own.replace(text) if text and hint.search(text) else (text, {})
                texts.append(new)
                counts.append(n)
            return [batch.column(0), texts, *[[n.get(k, 0) for n in counts] for k in KINDS]]

        return step

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), schema, make)
