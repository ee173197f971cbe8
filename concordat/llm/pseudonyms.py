"""PII: numbers, dates and addresses are replaced by pseudonyms of the same format, permuted by a keyed Feistel network."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from concordat.llm.common import pieces

c = F.col
ROUNDS = 10
KINDS = ("card", "iban", "ip", "date", "phone", "email")
FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
# Month names of written dates.
MONTHS = "January February March April May June July August September October November December".split()
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

PATTERN = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?![0-9]|[./-][0-9]))"
    rf"|(?P<word>(?<![0-9A-Za-z])(?:[0-9]{{1,2}} (?:{'|'.join(MONTHS)}) [0-9]{{4}}|(?:{'|'.join(MONTHS)}) [0-9]{{1,2}}, [0-9]{{4}})(?![0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-](?=[0-9]{3}[.-][0-9]{4}(?![0-9])))"
    r"[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))"
    r"|(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))",
)
_DIGIT = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. n-1 per kind. Numbers are pairs of two digits in bases a and b with a * b >= n; a
    round adds a keyed hash of one digit to the other; what falls outside goes round again until it is inside."""

    key: bytes

    @cached_property
    def _secret(self) -> bytes:
        """The whole key, whatever its length, as the 64 bytes that the hash takes."""
        return hashlib.blake2b(self.key, digest_size=64).digest()

    def _f(self, kind: str, step: int, value: int, base: int) -> int:
        h = hashlib.blake2b(f"{kind}:{step}:{value}".encode(), key=self._secret, digest_size=16).digest()
        return int.from_bytes(h, "big") % base

    def permute(self, x: int, n: int, kind: str, back: bool = False) -> int:
        a = math.isqrt(max(0, n - 1)) + 1
        b = -(-n // a)
        kind = f"{kind}/{n}"
        while True:
            p, q = divmod(x, b)
            for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if step % 2:
                    q = (q + sign * self._f(kind, step, p, b)) % b
                else:
                    p = (p + sign * self._f(kind, step, q, a)) % a
            x = p * b + q
            if x < n:
                return x


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits))) % 10 == 0


def _fill(template: str, symbols: str) -> str:
    """The template with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if x.isalnum() else x for x in template)


def _radix(symbols: str) -> tuple[int, int, list[str]]:
    """Symbols as a number over the classes (digits, small, capital letters) they have at each place."""
    sets = ["0123456789" if x.isdigit() else "abcdefghijklmnopqrstuvwxyz" if x.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for x in symbols]
    value, size = 0, 1
    for x, s in zip(symbols, sets, strict=True):
        value, size = value * len(s) + s.index(x), size * len(s)
    return value, size, sets


def _symbols(value: int, sets: list[str]) -> str:
    out = []
    for s in reversed(sets):
        value, at = divmod(value, len(s))
        out.append(s[at])
    return "".join(reversed(out))


def _mod97(text: str) -> int:
    return int("".join(str(int(x, 36)) for x in text)) % 97


def _date(text: str) -> tuple[dt.date, str] | None:
    """The date and a template with {d}, {m}, {y} (padded: {dd}, {mm}); day first where both orders are dates."""
    word = re.fullmatch(r"([0-9]{1,2}) ([A-Z][a-z]+) ([0-9]{4})", text)
    if word:
        parts, form = (word[3], str(MONTHS.index(word[2]) + 1), word[1]), ("{dd}" if word[1][0] == "0" else "{d}") + " {M} {y}"
    elif word := re.fullmatch(r"([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})", text):
        parts, form = (word[3], str(MONTHS.index(word[1]) + 1), word[2]), "{M} " + ("{dd}" if word[2][0] == "0" else "{d}") + ", {y}"
    else:
        one, sep, two, three = re.fullmatch(r"([0-9]+)([-/.])([0-9]+)[-/.]([0-9]+)", text).groups()
        pad = "dd" in _padded(one, two, three)
        day, month = ("{dd}", "{mm}") if pad else ("{d}", "{m}")
        if len(one) == 4:
            parts, form = (one, two, three), f"{{y}}{sep}{month}{sep}{day}"
        elif int(two) > 12:
            parts, form = (three, one, two), f"{month}{sep}{day}{sep}{{y}}"
        else:
            parts, form = (three, two, one), f"{day}{sep}{month}{sep}{{y}}"
    try:
        day = dt.date(*map(int, parts))
    except ValueError:
        return None
    return (day, form) if FIRST <= day.toordinal() <= LAST else None


def _padded(*parts: str) -> str:
    """"dd" unless a day or month is written with one digit."""
    return "" if any(len(x) == 1 for x in parts) else "dd"


def _written(day: dt.date, form: str) -> str:
    return form.format(d=day.day, dd=f"{day.day:02}", m=day.month, mm=f"{day.month:02}", y=day.year, M=MONTHS[day.month - 1])


def pseudonym(kind: str, text: str, feistel: Feistel, back: bool = False) -> str | None:
    """The pseudonym of a found value, or None where it isn't valid: a card without a right check digit, an IBAN
    without the right remainder, a number over 255 in an address, a day that is in no calendar."""
    if kind == "card":
        digits = re.sub(r"[ -]", "", text)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        body = f"{feistel.permute(int(digits[:-1]), 10**n, kind, back):0{n}}"
        return _fill(text, body + next(d for d in "0123456789" if luhn(body + d)))
    if kind == "iban":
        plain = text.replace(" ", "")
        if _mod97(plain[4:] + plain[:4]) != 1:
            return None
        value, size, sets = _radix(plain[4:])
        body = _symbols(feistel.permute(value, size, f"{kind}/{plain[:2]}/{''.join(s[0] for s in sets)}", back), sets)
        return _fill(text, f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02}{body}")
    if kind == "ip":
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255:
            return None
        x = feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, kind, back)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        found = _date(text)
        if not found:
            return None
        return _written(dt.date.fromordinal(FIRST + feistel.permute(found[0].toordinal() - FIRST, LAST - FIRST + 1, kind, back)), found[1])
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", text)
        country = len(m[1]) if (m := re.match(r"\+([0-9]{1,3})(?=[ .(-])", text)) else 0
        rest = digits[country:]
        if not 7 <= len(digits) <= 15 or len(rest) < 6:
            return None
        return _fill(text, digits[:country] + f"{feistel.permute(int(rest), 10 ** len(rest), f'{kind}/{digits[:country]}', back):0{len(rest)}}")
    letters = "".join(x for x in text if x.isalnum())
    if not letters:
        return None
    value, size, sets = _radix(letters)
    return _fill(text, _symbols(feistel.permute(value, size, f"email/{''.join(s[0] for s in sets)}", back), sets))


def replace(text: str | None, feistel: Feistel, back: bool = False) -> tuple[str | None, Counter]:
    """The whole text with every valid value replaced, and how many there were of each kind."""
    counts: Counter = Counter()
    if not text or not _DIGIT.search(text):
        return text, counts

    out, at = [], 0
    while m := PATTERN.search(text, at):
        kind = "date" if m["word"] or m["date"] else m.lastgroup
        found = m[0]
        value = None if kind == "iban" else _cached(kind, found, feistel, back)
        if kind == "iban":  # capital words and numbers behind it may be in the match
            for found in _iban_ends(m[0]):
                if (value := _cached(kind, found, feistel, back)) is not None:
                    break
            else:
                found = m[0]
        if value is None and kind == "phone":  # digits that are no phone number may still be a card
            kind, value = "card", _cached("card", m[0], feistel, back) if re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", m[0]) else None
        counts[kind] += value is not None
        out += [text[at : m.start()], found if value is None else value]
        at = m.start() + len(found)
    return "".join([*out, text[at:]]), counts


def _iban_ends(text: str) -> list[str]:
    """What of a match may be the IBAN: up to the end of any word, the length of its country first, then the longest."""
    ends = [m.start() for m in re.finditer(r" |$", text)]
    heads = [text[:e] for e in reversed(ends) if len(text[:e].replace(" ", "")) >= 12]
    return sorted(heads, key=lambda x: len(x.replace(" ", "")) != IBAN_LENGTHS.get(text[:2]))


@lru_cache(100_000)
def _cached(kind: str, text: str, feistel: Feistel, back: bool) -> str | None:
    return pseudonym(kind, text, feistel, back)


RESULT = "struct<text:string," + ",".join(f"n_{k}:bigint" for k in KINDS) + ">"
ARROW = pa.struct([("text", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS)])


def annotate(docs: DataFrame, key: str, out: str = "pseudonymised", back: bool = False) -> DataFrame:
    """Documents with a struct ``out``: the text with pseudonyms, and the number of values of each kind.

    Equal values of a kind have equal pseudonyms in every document, different ones have different ones, and the key
    turns them back (``back``; not a month-first date whose pseudonym reads day first). Card numbers keep their length and spacing and get a right check digit, as IBANs do;
    dates from 1900 to 2099 stay dates in the way they were written and mean the same day in each; phone numbers
    keep the country code, e-mail addresses the domain. An IBAN ends where the length of its country does or else with the
    last word of the match that makes it valid; what follows is read on its own. What isn't valid stays. Null stays null, empty stays empty.
    Works inside the row on whole texts; other columns pass through unread."""

    @arrow_udf(RESULT)
    def replaced(text: pa.Array) -> pa.Array:
        feistel = Feistel(key.encode())
        rows = []
        for run in pieces(text):
            for value in run:
                new, counts = replace(value, feistel, back)
                rows.append({"text": new, **{f"n_{k}": counts[k] for k in KINDS}})
        return pa.array(rows, ARROW)

    return docs.withColumn(out, replaced(c("text").cast("string")))


def report(docs: DataFrame, key: str = "a key of the data owner") -> DataFrame:
    """One row per document: doc_id, the counts by kind and the text with pseudonyms."""
    done = annotate(docs.select("doc_id", "text"), key, "__p")
    return done.select("doc_id", *(c(f"__p.n_{k}") for k in KINDS), c("__p.text"))
