"""Pseudonyms that keep the format: validated numbers, dates and addresses, permuted under a key.

A value is read as a number in the range of all values of its format, the number is permuted by a
Feistel network keyed for that format (a result outside the range is permuted again until it falls
inside), and the result is written back in the same format. Equal values get equal pseudonyms in
all documents and different values different ones, and the key's holder can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")

# A value stands free of further digits and letters. The order of the kinds decides where two could begin.
_FORMS = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]*",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w/-]|\.[0-9])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<!\w)\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|[.-][0-9])",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in _FORMS.items()).replace(r"\1", "(?P=d1)").replace(r"\2", "(?P=d2)").replace(
    "[0-9]{4}([-/.])", "[0-9]{4}(?P<d1>[-/.])").replace("[0-9]{1,2}([-/.])", "[0-9]{1,2}(?P<d2>[-/.])"))
_EACH = {kind: re.compile(form) for kind, form in _FORMS.items()}
#: Where a value of groups may end before others that were read with it.
_BORDERS = {"card": " -", "iban": " ", "phone": " .-"}
# Lengths of the IBANs of a country, as registered with SWIFT.
_IBAN_LENGTHS = {country: int(n) for n, countries in (
    ("15", "NO"), ("16", "BE"), ("18", "DK FI FK FO GL NL SD"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU MN XK"), ("21", "CH HR LI LV"),
    ("22", "BG BH CR DE GB GE IE ME RS VA"), ("23", "AE GI IL IQ OM SO TL"), ("24", "AD CZ DZ ES MD PK RO SA SE SK TN VG"),
    ("25", "LY PT ST"), ("26", "IS TR"), ("27", "BI DJ FR GR IT MC MR SM"), ("28", "AL AZ BY CY DO GT HN HU LB NI PL SV"),
    ("29", "BR EG PS QA UA"), ("30", "JO KW MU YE"), ("31", "MT SC"), ("32", "LC"), ("33", "RU"),
) for country in countries.split()}
#: No value is without an at sign or two digits in a row or beside a mark.
_HINT = r"@|[0-9][0-9./\-]"

#: First years of the spans of time within which dates are permuted.
_YEARS = (1000, 1900, 2100, 10_000)
_SPANS = [(datetime.date(a, 1, 1).toordinal(), datetime.date(b - 1, 12, 31).toordinal()) for a, b in zip(_YEARS[:-1], _YEARS[1:], strict=True)]


def permute(number: int, size: int, key: bytes, format_: str, back: bool = False) -> int:
    """The number's place in a keyed permutation of 0 to size - 1; ``back`` inverts it."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width, person = (1 << half) - 1, (half + 7) // 8, hashlib.blake2b(format_.encode(), digest_size=16).digest()

    def mixed(turn: int, value: int) -> int:
        data = bytes([turn]) + value.to_bytes(width, "big")
        if width <= 64:
            out = hashlib.blake2b(data, digest_size=width, key=key, person=person).digest()
        else:
            out = hashlib.shake_256(hashlib.blake2b(data, key=key, person=person).digest()).digest(width)
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = number >> half, number & mask
        for turn in range(ROUNDS):
            if back:
                left, right = right ^ mixed(ROUNDS - 1 - turn, left), left
            else:
                left, right = right, left ^ mixed(turn, right)
        number = left << half | right
        if number < size:
            return number


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _fill(shape: str, signs: str, is_sign: Callable[[str], bool]) -> str:
    """``shape`` with its signs, in order, replaced by those given."""
    new = iter(signs)
    return "".join(next(new) if is_sign(c) else c for c in shape)


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _by_class(text: str, move: Callable[[int, int], int], fixed: int = 0) -> str:
    """ASCII letters and digits of the text permuted together, each within its class."""
    ranges = [("0", 10) if _digit(c) else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else None for c in text]
    ranges[:fixed] = [None] * fixed
    number, size = 0, 1
    for c, r in zip(text, ranges, strict=True):
        if r:
            number, size = number * r[1] + ord(c) - ord(r[0]), size * r[1]
    if size == 1:
        return text
    number, out = move(number, size), []
    for c, r in zip(reversed(text), reversed(ranges), strict=True):
        if r:
            number, at = divmod(number, r[1])
            c = chr(ord(r[0]) + at)
        out.append(c)
    return "".join(reversed(out))


def _card(text: str, move) -> str | None:
    digits = "".join(filter(_digit, text))
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = str(move(int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    check = next(c for c in "0123456789" if luhn(body + c))
    return _fill(text, body + check, _digit)


def _iban(text: str, move) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _by_class(plain, move, 4)
    check = 98 - _iban_rest(body[:2] + "00" + body[4:])
    return _fill(text, f"{body[:2]}{check:02d}{body[4:]}", lambda c: c != " ")


def _ssn(text: str, move) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    at = move(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    at, serial = divmod(at, 9999)
    area, group = divmod(at, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, move) -> str | None:
    """All digits but the country's are permuted; written together, the first stands for the country."""
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|", text).end()
    digits = "".join(filter(_digit, text[country:]))
    if not 7 <= len(digits) <= 14:
        return None
    return text[:country] + _fill(text[country:], str(move(int(digits), 10 ** len(digits))).zfill(len(digits)), _digit)


def _ip(text: str, move) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    return ".".join(str(b) for b in move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32).to_bytes(4, "big"))


def _date(text: str, move) -> str | None:
    """Year first, or last after month and day; day and month if the first can't be a month."""
    sign = next(c for c in text if not _digit(c))
    parts = text.split(sign)
    wide = all(len(p) > 1 for p in parts)
    fields = [int(p) for p in parts]
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0) if fields[0] > 12 else (2, 0, 1)
    try:
        day = datetime.date(*(fields[i] for i in order))
    except ValueError:
        return None
    if day.year < _YEARS[0]:
        return None
    first, last = next(span for span in _SPANS if day.toordinal() <= span[1])
    size, at = last - first + 1, day.toordinal() - first
    while True:  # stay among the dates that are written and read in this form
        at = move(at, size)
        new = datetime.date.fromordinal(at + first)
        if order == (2, 1, 0) and new.day <= 12:
            continue
        if not wide and (new.month > 9) + (new.day > 9) * 2 != (day.month > 9 or len(parts[order[1]]) > 1) + (day.day > 9 or len(parts[order[2]]) > 1) * 2:
            continue
        if not wide and any(len(parts[order[i]]) > 1 and parts[order[i]][0] == "0" for i in (1, 2)):
            return None
        break
    texts = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}" if wide else str(new.month), order[2]: f"{new.day:02d}" if wide else str(new.day)}
    return sign.join(texts[i] for i in range(3))


def _email(text: str, move) -> str | None:
    """Letters and digits before the at sign; the domain stays."""
    name, _, domain = text.partition("@")
    return f"{_by_class(name, move)}@{domain}"


_MAKE = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email}


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym (or, back, the value of a pseudonym); None if it isn't valid."""
    return _MAKE[kind](text, lambda n, size: permute(n, size, key, f"{kind} {size}", back))


def _tries(kind: str, text: str) -> Iterator[str]:
    """The text and what of it ends on a border of its groups, the longest first; of an IBAN before
    all others what has the length of its country."""
    borders = [i for i, c in enumerate(text) if c in _BORDERS.get(kind, "")]
    ends = [len(text), *reversed(borders)]
    if kind == "iban":
        ends.sort(key=lambda end: len(text[:end].replace(" ", "")) != _IBAN_LENGTHS.get(text[:2]))
    return (text[:end] for end in ends)


def pseudonymiser(key: bytes) -> Callable[[str], tuple[str, list[str]]]:
    """A function from a text to the text with pseudonyms and the kinds it replaced.

    Where a value could begin, every kind is tried in turn and each from the longest text down to
    shorter ones; where none is valid, the next place where one could begin is looked for.
    """
    known = lru_cache(1 << 16)(lambda kind, value: pseudonym(kind, value, key))

    def first(text: str, at: int) -> tuple[str, str, str] | None:
        for kind, form in _EACH.items():
            found = form.match(text, at)
            for value in _tries(kind, found[0]) if found else ():
                new = known(kind, value)
                if new is not None:
                    return kind, value, new
        return None

    def run(text: str) -> tuple[str, list[str]]:
        kinds: list[str] = []
        parts: list[str] = []
        done = at = 0
        while found := _ANY.search(text, at):
            at = found.start()
            valid = first(text, at)
            if valid is None:
                at += 1
                continue
            kind, value, new = valid
            kinds.append(kind)
            parts += [text[done:at], new]
            done = at = at + len(value)
        return "".join([*parts, text[done:]]), kinds

    return run


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii``: how many values of each kind there were.

    Values are e-mail names, IBANs (checked modulo 97), calendar dates, IPv4 addresses, social
    security numbers, telephone numbers and card numbers (Luhn); what looks like one but isn't
    valid stays. Null and empty texts stay as they are with zero counts, and so do all other
    columns; a column ``pii`` is replaced.
    """
    counts = pa.struct([(k, pa.int32()) for k in KINDS])
    kind = pa.struct([("text", pa.string()), ("pii", counts)])

    @F.arrow_udf("text string, pii struct<" + ",".join(f"{k}:int" for k in KINDS) + ">")
    def replaced(column: pa.Array) -> pa.Array:
        run, none = pseudonymiser(key), {k: 0 for k in KINDS}
        hints = pc.fill_null(pc.match_substring_regex(column, _HINT), False).to_pylist()
        out = []
        for value, hint in zip(column.to_pylist(), hints, strict=True):
            found: list[str] = []
            if hint:
                value, found = run(value)
            out.append({"text": value, "pii": {k: found.count(k) for k in KINDS} if found else none})
        return pa.array(out, kind)

    rows = docs.withColumn("pii", F.struct(replaced(F.col(text).cast("string")).alias("r")))
    return rows.withColumns({text: F.col("pii.r.text"), "pii": F.col("pii.r.pii")})
