"""Operator 7: format-preserving pseudonyms for personal data.

Values that pass the checks of their kind are permuted by a keyed Feistel network within the
values of the same format, so the result looks the same and passes the same checks. The
permutation hangs on key, kind and the value itself: a date, a telephone number with its country
code or a mail address gets the same pseudonym in every spelling, so equal values stay linked
across documents, and different values stay different.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"[^\s@<>()\[\],;:\"']+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IPV4 = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)")
CARD = re.compile(r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)")
PHONE = re.compile(r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)"
                   r"|(?<![\d+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DATE = re.compile(r"(?<!\d)(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))(?!\d)")

# The telephone country codes of two digits.
TWO_DIGIT_CODES = frozenset("""20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58
60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98""".split())


# ---- the keyed permutation ------------------------------------------------------------------

def _round(key: bytes, tweak: bytes, number: int, value: int, width: int) -> int:
    data = tweak + number.to_bytes(1, "big") + value.to_bytes(width, "big")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: bytes, allowed: Callable[[int], bool] | None = None) -> int:
    """Keyed permutation of 0..size-1, or of the allowed ones among them.

    A Feistel network over pairs (left, right) with left below a and right below b, a * b >= size;
    results out of range are permuted again until one is in range, which keeps it a permutation.
    """
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8
    while True:
        left, right = divmod(value, b)
        for number in range(0, ROUNDS, 2):
            left = (left + _round(key, tweak, number, right, width)) % a
            right = (right + _round(key, tweak, number + 1, left, width)) % b
        value = left * b + right
        if value < size and (allowed is None or allowed(value)):
            return value


def restore(value: int, size: int, key: bytes, tweak: bytes, allowed: Callable[[int], bool] | None = None) -> int:
    """Inverse of ``permute``, for holders of the key."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8
    while True:
        left, right = divmod(value, b)
        for number in range(ROUNDS - 2, -1, -2):
            right = (right - _round(key, tweak, number + 1, left, width)) % b
            left = (left - _round(key, tweak, number, right, width)) % a
        value = left * b + right
        if value < size and (allowed is None or allowed(value)):
            return value


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isascii() and c.isdigit() else c for c in shape)


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


# ---- checks ---------------------------------------------------------------------------------

def luhn_digit(body: str) -> str:
    total = 0
    for place, c in enumerate(reversed(body)):
        n = int(c) * (2 if place % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


# ---- one function per kind: the pseudonym, or None when the value fails its check ------------

def card(text: str, key: bytes, step=permute) -> str | None:
    """Numbers of 13 to 19 digits: those that pass the Luhn check keep passing it."""
    number = only_digits(text)
    if len(set(number)) < 2:
        return None
    if luhn_digit(number[:-1]) == number[-1]:
        n = len(number) - 2  # the first digit, which names the issuer, stays
        body = number[0] + f"{step(int(number[1:-1]), 10 ** n, key, b'card%d' % n):0{n}d}"
        return refill(text, body + luhn_digit(body))
    n = len(number) - 1
    failing = lambda v: luhn_digit((number[0] + f"{v:0{n}d}")[:-1]) != f"{v:0{n}d}"[-1]
    return refill(text, number[0] + f"{step(int(number[1:]), 10 ** n, key, b'number%d' % n, failing):0{n}d}")


def country_digits(number: str) -> int:
    """Length of the country code at the head of an international number; the rest of the codes have three digits."""
    return 1 if number[0] in "17" else 2 if number[:2] in TWO_DIGIT_CODES else 3


def phone(text: str, key: bytes, step=permute) -> str | None:
    """The country code stays, all other digits are permuted together, however they are grouped."""
    number = only_digits(text)
    if not 7 <= len(number) <= 15:
        return None
    lead = country_digits(number) if text.startswith("+") else 0
    n = len(number) - lead
    return refill(text, number[:lead] + f"{step(int(number[lead:]), 10 ** n, key, b'phone%d' % n):0{n}d}")


def ssn(text: str, key: bytes, step=permute) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    def good(v: int) -> bool:
        area, rest = divmod(v, 10 ** 6)
        return 0 < area < 900 and area != 666 and rest // 10 ** 4 > 0 and rest % 10 ** 4 > 0

    value = int(only_digits(text))
    return refill(text, f"{step(value, 10 ** 9, key, b'ssn', good):09d}") if good(value) else None


def ipv4(text: str, key: bytes, step=permute) -> str | None:
    """Four numbers up to 255; special addresses (private, loopback, multicast) stay special ones."""
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None

    def special(v: int) -> bool:
        first, second = v >> 24, v >> 16 & 255
        return (first in (0, 10, 127) or first >= 224 or (first, second) == (192, 168)
                or (first, second) == (169, 254) or (first == 172 and 16 <= second < 32))

    value = int.from_bytes(bytes(parts), "big")
    own = special(value)
    return ".".join(map(str, step(value, 1 << 32, key, b"ipv4", lambda v: special(v) == own).to_bytes(4, "big")))


def iban(text: str, key: bytes, step=permute) -> str | None:
    """Country and kinds of characters stay, the check digits fit the new account."""
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_digits(country, account) != check:
        return None
    shape = "".join("0" if c.isdigit() else "A" for c in account)
    changed = mixed(account, key, b"iban" + shape.encode(), step)
    rest = iter(country + iban_digits(country, changed) + changed)
    return "".join(" " if c == " " else next(rest) for c in text)


def mixed(text: str, key: bytes, tweak: bytes, step=permute) -> str:
    """Permutes digits, small and capital letters (each among its like) of a text together."""
    bases = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in text]
    size = math.prod(bases)
    value = 0
    for c, base in zip(text, bases):
        value = value * base + (int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0)
    value, out = step(value, size, key, tweak), []
    for c, base in zip(reversed(text), reversed(bases)):
        value, n = divmod(value, base)
        out.append(str(n) if base == 10 else chr(n + (97 if c.islower() else 65)) if base == 26 else c)
    return "".join(reversed(out))


def email(text: str, key: bytes, step=permute) -> str | None:
    """The part before the @ is permuted, letter for letter and digit for digit, in any case; the domain stays."""
    local, _, domain = text.rpartition("@")
    shape = re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "0", local))
    changed = mixed(local, key, b"email" + shape.encode(), step)
    return None if changed == local and not re.search(r"[A-Za-z0-9]", local) else f"{changed}@{domain}"


def date(text: str, key: bytes, step=permute) -> str | None:
    """Days of 1900 to 2099: the day is permuted, the same however it is written, and written in the form
    found. Day and month first are told apart by the day."""
    m = DATE.fullmatch(text)
    if m.group(1):
        order, parts, sep = "ymd", (m.group(1), m.group(3), m.group(4)), m.group(2)
    else:
        order = "dmy" if m.group(6) != "/" or int(m.group(5)) > 12 else "mdy"
        parts, sep = (m.group(5), m.group(7), m.group(8)), m.group(6)
    named = dict(zip(order, map(int, parts)))
    padded = all(len(p) in (2, 4) for p in parts)
    try:
        day = dt.date(named["y"], named["m"], named["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None

    def kind(v: int) -> tuple[bool, bool]:
        """What decides how a written date is read: a part of one digit, a day that is no month."""
        d = dt.date.fromordinal(v + FIRST_DAY)
        return d.day < 10 or d.month < 10, d.day > 12

    own = kind(day - FIRST_DAY)
    moved = dt.date.fromordinal(FIRST_DAY + step(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date", lambda v: kind(v) == own))
    width = 2 if padded else 1
    shown = {"y": f"{moved.year:04d}", "m": f"{moved.month:0{width}d}", "d": f"{moved.day:0{width}d}"}
    return sep.join(shown[c] for c in order)


#: Kinds in the order in which they claim a span.
KINDS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", EMAIL, email), ("iban", IBAN, iban), ("ssn", SSN, ssn), ("date", DATE, date),
    ("ipv4", IPV4, ipv4), ("phone", PHONE, phone), ("card", CARD, card))


def pseudonymize(text: str | None, key: bytes, step=permute) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms, and what was replaced: kind, start and end (in the old text),
    and the pseudonym. Spans don't overlap; an earlier kind goes first."""
    if not isinstance(text, str):
        return None, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    has_digit = re.search(r"[0-9]", text) is not None
    for kind, pattern, change in KINDS:
        if kind == "email" and "@" not in text or kind != "email" and not has_digit:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if any(taken[s:e]):
                continue
            if (new := change(m.group(), key, step)) is not None:
                found.append((s, e, kind, new))
                taken[s:e] = b"\1" * (e - s)
    found.sort()
    out, at = [], 0
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:], [{"kind": k, "start": s, "end": e, "pseudonym": p} for s, e, k, p in found]


def pseudonymize_documents(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, found`` for every row of ``df``; ``found`` lists kind, start, end, pseudonym.

    Kinds: e-mail addresses, IBANs, US social security numbers, dates, IPv4 addresses,
    phone numbers, and card numbers (13 to 19 digits; those that pass the Luhn check still do).
    Values that fail the checks of a kind are left to the next one. NULL and empty texts come
    back as they are; repeated rows each get the same pseudonyms; further columns are ignored.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [pseudonymize(t, secret) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [t for t, _ in done], "found": [f for _, f in done]})

    base = df.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")
    kind = dict(base.dtypes)["doc_id"]
    return base.mapInPandas(run, f"doc_id {kind}, text string, found array<struct<kind:string,start:long,end:long,pseudonym:string>>")
