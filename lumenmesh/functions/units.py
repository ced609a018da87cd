"""A grammar for numbers with unit expressions, in texts of any kind.

    quantity   = number [unit]
    number     = digits, plain or in groups of three, [decimals] [exponent]
    unit       = factor { ("/" | "per" | "a" | "each" | "every" | "*" | "·" | " ") factor }
    factor     = [prefix] symbol [["^"] exponent]

A unit is a vector of exponents over base dimensions, with a scale and an offset to the canonical unit of
that vector: canonical = value * scale + offset. All arithmetic is in exact fractions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from fractions import Fraction
from functools import lru_cache, wraps

#: Base dimensions, in the order of the exponent vectors. Canonical units: bit, second, metre, kilogram, kelvin.
DIMENSIONS = ("data", "time", "length", "mass", "temperature")

#: Prefixes (fixed values). Symbols may come in either case where a unit says so; words always may.
PREFIX_SYMBOLS = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6}
PREFIX_WORDS = {"kilo": 1, "mega": 2, "giga": 3, "tera": 4, "peta": 5, "exa": 6}
BINARY_WORDS = {"kibi": 1, "mebi": 2, "gibi": 3, "tebi": 4, "pebi": 5, "exbi": 6}
SI_SYMBOLS = {"n": -9, "u": -6, "µ": -6, "μ": -6, "m": -3, "c": -2, "d": -1, "k": 3, "M": 6, "G": 9}

_D, _T, _L, _M, _K = (tuple(int(i == j) for j in range(5)) for i in range(5))
#: Unit words and symbols (fixed values): dimension, scale, offset to the canonical unit.
UNITS = {
    "bit": (_D, Fraction(1), Fraction(0)),
    "byte": (_D, Fraction(8), Fraction(0)),
    "s": (_T, Fraction(1), Fraction(0)),
    "sec": (_T, Fraction(1), Fraction(0)),
    "second": (_T, Fraction(1), Fraction(0)),
    "min": (_T, Fraction(60), Fraction(0)),
    "minute": (_T, Fraction(60), Fraction(0)),
    "h": (_T, Fraction(3600), Fraction(0)),
    "hour": (_T, Fraction(3600), Fraction(0)),
    "m": (_L, Fraction(1), Fraction(0)),
    "metre": (_L, Fraction(1), Fraction(0)),
    "meter": (_L, Fraction(1), Fraction(0)),
    "ft": (_L, Fraction(3048, 10000), Fraction(0)),
    "mi": (_L, Fraction(1609344, 1000), Fraction(0)),
    "g": (_M, Fraction(1, 1000), Fraction(0)),
    "gram": (_M, Fraction(1, 1000), Fraction(0)),
    "K": (_K, Fraction(1), Fraction(0)),
    "kelvin": (_K, Fraction(1), Fraction(0)),
    "°C": (_K, Fraction(1), Fraction(27315, 100)),
    "celsius": (_K, Fraction(1), Fraction(27315, 100)),
    "°F": (_K, Fraction(5, 9), Fraction(45967, 180)),
    "fahrenheit": (_K, Fraction(5, 9), Fraction(45967, 180)),
}
RATE = (1, -1, 0, 0, 0)

_TOKEN = re.compile(r"\s*(?:(?P<word>[^\W\d_]+|°[CF])|(?P<num>[-+]?\d+)|(?P<op>[/*·^]))")
#: Signs between groups of three digits besides comma and full stop (fixed values): spaces and apostrophes.
_GAPS = " \u00a0\u2007\u2009\u202f'\u2019_"
#: In this order: groups by a space or apostrophe, by commas, by full stops before a decimal comma or more than once; plain.
_NUMBER = re.compile(
    rf"[-+]?(?:(?P<gap>\d{{1,3}}(?:(?P<sign>[{_GAPS}])\d{{3}})(?:(?P=sign)\d{{3}})*(?!\d)(?:[.,]\d+)?)|(?P<comma>\d{{1,3}}(?:,\d{{3}})+(?![\d,])(?:\.\d+)?)"
    r"|(?P<stop>\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}(?![\d.]))|(?P<plain>\d+(?:[.,]\d+|\.)?|[.,]\d+))(?:[eE](?P<exp>[-+]?\d+))?"
)
#: Words for "per", and what stands for a missing unit (fixed values).
PER = ("per", "a", "each", "every")
ABSENT = ("n/a", "na", "null", "none", "nan")
#: Texts up to this length have their reading kept for the next row that has them.
KEPT = 200


@dataclass(frozen=True)
class Unit:
    dims: tuple[int, ...]
    scale: Fraction
    offset: Fraction = Fraction(0)

    def times(self, other: Unit, power: int) -> Unit:
        return Unit(tuple(a + b * power for a, b in zip(self.dims, other.dims)), self.scale * other.scale**power)


NONE = Unit((0,) * 5, Fraction(1))


def _data_symbol(word: str) -> Unit | None:
    """b, B and what is written with a prefix: the case of the prefix tells nothing, that of the B does."""
    m = re.fullmatch(r"([kKmMgGtTpPeE])?(i)?([bB])", word)
    if not m or (m[2] and not m[1]):
        return None
    power = PREFIX_SYMBOLS[m[1].lower()] if m[1] else 0
    return Unit(_D, (Fraction(1024) if m[2] else Fraction(1000)) ** power * (8 if m[3] == "B" else 1))


def _symbol(word: str) -> Unit | None:
    """One factor without exponent; None if the word is no unit. No unit has a name of more than 24 letters."""
    return _known_symbol(word) if len(word) <= 24 else None


@lru_cache(maxsize=4096)
def _known_symbol(word: str) -> Unit | None:
    if (u := _data_symbol(word)) is not None:
        return u
    low = word.lower()
    m = re.fullmatch(r"(kilo|mega|giga|tera|peta|exa|kibi|mebi|gibi|tebi|pebi|exbi|[kmgtpe]i?)?(bit|byte)s?", low)
    if m:
        p = m[1] or ""
        base = Fraction(1024) if p in BINARY_WORDS or p[1:] == "i" else Fraction(1000)
        power = PREFIX_WORDS.get(p) or BINARY_WORDS.get(p) or PREFIX_SYMBOLS.get(p[:1], 0)
        return Unit(_D, base**power * UNITS[m[2]][1])
    for name in (word, low, low[:-1] if low.endswith("s") and len(low) > 2 else low):
        if name in UNITS:
            return Unit(*UNITS[name])
    for p, e in SI_SYMBOLS.items():
        if word.startswith(p) and word[len(p) :] in ("s", "m", "g", "K"):
            return Unit(UNITS[word[len(p) :]][0], UNITS[word[len(p) :]][1] * Fraction(10) ** e)
    if low.startswith("kilo") and low[4:].rstrip("s") in ("metre", "meter", "gram"):
        return Unit(UNITS[low[4:].rstrip("s")][0], UNITS[low[4:].rstrip("s")][1] * 1000)
    return None


def _rate_word(word: str) -> Unit | None:
    """Rates written as one word: bps, Mbps, GBps, MiBps."""
    if len(word) > 2 and word[-2:].lower() == "ps":
        head = _symbol(word[:-2])
        if head is not None and head.dims == _D:
            return head.times(Unit(_T, Fraction(1)), -1)
    return None


_EXPONENT = re.compile(r"\^?([-+]?\d+)(?![.,\d])")


def parse_unit(text: str, start: int = 0) -> Unit | None:
    """The unit that stands at a place of a text, as far as the grammar reaches; None if there is none."""
    at, unit, power, read = start, NONE, 1, 0
    while m := _TOKEN.match(text, at):
        word = m["word"]
        if word is None:
            if not read or m["op"] == "^" or m["num"]:
                break
            power, at = (-1 if m["op"] == "/" else 1), m.end()
            continue
        if read and word.lower() in PER and power == 1 and (word.lower() == "per" or unit.dims == _D):
            power, at = -1, m.end()
            continue
        factor = _rate_word(word) or _symbol(word)
        if factor is None or (read and power == 1 and text[m.start() : m.start() + 1].isspace() and text[at - 1 : at] not in "/*·"):
            break
        at, read = m.end(), read + 1
        exponent = _EXPONENT.match(text, at)
        if exponent and factor.dims != _D:
            power, at = power * int(exponent[1]), exponent.end()
        unit = Unit(factor.dims, factor.scale, factor.offset) if read == 1 and power == 1 else unit.times(factor, power)
        power = 1
    return unit if read else None


def _kept(read):
    """Keeps the readings of short texts; long ones are read again, so that what is kept stays small."""
    cached = lru_cache(maxsize=65536)(read)
    return wraps(read)(lambda text, *dims: (cached if text is None or len(text) <= KEPT else read)(text, *dims))


@_kept
def find_unit(text: str | None, dims: tuple[int, ...] = RATE) -> Unit | None:
    """The first unit of a dimension that is named anywhere in a text."""
    for m in _WORDS.finditer(text or ""):
        u = parse_unit(text, m.start())
        if u is not None and u.dims == dims:
            return u
    return None


_WORDS = re.compile(r"[^\W\d_]+")
_BARE = re.compile(r"\s?([kKmMgGtTpPeE])(?![\w/°µ])")


def _implied(text: str, at: int) -> Unit | None:
    """A rate of which only the amount of data is named (100 Mbit), or only the prefix (10G): bits or bytes a second."""
    if (u := parse_unit(text, at)) is not None and u.dims == _D:
        return u.times(Unit(_T, Fraction(1)), -1)
    if m := _BARE.match(text, at):
        return Unit(RATE, Fraction(1000) ** PREFIX_SYMBOLS[m[1].lower()])
    return None


@_kept
def read_unit(text: str | None, dims: tuple[int, ...] = RATE) -> tuple[Unit | None, bool]:
    """(unit, whether there is one that can't be read) of a text that should be a unit and nothing else."""
    t = (text or "").strip()
    if not _WORDS.search(t) or t.lower() in ABSENT:
        return None, False
    u = find_unit(t, dims) or (_implied(t, 0) if dims == RATE else None)
    return u, u is None


def parse_number(text: str) -> Decimal | None:
    """A number with thousands separators, a decimal point or comma, or an exponent."""
    m = _NUMBER.fullmatch(text.strip())
    return None if m is None else _value(m)


def _value(m: re.Match) -> Decimal | None:
    t = m[0]
    if m["gap"]:
        t = t.replace(m["sign"], "").replace(",", ".")
    elif m["comma"]:
        t = t.replace(",", "")
    elif m["stop"]:
        t = t.replace(".", "").replace(",", ".")
    try:
        return Decimal(t.replace(",", "."))
    except InvalidOperation:
        return None


_UNREAD = re.compile(r"[^\W\d_]|\s*[^\W\d_]+\s*/\s*\w|\s*\w*(?:bits?|bytes?|bauds?|[bB]ps)\b")


@_kept
def read_quantity(text: str | None, dims: tuple[int, ...] = RATE) -> tuple[Decimal | None, Unit | None, bool]:
    """(number, unit, whether it is one that can't be read) of the first number in a text whose unit fits, else of the first number.

    A number next to further digits, with a separator that makes no groups of three, is ambiguous: it
    can't be read, and nor can its tail. Nor can a unit that the grammar does not know; as such counts
    what is written on to the number, or with a slash, or ends like a rate.
    """
    first: tuple[Decimal | None, Unit | None, bool] | None = None
    text = text or ""
    for m in _NUMBER.finditer(text):
        a, b = m.start(), m.end()
        if a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        loose = _GAPS + ",."
        torn = (a > 1 and text[a - 1] in loose and text[a - 2].isdigit()) or (b + 1 < len(text) and text[b] in loose and text[b + 1].isdigit())
        n = None if torn else _value(m)
        if n is None:
            first = first or (None, None, True)
            continue
        u = parse_unit(text, b)
        if u is None or u.dims != dims:
            u = _implied(text, b) if dims == RATE else None
        if u is not None:
            return n, u, False
        first = first or (n, None, _UNREAD.match(text, b) is not None)
    return first or (None, None, False)


def parse_quantity(text: str | None, dims: tuple[int, ...] = RATE) -> tuple[Decimal, Unit | None] | None:
    """(number, unit or None), see `read_quantity`; None if there is no number or it or its unit can't be read."""
    n, u, unread = read_quantity(text, dims)
    return None if n is None or unread else (n, u)


def half_up(value: Fraction) -> int:
    """Rounded to an integer, halves away from zero."""
    q = (abs(value) + Fraction(1, 2)).__floor__()
    return q if value >= 0 else -q


def convert(number: Decimal, unit: Unit) -> Fraction:
    return Fraction(number) * unit.scale + unit.offset
