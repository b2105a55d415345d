"""Reading units and quantities as filings write them."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Context, Decimal, InvalidOperation
from functools import lru_cache
from typing import NamedTuple

# Currency names and signs.
CURRENCIES = {
    "usd": "USD", "us$": "USD", "$": "USD", "u.s.$": "USD", "dollar": "USD", "dollars": "USD",
    "eur": "EUR", "€": "EUR", "euro": "EUR", "euros": "EUR",
    "gbp": "GBP", "£": "GBP", "gb£": "GBP", "pound": "GBP", "pounds": "GBP", "sterling": "GBP",
    "jpy": "JPY", "¥": "JPY", "jp¥": "JPY", "yen": "JPY", "円": "JPY",
    "cad": "CAD", "c$": "CAD", "ca$": "CAD", "cdn$": "CAD",
    "inr": "INR", "₹": "INR", "rs": "INR", "rs.": "INR", "rupee": "INR", "rupees": "INR",
    "aud": "AUD", "a$": "AUD", "au$": "AUD", "chf": "CHF", "cny": "CNY", "cn¥": "CNY", "rmb": "CNY",
    "hkd": "HKD", "hk$": "HKD", "nzd": "NZD", "nz$": "NZD", "sgd": "SGD", "s$": "SGD", "krw": "KRW", "₩": "KRW",
    "sek": "SEK", "nok": "NOK", "dkk": "DKK", "pln": "PLN", "brl": "BRL", "r$": "BRL", "mxn": "MXN", "zar": "ZAR",
    "ils": "ILS", "₪": "ILS", "try": "TRY", "₺": "TRY", "twd": "TWD", "nt$": "TWD", "thb": "THB", "czk": "CZK", "huf": "HUF",
}
#: Signs that several currencies share, and those currencies.
SHARED_SIGNS = {"$": {"USD", "CAD", "AUD", "HKD", "NZD", "SGD", "MXN", "TWD"}, "¥": {"JPY", "CNY"}, "£": {"GBP"}, "dollars": {"USD", "CAD", "AUD", "HKD", "NZD", "SGD"}, "dollar": {"USD", "CAD", "AUD", "HKD", "NZD", "SGD"}}
# Hundredths of a currency.
MINOR = {"cent": None, "cents": None, "¢": None, "pence": "GBP", "penny": "GBP", "p": "GBP", "gbx": "GBP", "gbp.": "GBP"}
# Scale words as powers of ten.
SCALES = {
    "hundred": 2, "hundreds": 2, "k": 3, "t": 3, "tsd": 3, "tsd.": 3, "thousand": 3, "thousands": 3, "000s": 3, "000": 3, "'000": 3, "千": 3,
    "万": 4, "lakh": 5, "lakhs": 5, "m": 6, "mm": 6, "mn": 6, "mio": 6, "mio.": 6, "million": 6, "millions": 6, "百万": 6,
    "cr": 7, "crore": 7, "crores": 7, "億": 8, "亿": 8, "b": 9, "bn": 9, "mrd": 9, "mrd.": 9, "billion": 9, "billions": 9,
    "tn": 12, "trn": 12, "trillion": 12, "trillions": 12, "兆": 12,
}
# What is no money; common unit, power of ten, multiplier, divisor.
MEASURES = {
    "share": ("shares", 0, 1, 1), "shares": ("shares", 0, 1, 1),
    "pure": ("pure", 0, 1, 1), "ratio": ("pure", 0, 1, 1), "x": ("pure", 0, 1, 1),
    "%": ("pure", -2, 1, 1), "percent": ("pure", -2, 1, 1), "pct": ("pure", -2, 1, 1), "per cent": ("pure", -2, 1, 1), "percentage": ("pure", -2, 1, 1),
    "‰": ("pure", -3, 1, 1), "bps": ("pure", -4, 1, 1), "bp": ("pure", -4, 1, 1), "basis points": ("pure", -4, 1, 1), "basis point": ("pure", -4, 1, 1),
    "count": ("count", 0, 1, 1), "customer": ("count", 0, 1, 1), "customers": ("count", 0, 1, 1), "seat": ("count", 0, 1, 1), "seats": ("count", 0, 1, 1), "users": ("count", 0, 1, 1),
    "day": ("days", 0, 1, 1), "days": ("days", 0, 1, 1), "d": ("days", 0, 1, 1),
    "week": ("days", 0, 7, 1), "weeks": ("days", 0, 7, 1), "wk": ("days", 0, 7, 1), "wks": ("days", 0, 7, 1), "w": ("days", 0, 7, 1),
    "hour": ("days", 0, 1, 24), "hours": ("days", 0, 1, 24), "hr": ("days", 0, 1, 24), "hrs": ("days", 0, 1, 24), "h": ("days", 0, 1, 24),
    "minute": ("days", 0, 1, 1440), "minutes": ("days", 0, 1, 1440), "min": ("days", 0, 1, 1440), "mins": ("days", 0, 1, 1440),
}
FILLERS = {"in", "of", "iso4217", "xbrli", "us", "u.s.", "unit", "units", "ratio of"}
COMMON = re.compile(r"(?:[A-Z]{3}(?:/shares)?|shares|pure|count|days)\Z")
LABEL_TOKEN = re.compile(r"basis points?|per cent\b|(?:hk|nz|ca|cdn|us|au|nt|cn|jp|gb)[$¥£]|u\.s\.\$|[acrs]\$|u\.s\.|(?:rs|mio|mrd|tsd)\.|百万|[^\W\d_]+|'?000s?|[$€£¥₹₩₪₺¢%‰]|/|\S")
GLUED = re.compile(rf"({'|'.join(sorted((c for c in CURRENCIES if c.isalpha() and len(c) == 3), key=len))})(m|mm|mn|k|bn|b|tn)\Z|(k|m|mm|bn|t)({'|'.join(c for c in CURRENCIES if c.isalpha() and len(c) == 3)})\Z")


class Unit(NamedTuple):
    common: str
    power: int = 0
    times: int = 1
    over: int = 1
    sign: str = ""


@lru_cache(maxsize=65536)
def read_unit(label: str | None) -> Unit | None:
    """What a unit label says, or null where it can't be read as one unit."""
    if label is None:
        return None
    text = re.sub(r"\biso4217:|\bxbrli:", "", label.casefold().strip())
    tokens: list[str] = []
    for t in LABEL_TOKEN.findall(text):
        if t in CURRENCIES or t in SCALES or t in MEASURES or t in MINOR or t in FILLERS:
            tokens.append(t)
        elif m := GLUED.match(t):
            tokens.extend(x for x in m.groups() if x)
        elif t in "()[].,":
            continue
        elif all(ch in "百千万億兆亿円" for ch in t):
            tokens.extend(re.findall("百万|.", t))
        else:
            tokens.append(t)
    currency = measure = sign = None
    power, per, minor = 0, False, False
    for t in tokens:
        if t in ("/", "per"):
            if per:
                return None
            per = True
        elif per:
            if t not in ("share", "shares"):
                return None  # a rate per year or month is another quantity
            measure = "share"
        elif t in MINOR and not (t == "p" and currency not in (None, "GBP")):
            minor, currency = True, currency or MINOR[t] or "USD"
        elif t in CURRENCIES:
            if currency not in (None, CURRENCIES[t]):
                return None
            currency, sign = CURRENCIES[t], t
        elif t in MEASURES and measure is None and currency is None:
            measure = t
        elif t in SCALES:
            power += SCALES[t]
        elif t not in FILLERS:
            return None
    if currency and measure is None and not per:
        return Unit(currency, power - 2 * minor, sign=sign or "")
    if currency and measure == "share" and per:
        return Unit(f"{currency}/shares", power - 2 * minor, sign=sign or "")
    if measure and not currency and not per:
        common, p, times, over = MEASURES[measure]
        return Unit(common, power + p, times, over)
    return None


DATE_TAIL = re.compile(r"\s+(?:as of|as at|at|on|per|zum|au)\s+\w+\.?\s+\d{1,2},?\s+\d{4}\s*\Z|\s+(?:as of|as at|on)\s+\d{4}-\d\d-\d\d\s*\Z", re.I)
HEDGE = re.compile(r"^(?:approximately|approx\.?|about|around|roughly|nearly|almost|over|under|more than|less than|up to|at least|some|circa|ca\.|c\.|~|≈|>|<|約|rund|etwa|environ)\s*", re.I)
QUANTITY = re.compile("^(?P<a>[^\\d]*?)(?P<n>\\d[\\d.,' \u00a0\u2009\u202f]*\\d|\\d)(?P<b>[^\\d]*)$")
#: Decimal places behind the last digit to which a quotient that doesn't end is rounded.
PLACES = 15


def exact(*texts: str) -> Context:
    """A context in which numbers of these digits lose none when they are read, multiplied or shifted."""
    return Context(prec=sum(map(len, texts)) + 40, Emax=999999, Emin=-999999)


def read_number(text: str, comma_is_point: bool) -> Decimal | None:
    """A positive number with grouping marks; ``comma_is_point`` tells German writing."""
    t = re.sub("[' \u00a0\u2009\u202f]", "", text)
    if comma_is_point:
        t = t.replace(".", "").replace(",", ".")
    elif "," in t and "." not in t and not re.fullmatch(r"\d{1,3}(?:,\d{2,3})*,\d{3}", t):
        t = t.replace(",", ".") if t.count(",") == 1 else t
    else:
        t = t.replace(",", "")
    try:
        return exact(t).create_decimal(t)
    except InvalidOperation:
        return None


def plain(d: Decimal) -> str:
    """Plain decimal text without exponent or needless zeros."""
    t = format(d, "f")
    t = t.rstrip("0").rstrip(".") if "." in t else t
    return "0" if t in ("-0", "", "0") else t


def read_raw(raw: str | None) -> tuple[Decimal, str] | None:
    """The signed number of a quantity in words and the words of its unit, else null."""
    if raw is None or not raw.strip():
        return None
    t = DATE_TAIL.sub("", raw.strip().replace("−", "-").replace("–", "-"))
    negative = False
    if m := re.fullmatch(r"\((.*)\)", t.strip()):
        negative, t = True, m[1]
    while True:
        t = t.strip()
        if t[:1] in "+-" and t:
            negative, t = negative ^ (t[0] == "-"), t[1:]
        elif m := HEDGE.match(t):
            t = t[m.end() :]
        else:
            break
    m = QUANTITY.match(t)
    if not m:
        return None
    before, after = m["a"].strip(), m["b"].strip()
    if before.endswith("-"):
        negative, before = not negative, before[:-1].strip()
    phrase = f"{before} {after}".strip()
    number = read_number(m["n"], bool(re.search(r"\b(?:mio|mrd|tsd)\b", phrase, re.I)))
    return None if number is None else (-number if negative else number, phrase)


def to_common(number: Decimal, unit: Unit, scale: int = 0) -> str:
    context = exact(str(number), str(unit.times))
    value = context.multiply(number, context.scaleb(Decimal(unit.times), unit.power + scale))
    if unit.over != 1:
        last = number.as_tuple().exponent + unit.power + scale - PLACES
        value = context.divide(value, Decimal(unit.over)).quantize(Decimal(1).scaleb(last, context), rounding=ROUND_HALF_UP, context=context)
    return plain(value)


CONTEXT = re.compile(r"(.*) \[([A-Z]{3})\]\Z", re.S)


@lru_cache(maxsize=65536)
def read_label(label: str | None) -> Unit | None:
    """:func:`read_unit` of a label that may name in brackets the currency its sign stands for."""
    if label is None or not (m := CONTEXT.match(label)):
        return read_unit(label)
    u = read_unit(m[1])
    return u and u._replace(common=m[2] + u.common[3:])


class Parts(NamedTuple):
    """One record told twice: in the words of its raw text, and in its columns. Numbers are plain text, null where there is none."""

    raw_number: str | None
    raw_label: str | None
    number: str | None
    label: str | None


def payload_parts(raw: str | None, value: str | None, unit: str | None, currency: str | None) -> Parts:
    """Numbers and unit labels of one record, from its raw text and from its columns.

    A sign that several currencies share, and plain cents, get the currency of the unit or currency
    column in brackets. A raw text without words of a unit gives its number to the columns if they have none.
    """
    label = unit if read_unit(unit) or not read_unit(currency) else currency
    said = read_raw(raw)
    raw_number = raw_label = number = None
    if said and said[1]:
        raw_number, raw_label = plain(said[0]), said[1]
        if u := read_unit(said[1]):
            others = [o.common[:3] for o in (read_unit(unit), read_unit(currency)) if o]
            if u.sign in SHARED_SIGNS:
                known = next((o for o in others if o in SHARED_SIGNS[u.sign]), None)
            else:
                cents = u.common == "USD" and not u.sign and u.power % 3 and (o := read_unit(currency)) and len(o.common) == 3
                known = o.common if cents else None
            if known and known != u.common[:3]:
                raw_label = f"{raw_label} [{known}]"
    if value is not None and value.strip():
        v = value.strip().replace("−", "-")
        sign = -1 if v[:1] == "-" or re.fullmatch(r"\(.*\)", v) else 1
        try:
            d = sign * exact(v).create_decimal(v.strip("()+-").replace(",", "").strip())
            number = plain(d) if d.is_finite() else None
        except InvalidOperation:
            pass
    if number is None and said and not said[1]:
        number = plain(said[0])
    return Parts(raw_number, raw_label, number, label)


def quantity(raw: str | None, value: str | None, unit: str | None, currency: str | None, scale: int | None) -> tuple[str, str, str] | None:
    """(common unit, common value, raw unit label) of one record as its labels read, or null.

    The raw text is right where it states number and unit; otherwise value x 10^scale in the
    unit column (or, without one, the currency column) counts, a null scale being 0.
    """
    p = payload_parts(raw, value, unit, currency)
    if p.raw_label and (u := read_label(p.raw_label)):
        return u.common, to_common(Decimal(p.raw_number), u), p.raw_label
    u = read_unit(p.label)
    return None if p.number is None or u is None else (u.common, to_common(Decimal(p.number), u, scale or 0), "")
