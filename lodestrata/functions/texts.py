"""Small text functions: intents, variants, redaction, lists, spaces."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents in the order in which they are tried, with their words.
INTENTS = (
    ("contradiction", ("contradict", "contradiction", "inconsistent", "discrepancy", "conflict", "disagree")),
    ("driver_analysis", ("why", "driver", "drivers", "driven by", "because", "reason for", "contributed to", "attributable to")),
    ("comparison", ("compare", "comparison", "versus", "vs", "year over year", "year-over-year", "yoy", "relative to", "change from")),
    ("guidance", ("guidance", "outlook", "forecast", "guide")),
    ("table_reasoning", ("table", "breakdown", "line item", "sum of", "total across")),
    ("section_lookup", ("section", "item 7", "md&a", "risk factors", "notes to")),
    ("fact_lookup", ("what was", "how much", "what is the", "value of", "amount of", "report")),
)
# Words of questions and what may stand for them, in the order in which variants are made.
SYNONYMS = {
    "net income": ("net earnings", "profit", "bottom line"), "gross margin": ("gross profit margin",), "free cash flow": ("fcf",), "operating expenses": ("opex",),
    "cost of goods sold": ("cogs", "cost of revenue"), "capital expenditures": ("capex",), "revenue": ("net sales", "total revenue", "sales"), "cogs": ("cost of goods sold", "cost of revenue"),
    "capex": ("capital expenditures",), "opex": ("operating expenses",), "fcf": ("free cash flow",), "eps": ("earnings per share",), "guidance": ("outlook", "forecast"),
}


def intent(question: Column, default: str = "general") -> Column:
    """The first intent one of whose words the question has, whole and in any case."""
    out = None
    for name, phrases in INTENTS:
        hit = F.lower(question).rlike(r"(?<!\w)(" + "|".join(map(re.escape, phrases)) + r")(?!\w)")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def variants(text: Column, synonyms: dict[str, str | tuple[str, ...]], most: int = 4) -> Column:
    """The text and copies in which the first occurrence of a word is replaced, without repeats."""
    out = [text]
    for word, others in synonyms.items():
        for other in (others,) if isinstance(others, str) else others:
            out.append(F.regexp_replace(text, rf"(?is)^(.*?)(?<!\w){re.escape(word)}(?!\w)", f"$1{other}"))
    return F.slice(F.array_distinct(F.array(*out)), 1, most)


#: A key that names a credential (bare or in quotes), and its value: quoted, behind a scheme, or bare.
CREDENTIAL = r"""(?i)((["']?)[a-z0-9_-]*(?:secret|api[_-]?key|password|passwd|token|authorization)[a-z0-9_-]*\2\s*[:=]\s*)(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|(?:(?:bearer|basic)\s+)?[^\s,;}\]]+)"""


def redact(text: Column, most: int = 256, strict: bool = False) -> Column:
    """Credentials masked, quoted literals blanked, white space collapsed, cut to ``most``.

    ``strict``, for messages: what follows a bare scheme word is masked too, and literals in double quotes are blanked.
    """
    t = F.regexp_replace(text, CREDENTIAL, "$1***")
    t = F.regexp_replace(t, r"://[^/\s:@]+:[^/\s@]+@", "://***@")
    if strict:
        t = F.regexp_replace(t, r"(?i)\b(?:bearer|basic)\s+[^\s,;}\]]+", "***")
        t = F.regexp_replace(t, r'"[^"]*"', '"?"')
    t = F.regexp_replace(t, r"'[^']*'", "'?'")
    return F.left(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(most))


def listed(text: Column) -> Column:
    """Parts of a text between commas or line breaks, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def approx_tokens(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def grouped(number: Column) -> Column:
    """A whole number with its thousands parted by commas."""
    return F.format_number(number, 0)


def url_token(text: Column) -> Column:
    """UTF-8 in base64 for URLs, without padding."""
    return F.translate(F.rtrim(F.base64(F.encode(text, "UTF-8")), F.lit("=")), "+/\r\n", "-_")


def from_url_token(token: Column) -> Column:
    """The text behind a token; null where it is none."""
    plain = F.translate(token, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(token.rlike("^[A-Za-z0-9_-]*$"), F.decode(F.unbase64(padded), "UTF-8"))


def without_markup(text: Column) -> Column:
    """Tags and signs that could end a quotation in a prompt taken out, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "</?[A-Za-z][^<>]*>|[`{}<>]", " "), " +", " "))
