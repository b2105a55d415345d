"""Full-text search in plain text functions: stems, phrases, alternatives, exclusions, ranks.

A text becomes a line of stems between blanks, on which a phrase is a plain substring; so all of it
stays in generated code, and texts that can't match are dropped by substring tests before they are stemmed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of plurals and what replaces them, in order (the published S stemmer), and words that queries leave out.
ENDINGS = ((r"([b-df-z0-9])ies\b", "y"), (r"([b-df-np-z0-9])es\b", "e"), (r"([a-rtv-z0-9])s\b", ""))
STOP_WORDS = frozenset("a an and are as at be by for from has have in is it its of on or that the this to was were will with".split())


def stem(word: str) -> str:
    """The stem of one word, as :func:`stem_line` makes it."""
    for pattern, end in ENDINGS:
        word = re.sub(pattern, rf"\g<1>{end}", word)
    return word


def stem_line(text: Column) -> Column:
    """Stems in the order of the text, each between two blanks of its own."""
    t = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "  "), F.lit("  "))
    for pattern, end in ENDINGS:
        t = F.regexp_replace(t, pattern, f"$1{end}")
    return t


def parsed(query: str) -> tuple[list[list[str]], list[str]]:
    """(groups, excluded) of a search text: all groups must occur, of each one phrase at least.

    Words stand alone or as a phrase in quotes, ``OR`` between two makes them one group, a minus before one excludes it.
    Words without meaning are left out of plain words, but not of phrases. Phrases are stems between blanks.
    """
    groups: list[list[str]] = []
    excluded: list[str] = []
    either = False
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if plain == "OR" and not minus:
            either = bool(groups)
            continue
        words = re.findall("[a-z0-9]+", (quoted or plain).lower())
        if not quoted:
            words = [w for w in words if w not in STOP_WORDS]
        if not words:
            continue
        phrase = " " + "  ".join(map(stem, words)) + " "
        if minus:
            excluded.append(phrase)
        elif either:
            groups[-1].append(phrase)
        else:
            groups.append([phrase])
        either = False
    return groups, excluded


def _may_hold(text: Column, phrase: str) -> Column:
    """A test that every text with the phrase passes: what stems leave of each of its words is in the text."""
    rooted = [w[:-1] if w[-1:] in ("y", "e") and len(w) > 1 else w for w in phrase.split()]
    out = text.contains(rooted[0])
    for w in rooted[1:]:
        out = out & text.contains(w)
    return out


def search(items: DataFrame, id_col: str, text: str, query: str) -> DataFrame:
    """(item_id, score): the texts that match ``query`` (see :func:`parsed`), by how often what they match occurs.

    The score is the number of occurrences of all phrases asked for, over 1 + ln of the number of words,
    to 6 places. A query without any word matches nothing; null texts match nothing. Nothing is shuffled.
    """
    groups, excluded = parsed(query)
    low = F.lower(F.col(text))
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text).alias("__text"), low.alias("__low")).where(F.lit(bool(groups)))
    for g in groups:
        some = _may_hold(F.col("__low"), g[0])
        for p in g[1:]:
            some = some | _may_hold(F.col("__low"), p)
        rows = rows.where(some)
    # a generated column keeps the optimizer from writing the whole line out again in every test on it
    rows = rows.select("item_id", F.explode(F.array(stem_line(F.col("__text")))).alias("__line"))
    for g in groups:
        some = F.col("__line").contains(g[0])
        for p in g[1:]:
            some = some | F.col("__line").contains(p)
        rows = rows.where(some)
    for p in excluded:
        rows = rows.where(~F.col("__line").contains(p))
    hits = F.lit(0)
    for p in dict.fromkeys(p for g in groups for p in g):
        hits = hits + (F.length("__line") - F.length(F.replace(F.col("__line"), F.lit(p), F.lit("")))) / len(p)
    n_words = F.size(F.regexp_extract_all("__line", F.lit("[a-z0-9]+"), F.lit(0)))
    return rows.select("item_id", F.round(hits / (1 + F.ln(n_words)), 6).alias("score"))


def search_sql(table: str, id_col: str, text: str, query: str) -> str:
    """The same in DuckDB's SQL."""
    groups, excluded = parsed(query)
    line = f"'  ' || regexp_replace(lower({text}), '[^a-z0-9]+', '  ', 'g') || '  '"
    for pattern, end in ENDINGS:
        line = f"regexp_replace({line}, '{pattern}', '\\1{end}', 'g')"
    holds = " AND ".join("(" + " OR ".join(f"contains(l, '{p}')" for p in g) + ")" for g in groups)
    bars = "".join(f" AND NOT contains(l, '{p}')" for p in excluded)
    hits = " + ".join(f"(length(l) - length(replace(l, '{p}', ''))) / {len(p)}" for p in dict.fromkeys(p for g in groups for p in g))
    return f"SELECT {id_col} AS item_id, round(({hits}) / (1 + ln(len(regexp_extract_all(l, '[a-z0-9]+')))), 6) AS score FROM (SELECT {id_col}, {line} AS l FROM {table} WHERE {text} IS NOT NULL) WHERE {holds}{bars}"
