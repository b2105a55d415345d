"""Per-document text quality statistics that tell natural prose from lists, tables and junk."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.tables import cut

CELL_END = re.compile(r"</t[dh]\s*>\s*<t[dh][^<>]*>", re.I)
ROW_END = re.compile(r"</(?:tr|p|div|li|h[1-6])\s*>|<br\s*/?>", re.I)
ITEM = re.compile(r"<li[^<>]*>", re.I)
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
CLEAN = re.compile(r"[\w .,'’&/()$€£¥%:+–—-]*")
WORD = re.compile(r"[^\W\d_]+")
NUMERIC = re.compile("[-+(\u2212\u2013\u2014$€£¥₹%]*(?:[A-Z]{3}\\s)?[-+(\u2212]?[$€£¥₹]?\\s?\\d[\\d.,' \u00a0\u202f]*\\s*(?:%|bps|x|[kmbKMB]n?)?\\)?%?|[-\u2013\u2014]|n/?[am]|:?-{2,}:?", re.I)
BULLET = re.compile(r"(?:[*•‣◦▪·●○■□☐☑✓✔➢►>–—-]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlIVXL]{1,5})[.)])\s+\S")
LEADER = re.compile(r"(?:\.\s?){3,}\s*(?:[A-Z]-)?\d+\s*$|\s{3,}\d+\s*$|…\s*\d+\s*$")
ENUMERATED = re.compile(r"(?:item|note|exhibit|section|schedule|part|annex|figure|table|§)\s*\d+[A-Za-z]?[.:]?\s", re.I)
ENDING = re.compile(r"[.!?。！？।؟…:][\"'”’»)\]]*\s*$")
CLAUSE = re.compile(r"[^\W\d_]{2,}")
GARBLE = re.compile("[ÃÂâ][\u0080-¿€ŒœŠšŽžŸƒˆ˜–—‘-„†-•…‰‹›™]|ï»¿|ð[\u009fŸ]|�")
WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff00-\uffef]")

# Frequent words of the languages of filings.
COMMON = frozenset(
    "the of and to in a for is on that by this with as at from was were be are or an it its which we our have has had not will would could may "
    "der die das und in den von zu mit im für auf ist des dem ein eine als auch werden wurde wurden hat nicht sich bei uns aus nach vor bis zum um "
    "le la les de des du et en un une est au aux par pour dans sur que qui à ce ces sont été nous a ont se ne pas plus avec d l "
    "el los las del y un una es en por para con que se su sus al lo como no más fue ha han este esta desde hasta durante "
    "o os as do da dos das e em um uma que não por para com se ao à foi são mais na no nas nos pela pelo sem "
    "il lo gli di che è con per non una sono del della nel alla "
    "het een van en de dat op te zijn met voor niet aan".split()
)

#: The statistics, in the order of the vector.
STATS = (
    "log_words", "mean_word_length", "symbol_ratio", "odd_symbol_ratio", "digit_ratio", "upper_start_ratio", "ending_lines", "common_words", "words_per_line", "distinct_lines",
    "distinct_words", "longest_token", "garbled_ratio", "sentence_share", "marked_lines", "numeric_tokens", "cell_marks", "comma_marks",
)
#: Kinds of text that is no prose, and the statistics whose parts in the distance speak for them.
KIND_STATS = {
    "list": ("marked_lines", "comma_marks", "upper_start_ratio"),
    "table": ("numeric_tokens", "cell_marks", "digit_ratio"),
    "junk": ("odd_symbol_ratio", "garbled_ratio", "longest_token", "distinct_words", "distinct_lines", "mean_word_length"),
}
#: The squared distance from which a document is an outlier: the 99 % point of chi-squared with 18 degrees of freedom.
FAR = 34.8
#: The share of a text that must be list, table or junk for it to be most of the text.
MOST = 0.5
#: Part of a statistic's variance over all documents that is added to its variance within prose, so that one
#: that hardly varies there (odd symbols, garbled letters) doesn't make an outlier of every trace of it.
RIDGE = 0.02
#: Weight, in documents, of the prose below among all languages', and of all languages' among each one's.
PRIOR = 50
# Mean and standard deviation of each statistic in running text, in the order of STATS.
RUNNING = np.array([
    (5.0, 1.0), (1.7, 0.2), (0.04, 0.02), (0.002, 0.004), (0.05, 0.03), (0.15, 0.1), (0.8, 0.25), (0.3, 0.15), (2.8, 0.9), (1.0, 0.05),
    (0.55, 0.12), (2.7, 0.3), (0.0, 0.003), (0.9, 0.15), (0.02, 0.05), (0.08, 0.05), (0.05, 0.15), (0.05, 0.04),
])


#: A word of two letters or more, or a number, with the signs that may stand around them.
PLAIN_TOKEN = re.compile(r"[\"'“‘(\[$€£¥]*(?:[^\W\d_]{2,}(?:['’-][^\W\d_]+)*|a|[IAày]|\d[\d.,]*%?)[.,;:!?\"'”’)\]]*")
GROUPING = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")


def _cells(line: str) -> list[str]:
    s = line.strip()
    if "\t" in s:
        cells = s.split("\t")
    elif s.count("|") >= 1:
        cells = s.strip("|").split("|")
    elif s.count(";") >= 2:
        cells = s.split(";")
    elif re.search(r"\S {2,}\S", s):
        cells = re.split(r" {2,}", s)
    elif len(GROUPING.sub("", s).split(",")) >= 3 and not re.search(r",\s", s):
        cells = s.split(",")
    else:
        return []
    return [c.strip() for c in cells]


SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"()%$-")
LOOSE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
DIGITS = b"0123456789"


def line_kind(s: str) -> str:
    """What a stripped line is: ``table``, ``list``, ``junk``, ``prose``, or ``short``.

    Short lines belong to a list, to narrowly set prose or to a heading; which, only their
    paragraph tells.
    """
    raw = s.encode()
    digits = len(raw) - len(raw.translate(None, DIGITS))
    odd = len(raw) - len(raw.translate(None, SYMBOLS))
    tokens = s.split()
    n_tokens, size = len(tokens), len(s)
    if size > 100 and n_tokens > 0.1 * size and odd < 0.02 * size and digits < 0.15 * size and s.isascii() and "  " not in s and "\t" not in s:
        commas = s.count(",") + s.count(";")
        if commas < 7 or n_tokens > 3.2 * (commas + 1):
            if not BULLET.match(s) and not LEADER.search(s):
                return "prose"
    if not any(map(str.isalnum, s)):
        if size >= 3 and "|" not in s:
            return "junk"
        return "table" if "|" in s else "short"
    if size > 20 and not s.isascii() and len(GARBLE.findall(s)) > 0.06 * size:
        return "junk"
    wide = 0 if s.isascii() else len(WIDE.findall(s))
    cells = _cells(s)
    if len(cells) >= 2 and max(map(len, cells)) <= 60 and all(map(CLEAN.fullmatch, cells)):
        numeric = sum(bool(NUMERIC.fullmatch(c)) for c in cells if c)
        if numeric >= 1 and numeric * 2 >= len(cells) - 1:
            return "table"
        if len(cells) >= 3 and not ENDING.search(s) and max(len(c.split()) for c in cells) <= 6:
            return "table"
    letters = sum(map(len, WORD.findall(s)))
    if n_tokens >= 3 and letters < digits and sum(bool(NUMERIC.fullmatch(t)) for t in tokens) >= 0.75 * n_tokens:
        return "table"
    longest = max(map(len, tokens))
    if longest > 40 and longest > 0.5 * size and wide * 4 < size:
        return "junk"
    bullet, leader = BULLET.match(s), LEADER.search(s)
    if not bullet and not leader and len(raw) - len(raw.translate(None, LOOSE)) > 0.22 * max(1, size - s.count(" ")):
        if n_tokens < 6 or sum(bool(PLAIN_TOKEN.fullmatch(t)) for t in tokens) < 0.6 * n_tokens:
            return "junk"
    words = CLAUSE.findall(s)
    if leader:
        return "list"
    if bullet:
        return "prose" if len(words) >= 14 and ENDING.search(s) else "list"
    commas = s.count(",") + s.count(";")
    if commas >= 7 and len(words) <= 3.2 * (commas + 1) and len(SENTENCE_END.findall(s)) <= 1:
        return "list"
    if len(words) <= 12 and size <= 90 and wide * 2 < size:
        return "short"
    return "prose"


def paragraph_kind(lines: list[str]) -> str:
    """What short lines that follow one another are together.

    Whatever the language, most of a narrowly set paragraph stands in sentences of some length, or in
    long runs of letters where a script has no blanks between words (and some no stops either).
    """
    if len(lines) < 4:
        return "prose"
    if Counter(lines).most_common(1)[0][1] >= max(4, 0.5 * len(lines)):
        return "junk"
    text = "\n".join(lines)
    if sentence_chars(text) * 2 >= len(text):
        return "prose"
    if not text.isascii():
        runs = [t for t in text.split() if not t.isascii()]
        if sum(len(t) for t in runs if len(t) >= 14) * 2 >= len(text):
            return "prose"
    return "list"


SENTENCE_END = re.compile(r"[.!?](?:(?<=[^\W_]{2}[.!?])|(?<=[%)][.!?]))[\"'”’»)\]]*(?:\s|$)|[。！？।؟]")


def sentence_chars(text: str) -> int:
    """How many characters stand in sentences: what a full stop closes after four blanks, or eight letters without any."""
    covered = last = 0
    for m in SENTENCE_END.finditer(text):
        end = m.end()
        blanks = text.count(" ", last, end) + text.count("\n", last, end)
        if blanks >= 4 or (blanks <= 1 and end - last >= 8 and not text[last:end].isascii()):
            covered += end - last
        last = end
    return covered


def shares(lines: list[str]) -> dict[str, float]:
    """Share of the characters (white space at the ends of lines aside) in lists, tables and junk.

    Runs of short lines are judged together, with the prose lines they stand between:
    narrowly set prose has both.
    """
    size: Counter[str] = Counter()
    run: list[str] = []
    proselike = False

    def close() -> None:
        nonlocal proselike
        short = [x for x in run if x[0] == "\x01"]
        if short:
            kind = "prose" if proselike else paragraph_kind([x[1:] for x in short])
            size[kind] += sum(len(x) - 1 for x in short)
        run.clear()
        proselike = False

    for s in lines:
        if not s:
            close()
            continue
        kind = line_kind(s)
        if kind == "short":
            run.append("\x01" + s)
        else:
            size[kind] += len(s)
            if kind == "prose":
                proselike = True
            else:
                close()
    close()
    total = sum(size.values())
    words = " ".join(lines).lower().split()
    if len(words) > 40 and len(set(words)) < 0.12 * len(words) and not any(map(SENTENCE_END.search, lines)):
        size = Counter(table=size["table"], junk=total - size["table"])
    return {k: size[k] / total if total else 0.0 for k in ("list", "table", "junk")}


def plain_lines(text: str) -> list[str]:
    """The lines a reader sees; cells of HTML tables are parted by tabs. Blank lines are empty."""
    if "<" in text:
        text = TAG.sub("", ITEM.sub("\n• ", ROW_END.sub("\n", CELL_END.sub("\t", text))))
    if "&" in text:
        text = html.unescape(text)
    return [x.strip() for x in text.splitlines()]


MARK = re.compile(r"(?:[*•‣◦▪·●○■□☐☑✓✔➢►>–—-]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlIVXL]{1,5})[.)])[ \t]+\S")
TRAIL = re.compile(r"(?:\.[ ]?\.[ ]?\.|[ ]{3}|…)[. ]*(?:[A-Z]-)?\d+$", re.M)
# Bytes of numbers and of what may stand around them (signs, brackets, currencies and dashes in UTF-8) become one byte.
FIGURES = bytes.maketrans("0123456789-+()$.,'%€£¥−–—".encode(), b"0" * len("0123456789-+()$.,'%€£¥−–—".encode()))
GROUPED = re.compile(r",(?=\d{3}(?!\d))")
FIGURE = re.compile(rb"\s0+(?=\s)")


def cell_marks(text: str) -> int:
    """How many tabs, bars, gaps of two blanks, and semicolons and commas without a blank (not in grouped numbers) there are."""
    n = text.count("\t") + text.count("|") + text.count("  ")
    if ";" in text:
        n += text.count(";") - text.count("; ") - text.count(";\n")
    tight = text.count(",") - text.count(", ") - text.count(",\n")
    return n + (tight - len(GROUPED.findall(text)) if tight else 0)


def text_statistics(text: str | None) -> list[float] | None:
    """The vector of STATS of a text; null for null, empty and blank texts.

    None but ``common_words`` (of a fixed list of some languages) depends on the language.
    """
    if text is None or not text.strip():
        return None
    lines = [x for x in plain_lines(text) if x] or [text.strip()]
    joined = "\n".join(lines)
    raw, tokens = joined.encode(), joined.split()
    n, k, length = len(tokens), len(lines), len(joined)
    size, bytes_ = max(1, length - n + 1), len(raw)
    count = lambda kept: (bytes_ - len(raw.translate(None, kept))) / size
    figures = len(FIGURE.findall(b" %s " % raw.translate(FIGURES)))
    marked = sum(MARK.match(x) is not None for x in lines)
    if "..." in joined or ". . ." in joined or "   " in joined or "…" in joined:
        marked += len(TRAIL.findall(joined))
    return [
        math.log(n), math.log(size / n), count(LOOSE), count(SYMBOLS), count(DIGITS),
        sum(map(str.isupper, map(itemgetter(0), tokens))) / n, sum(x[-1] in ".!?:。！？।؟\"”»)" for x in lines) / k,
        sum(map(COMMON.__contains__, tokens)) / n, math.log(n / k), len(set(lines)) / k, min(1.0, len(set(tokens)) / n * math.log(n + 1) / 6),
        math.log(max(map(len, tokens))), len(GARBLE.findall(joined)) / size if any(map(joined.__contains__, "ÃÂâïð�")) else 0.0, sentence_chars(joined) / length,
        min(1.0, marked / k), figures / n, math.log1p(cell_marks(joined) / k), math.log1p(joined.count(", ") / n),
    ]


# Three-letter language codes and the two-letter ones.
LONG_CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "jpn": "ja", "zho": "zh", "chi": "zh"}


def language(label: str | None) -> str:
    """Two-letter code of a language label, ``und`` where it has none; so there are at most 677."""
    code = re.split(r"[-_ ]", (label or "").strip().lower())[0]
    code = LONG_CODES.get(code, code)
    return code if re.fullmatch(r"[a-z]{2}", code) else "und"


def document_statistics(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, language, stats): the statistics of every document that isn't null or blank."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, language(g), s) for i, t, g in zip(b["id"], b["text"], b["lang"]) if (s := text_statistics(t)) is not None]
            yield pd.DataFrame(found, columns=["id", "language", "stats"])

    some = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull())
    return some.mapInPandas(run, f"id {kind}, language string, stats array<double>")


class Prose:
    """Location and inverse scatter of each language's prose, drawn towards all languages' together.

    ``sums`` has the count, sums and products of each language's documents; ``spread`` is the variance of
    each statistic over all documents. A language with n documents weighs n against :data:`PRIOR` of all
    languages, and all of them together n against PRIOR of :data:`RUNNING`, so that parameters change smoothly with
    the number of documents, from what they are without any.
    """

    def __init__(self, sums: dict[str, tuple[float, np.ndarray, np.ndarray]], spread: np.ndarray):
        k = len(STATS)
        n = sum(x[0] for x in sums.values())
        total, squares = sum((x[1] for x in sums.values()), np.zeros(k)), sum((x[2] for x in sums.values()), np.zeros((k, k)))
        usual = RUNNING[:, 0]
        mean, second = (total + PRIOR * usual) / (n + PRIOR), (squares + PRIOR * (np.outer(usual, usual) + np.diag(RUNNING[:, 1] ** 2))) / (n + PRIOR)
        self.ridge = np.diag(RIDGE * spread + 1e-9)
        self.common = self._fit(mean, second)
        self.of = {g: self._fit((s + PRIOR * mean) / (m + PRIOR), (q + PRIOR * second) / (m + PRIOR)) for g, (m, s, q) in sums.items()}

    def _fit(self, mean: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mean, np.linalg.inv(second - np.outer(mean, mean) + self.ridge)

    def contributions(self, languages: list[str], x: np.ndarray) -> np.ndarray:
        """Each statistic's part in the squared Mahalanobis distance of each row."""
        out = np.empty_like(x)
        names = np.array(languages)
        for g in set(languages):
            mean, inverse = self.of.get(g, self.common)
            d = x[names == g] - mean
            out[names == g] = d * (d @ inverse)
        return out


def _sums(stats: DataFrame, keep) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and products per language of the rows ``keep`` chooses, added up in the executors.

    What reaches the driver is at most 677 languages x 241 numbers.
    """
    k = len(STATS)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if len(b):
                x, names = np.stack(b["stats"].to_numpy()), b["language"].to_numpy()
                chosen = keep(list(names), x)
                for g in set(names[chosen]):
                    y = x[chosen & (names == g)]
                    total[g] = total.get(g, 0) + np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
        yield pd.DataFrame([(g, p, v) for g, t in total.items() for p, v in enumerate(t)], columns=["language", "p", "v"])

    rows = stats.select("language", "stats").mapInPandas(part, "language string, p int, v double").groupBy("language", "p").agg(F.sum("v").alias("v")).collect()
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["language"], np.zeros(1 + k + k * k))[r["p"]] = r["v"]
    return {g: (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for g, v in found.items()}


def _quartiles(stats: DataFrame) -> dict[str, tuple[float, np.ndarray]]:
    """(documents, 3 x statistics quartiles) of each language, at most 677 x 55 numbers."""
    of = [F.percentile_approx(F.col("stats")[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(len(STATS))]
    rows = stats.groupBy("language").agg(F.count("*").alias("n"), *of).collect()
    return {r["language"]: (r["n"], np.array([r[f"q{i}"] for i in range(len(STATS))]).T) for r in rows}


def fit_prose(stats: DataFrame) -> Prose:
    """Robust parameters of prose from all documents of each language, in three steps.

    Medians and quartile distances, which a quarter of documents that are none can't move far,
    start; the documents within :data:`FAR` of them give a mean and covariance, and those
    within FAR of these the final ones. No judgement on single texts enters, so
    outliers and wrong language labels are left out by their distance alone.
    """
    every = _sums(stats, lambda g, x: np.ones(len(x), dtype=bool))
    n = sum(v[0] for v in every.values())
    mean = sum((v[1] for v in every.values()), np.zeros(len(STATS))) / max(n, 1)
    spread = np.maximum(sum((np.diag(v[2]) for v in every.values()), np.zeros(len(STATS))) / max(n, 1) - mean**2, 0)
    quartiles = _quartiles(stats)
    usual = np.stack([RUNNING[:, 0] + z * RUNNING[:, 1] for z in (-0.6745, 0, 0.6745)])
    pooled = sum((m * q for m, q in quartiles.values()), PRIOR * usual) / (n + PRIOR)
    start = {g: (m * q + PRIOR * pooled) / (m + PRIOR) for g, (m, q) in quartiles.items()}
    ridge = RIDGE * spread + 1e-9

    def near(languages: list[str], x: np.ndarray) -> np.ndarray:
        names, out = np.array(languages), np.zeros(len(x), dtype=bool)
        for g in set(languages):
            low, middle, high = start.get(g, pooled)
            scale = ((high - low) / 1.349) ** 2 + ridge
            out[names == g] = (((x[names == g] - middle) ** 2) / scale).sum(axis=1) <= FAR
        return out

    first = Prose(_sums(stats, near), spread)
    return Prose(_sums(stats, lambda g, x: first.contributions(g, x).sum(axis=1) <= FAR), spread)


def outlierness(stats: DataFrame, prose: Prose) -> DataFrame:
    """(id, language, distance, <stat>, <stat>_part ...): distances with each statistic's part."""
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["stats"].to_numpy()) if len(b) else np.empty((0, len(STATS)))
            parts = prose.contributions(list(b["language"]), x)
            out = {"id": b["id"], "language": b["language"], "distance": np.sqrt(np.maximum(parts.sum(axis=1), 0))}
            out |= {s: x[:, i] for i, s in enumerate(STATS)} | {f"{s}_part": parts[:, i] for i, s in enumerate(STATS)}
            yield pd.DataFrame(out)

    columns = ", ".join([f"id {kind}", "language string", "distance double", *(f"{s} double" for s in STATS), *(f"{s}_part double" for s in STATS)])
    return stats.mapInPandas(run, columns)


def named_outliers(parts: np.ndarray) -> np.ndarray:
    """Kind of each row of parts that lies beyond FAR, else null: the one whose statistics have the greatest part in the distance."""
    speak = np.stack([parts[:, [STATS.index(s) for s in of]].sum(axis=1) for of in KIND_STATS.values()], axis=1)
    return np.where(parts.sum(axis=1) > FAR, np.array(list(KIND_STATS), dtype=object)[speak.argmax(axis=1)], None)


def outliers(stats: DataFrame, prose: Prose) -> DataFrame:
    """(id, kind): the documents beyond :data:`FAR` from their language's prose, each with its kind."""
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                kinds = named_outliers(prose.contributions(list(b["language"]), np.stack(b["stats"].to_numpy())))
                far = np.array([k is not None for k in kinds])
                yield pd.DataFrame({"id": b["id"].to_numpy()[far], "kind": kinds[far]})

    return stats.mapInPandas(run, f"id {kind}, kind string")


def no_prose(documents: DataFrame, id_col: str, text_col: str, stats: DataFrame, prose: Prose) -> DataFrame:
    """(id, kind): documents most of whose text is a list, a table or junk.

    A document beyond :data:`FAR` from its language's prose is an outlier; the kind is the one whose
    statistics have the greatest part in its distance, by sign. As prose can be unusual too (short, in capitals, with
    a table in it), an exact check of outliers follows: the lines that are entries, rows or noise must
    make up more than half of the text. Null and blank texts give no row; repeated rows one. ``stats`` comes from :func:`document_statistics`;
    ids are unique.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[sum(shares(plain_lines(t)).values()) > MOST for t in b["text"]], ["id", "kind"]]

    some = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return some.join(cut(outliers(stats, prose)), "id").mapInPandas(run, f"id {kind}, kind string").distinct()
