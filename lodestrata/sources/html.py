"""Filings in HTML with inline facts: canonical text, sections, spans, tables and raw facts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSED = (
    "text string, sections array<struct<ord int, level int, parent int, heading string, heading_path array<string>, start_char int, end_char int>>, "
    "spans array<struct<section int, start_char int, end_char int, content string>>, "
    "tables array<struct<ord int, section int, caption string, headers array<string>, rows array<array<string>>>>, "
    "facts array<struct<concept string, context string, unit string, scale string, sign string, format string, raw string, nil boolean, start_char int, end_char int>>, "
    "contexts array<struct<id string, entity string, instant string, start string, end string, dimensions map<string,string>>>, units array<struct<id string, measure string>>, diagnostics array<string>"
)
#: Elements whose text belongs to a context or unit; they stand in the header, which isn't shown.
TOLD = {"instant", "startdate", "enddate", "identifier", "explicitmember", "typedmember", "measure"}
BLOCKS = {"p", "div", "li", "tr", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "br", "table", "section", "article", "ul", "ol"}
HIDDEN = {"script", "style", "head", "ix:header"}
#: Marked sections that the library reads; at any other it raises an error.
MARKED = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.I | re.A)


class _Reader(HTMLParser):
    """One pass over a document. Text blocks are parted by line feeds; offsets count code points."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.size = [], 0
        self.block, self.block_start = [], 0
        self.heads, self.spans, self.tables, self.facts, self.notes = [], [], [], [], []
        self.hidden, self.level, self.open_facts, self.table = 0, 0, [], []
        self.cell: list[str] | None = None
        self.contexts, self.units = [], []
        self.context: dict | None = None
        self.unit: dict | None = None
        self.told: list[str] | None = None

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What only looks like a marked section is a comment up to the next ``>``, as in HTML; without one it is text."""
        return super().parse_marked_section(i, report) if MARKED.match(self.rawdata, i) else self.parse_bogus_comment(i, report)

    def close_block(self) -> None:
        words = " ".join("".join(self.block).split())
        self.block = []
        if not words:
            return
        start = self.size + (1 if self.size else 0)
        self.text.append(words)
        self.size = start + len(words)
        if self.level:
            self.heads.append((self.level, words, start))
        self.spans.append((len(self.heads) - 1, start, self.size, words))
        for f in self.facts:
            if f["start_char"] is None and f["raw"] is not None:
                at = words.find(" ".join(f["raw"].split()))
                if at >= 0:
                    f["start_char"], f["end_char"] = start + at, start + at + len(" ".join(f["raw"].split()))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        name = tag.rsplit(":", 1)[-1]
        if name == "context" and ":" in tag:
            self.context = {"id": a.get("id"), "entity": None, "instant": None, "start": None, "end": None, "dimensions": {}}
        elif name == "unit" and ":" in tag:
            self.unit = {"id": a.get("id"), "above": [], "below": [], "under": False}
        elif name == "unitdenominator" and self.unit:
            self.unit["under"] = True
        elif name in TOLD and (self.context or self.unit):
            self.told, self.dimension = [], a.get("dimension")
        if tag in BLOCKS:
            self.close_block()
        if re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
        elif tag == "table":
            self.table.append({"section": len(self.heads) - 1, "caption": None, "headers": [], "rows": [], "row": None, "td": False})
            if len(self.table) > 1:
                self.notes.append("NESTED_TABLE")
        elif tag == "tr" and self.table:
            self.table[-1] |= {"row": [], "td": False}
        elif tag in ("td", "th", "caption") and self.table:
            self.cell = []
            self.table[-1]["td"] |= tag == "td"
        elif tag in ("ix:nonfraction", "ix:nonnumeric"):
            self.open_facts.append({"concept": a.get("name"), "context": a.get("contextref"), "unit": a.get("unitref"), "scale": a.get("scale"), "sign": a.get("sign"), "format": a.get("format"), "raw": None, "nil": a.get("xsi:nil") == "true", "start_char": None, "end_char": None, "parts": []})

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        name = tag.rsplit(":", 1)[-1]
        if name in TOLD and self.told is not None:
            words, self.told = "".join(self.told).strip(), None
            if name == "measure" and self.unit:
                self.unit["below" if self.unit["under"] else "above"].append(words)
            elif self.context and name in ("explicitmember", "typedmember"):
                self.context["dimensions"][self.dimension or ""] = words
            elif self.context:
                self.context[{"identifier": "entity", "startdate": "start", "enddate": "end"}.get(name, name)] = words
        elif name == "context" and self.context:
            self.contexts.append(self.context)
            self.context = None
        elif name == "unit" and self.unit:
            measure = "*".join(self.unit["above"]) + ("/" + "*".join(self.unit["below"]) if self.unit["below"] else "")
            self.units.append({"id": self.unit["id"], "measure": measure})
            self.unit = None
        if tag in ("ix:nonfraction", "ix:nonnumeric") and self.open_facts:
            f = self.open_facts.pop()
            f["raw"] = "".join(f.pop("parts")).strip() or None
            if f["raw"] is None:
                self.notes.append("NIL_OR_EMPTY_FACT")
            self.facts.append(f)
        if tag in ("td", "th", "caption") and self.table and self.cell is not None:
            words = " ".join("".join(self.cell).split())
            if tag == "caption":
                self.table[-1]["caption"] = words
            elif self.table[-1]["row"] is not None:
                self.table[-1]["row"].append(words)
            self.cell = None
            self.block.append(" ")
        if tag == "tr" and self.table and self.table[-1]["row"] is not None:
            t = self.table[-1]
            if t["row"]:
                if not t["td"] and not t["headers"] and not t["rows"]:
                    t["headers"] = t["row"]
                else:
                    t["rows"].append(t["row"])
            t["row"] = None
        if tag == "table" and self.table:
            self.close_block()
            t = self.table.pop()
            self.tables.append((t["section"], t["caption"], t["headers"], t["rows"]))
        if tag in BLOCKS:
            self.close_block()
        if re.fullmatch("h[1-6]", tag):
            self.level = 0

    def handle_data(self, data: str) -> None:
        if self.told is not None:
            self.told.append(data)
            return
        if self.hidden:
            return
        self.block.append(data)
        if self.cell is not None:
            self.cell.append(data)
        for f in self.open_facts:
            f["parts"].append(data)


def parse(markup: str | None) -> dict:
    """All that one document holds; a null or empty one holds nothing and says so."""
    r = _Reader()
    if not markup or not markup.strip():
        return {"text": None, "sections": [], "spans": [], "tables": [], "facts": [], "contexts": [], "units": [], "diagnostics": ["EMPTY_DOCUMENT"]}
    r.feed(markup)
    r.close()
    r.close_block()
    sections, stack = [], []
    for i, (level, heading, start) in enumerate(r.heads):
        while stack and stack[-1][0] >= level:
            stack.pop()
        path = [*(h for _, h, _ in stack), heading]
        end = r.heads[i + 1][2] if i + 1 < len(r.heads) else r.size
        sections.append((i, level, stack[-1][2] if stack else None, heading, path, start, end))
        stack.append((level, heading, i))
    facts = [tuple(f[k] for k in ("concept", "context", "unit", "scale", "sign", "format", "raw", "nil", "start_char", "end_char")) for f in r.facts]
    return {"text": "\n".join(r.text), "sections": sections, "spans": r.spans, "tables": [(i, *t) for i, t in enumerate(r.tables)], "facts": facts, "contexts": r.contexts, "units": r.units, "diagnostics": sorted(set(r.notes))}


def parse_documents(documents: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text, sections, spans, tables, facts, contexts, units, diagnostics), one row per document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["text", "sections", "spans", "tables", "facts", "contexts", "units", "diagnostics"]
        for b in batches:
            rows = [parse(x) for x in b[html_col]]
            keyed = {
                "sections": ("ord", "level", "parent", "heading", "heading_path", "start_char", "end_char"), "spans": ("section", "start_char", "end_char", "content"),
                "tables": ("ord", "section", "caption", "headers", "rows"), "facts": ("concept", "context", "unit", "scale", "sign", "format", "raw", "nil", "start_char", "end_char"),
            }
            out = {id_col: list(b[id_col])}
            for n in names:
                out[n] = [[dict(zip(keyed[n], x)) for x in r[n]] if n in keyed else r[n] for r in rows]
            yield pd.DataFrame(out)

    return documents.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, {PARSED}")


def table_rows(parsed: DataFrame, id_col: str) -> DataFrame:
    """(id, table, row, cells) of the tables of parsed documents."""
    t = parsed.select(id_col, F.explode("tables").alias("t"))
    return t.select(id_col, F.col("t.ord").alias("table"), F.posexplode("t.rows").alias("row", "cells"))
