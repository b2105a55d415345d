"""Evaluation passages that appear, wholly or partly, in training texts."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.tables import cut

#: Length of a shingle in bytes of the letters-and-digits stream.
SHINGLE = 16
#: Evaluation items looked for in one pass over the corpus.
BLOCK_ITEMS = 4096
#: Bits of the filter for each shingle looked for; most shingles of the corpus fail it before the exact look-up.
FILTER_LOAD = 16
#: Bytes of streams that are hashed at once.
CHUNK = 1 << 20

TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
UPPER_ENTITY = re.compile(r"&(?:NBSP|AMP|LT|GT|QUOT|APOS|SHY|ENSP|EMSP|THINSP|ZWNJ|ZWJ|NDASH|MDASH|HELLIP|EURO|POUND|YEN);")  # in texts put in capitals
QUOTED = re.compile(r"(?:=[89A-F][0-9A-F]){2,}")
ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
PERCENT = re.compile(r"(?:(?<![0-9])%20|(?:%[89A-Fa-f][0-9A-Fa-f]){2,})")
#: Two or more signs that UTF-8 bytes make when they are read as a one-byte Western encoding.
GARBLED = re.compile("[Â-ô](?:[\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]){1,3}")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("авеорсухіјѕԁһμονρτικα", "abeopcyxijsdhuovptika")
KEEP_ASCII = bytes(c for c in range(128) if not chr(c).isalnum())


def _regarbled(m: re.Match) -> str:
    raw = bytearray()
    for ch in m[0]:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return m[0]
            raw.append(ord(ch))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def reader_stream(text: str | None) -> bytes:
    """The letters and digits a reader sees, in UTF-8, and nothing else.

    Markup is taken out, entities and other ways to encode a character are undone
    (escapes, UTF-8 read as a Western encoding, ligatures, wide forms, composed accents),
    then case, accents, punctuation and all white space go. Null gives an empty stream.
    """
    if not text:
        return b""
    if "<" in text:
        text = TAG.sub("", text)
    if "&" in text:
        text = html.unescape(html.unescape(UPPER_ENTITY.sub(lambda m: m[0].lower(), text)))
    if "=" in text:
        text = QUOTED.sub(lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "ignore"), text)
    if "%" in text:
        text = PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "ignore"), text)
    if "\\u" in text:
        text = ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    if not text.isascii():
        if GARBLED.search(text):
            text = GARBLED.sub(_regarbled, text)
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold()).translate(LOOKALIKES)
        if not text.isascii():
            text = "".join(filter(str.isalnum, text))
            return text.encode("utf-8", "ignore").translate(None, KEEP_ASCII)
    return text.encode("ascii").lower().translate(None, KEEP_ASCII)


def shingle_hashes(stream: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SHINGLE bytes from each offset (four doublings of a polynomial)."""
    h = stream.astype(np.uint64) + np.uint64(1)
    base, width = 0x9E3779B97F4A7C15, 1
    while width < SHINGLE:
        if len(h) <= width:
            return np.empty(0, dtype=np.uint64)
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), width * 2
    return h


class Window(NamedTuple):
    item: int
    text: bytes
    offset: int  # of the shingle that stands for it


class Block(NamedTuple):
    """A bounded set of items, made ready for a pass over the corpus."""

    names: list[str]
    windows: dict[int, list[tuple[int, bytes]]]  # item -> (first byte, text) of each run of words
    streams: dict[int, bytes]
    hashes: np.ndarray  # sorted, of all shingles of the items
    short: list[tuple[int, bytes]]  # windows with fewer bytes than a shingle


def prepare(items: list[tuple[str, str]], words: int) -> Block:
    names, windows, streams, short, hashes = [], {}, {}, [], []
    for name, text in items:
        k = len(names)
        parts = [reader_stream(w) for w in (text or "").split()]
        ends = np.cumsum([0, *map(len, parts)])
        names.append(name)
        streams[k] = b"".join(parts)
        windows[k] = []
        for i in range(len(parts) - words + 1):
            a, b = int(ends[i]), int(ends[i + words])
            if b - a >= SHINGLE:
                windows[k].append((a, streams[k][a:b]))
            elif b > a:
                short.append((k, streams[k][a:b]))
        if windows[k]:
            hashes.append(shingle_hashes(np.frombuffer(streams[k], dtype=np.uint8)))
    return Block(names, windows, streams, np.unique(np.concatenate(hashes)) if hashes else np.empty(0, dtype=np.uint64), short)


def prefixes(block: Block, counts: np.ndarray) -> dict[int, list[Window]]:
    """hash -> windows: each window is represented by its rarest shingle in the corpus.

    A text that holds a window holds all of its shingles, so the necessary prefix of
    the window, ordered by rarity, is one shingle. A window with a shingle the corpus
    doesn't have at all can't be in it.
    """
    chosen: dict[int, list[Window]] = defaultdict(list)
    for k, found in block.windows.items():
        if not found:
            continue
        h = shingle_hashes(np.frombuffer(block.streams[k], dtype=np.uint8))
        rare = counts[np.searchsorted(block.hashes, h)]
        for a, text in found:
            i = a + int(np.argmin(rare[a : a + len(text) - SHINGLE + 1]))
            if rare[i] > 0:
                chosen[int(h[i])].append(Window(k, text, i - a))
    return dict(chosen)


class Lookup:
    """Positions of a chunk's shingles in a sorted array of hashes; others cost one bit test."""

    def __init__(self, hashes: np.ndarray):
        width = max(16, (max(1, len(hashes)) * FILTER_LOAD - 1).bit_length())
        self.hashes, self.shift = hashes, np.uint64(64 - width)
        self.bits = np.zeros(1 << width, dtype=bool)
        self.bits[hashes >> self.shift] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, indices into the hashes) of the shingles that are there."""
        maybe = np.flatnonzero(self.bits[h >> self.shift])
        if not len(maybe) or not len(self.hashes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.searchsorted(self.hashes, h[maybe])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h[maybe]
        return maybe[hit], at[hit]


def _chunks(streams: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first text, joined bytes, offset of each text) in chunks; texts are parted by NULs."""
    first, size, part = 0, 0, []
    for i, s in enumerate(streams):
        part.append(s)
        size += len(s) + SHINGLE
        if size > CHUNK or i == len(streams) - 1:
            starts = np.cumsum([0, *(len(x) + SHINGLE for x in part)])
            yield first, (b"\0" * SHINGLE).join(part) + b"\0" * SHINGLE, starts
            first, size, part = i + 1, 0, []


def stretches(streams: list[bytes], lookup: Lookup, least: int) -> list[tuple[int, bytes]]:
    """(text, part): the maximal parts of each stream all of whose shingles are looked for, of at least ``least`` bytes.

    A window that stands in a text lies wholly within such a part.
    """
    found = []
    for first, joined, starts in _chunks(streams):
        at, _ = lookup(shingle_hashes(np.frombuffer(joined, dtype=np.uint8)))
        if not len(at):
            continue
        breaks = np.flatnonzero(np.diff(at) > 1)
        begin, end = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + SHINGLE
        long = end - begin >= least
        docs = np.searchsorted(starts, begin[long], side="right") - 1 + first
        found += [(d, joined[a:b]) for d, a, b in zip(docs.tolist(), begin[long].tolist(), end[long].tolist())]
    return found


def leaks_in(streams: list[bytes], lookup: Lookup, chosen: dict[int, list[Window]]) -> set[tuple[int, int]]:
    """(text, item) pairs: at each hit the whole window is compared at the one place it can lie."""
    found: set[tuple[int, int]] = set()
    for first, joined, starts in _chunks(streams):
        at, which = lookup(shingle_hashes(np.frombuffer(joined, dtype=np.uint8)))
        docs = np.searchsorted(starts, at, side="right") - 1 + first
        for p, w, d in zip(at.tolist(), which.tolist(), docs.tolist()):
            for win in chosen[int(lookup.hashes[w])]:
                if (d, win.item) not in found and p >= win.offset and joined.startswith(win.text, p - win.offset):
                    found.add((d, win.item))
    return found


def _block_leaks(documents: DataFrame, doc_id: str, text: str, block: Block) -> DataFrame:
    kind = documents.schema[doc_id].dataType.simpleString()
    texts = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    least = min((len(t) for found in block.windows.values() for _, t in found), default=SHINGLE)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(block.hashes)
        for b in batches:
            streams = [reader_stream(t) for t in b.column(1).to_pylist()]
            rows = [(d, x, None) for d, x in stretches(streams, lookup, least)]
            rows += [(d, None, k) for k, x in block.short for d, s in enumerate(streams) if x in s]
            ids = b.column(0).take(pa.array([r[0] for r in rows], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], type=pa.binary()), pa.array([r[2] for r in rows], type=pa.int32())], names=["doc", "part", "short"])

    parts = cut(texts.mapInArrow(part, f"doc {kind}, part binary, short int"))
    long = parts.where("part is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, totals = Lookup(block.hashes), np.zeros(len(block.hashes), dtype=np.int64)
        for b in batches:
            for _, joined, _ in _chunks(b.column(0).to_pylist()):
                totals += np.bincount(lookup(shingle_hashes(np.frombuffer(joined, dtype=np.uint8)))[1], minlength=len(totals))
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[seen])], names=["shingle", "n"])

    counts = np.zeros(len(block.hashes), dtype=np.int64)
    for row in long.select("part").mapInArrow(count, "shingle int, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["shingle"]] = row["n"]
    chosen = prefixes(block, counts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(np.array(sorted(chosen), dtype=np.uint64))
        for b in batches:
            found = sorted(leaks_in(b.column(1).to_pylist(), lookup, chosen))
            ids = b.column(0).take(pa.array([d for d, _ in found], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([block.names[k] for _, k in found], type=pa.string())], names=["doc", "item_id"])

    found = long.select("doc", "part").mapInArrow(look, f"doc {kind}, item_id string")
    if block.short:
        names = F.array(*[F.lit(x) for x in block.names])
        found = found.unionByName(parts.where("short is not null").select("doc", F.get(names, F.col("short")).alias("item_id")))
    return found.distinct().withColumnRenamed("doc", doc_id)


def leaked_items(spark: SparkSession, documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12) -> DataFrame:
    """(doc_id, item_id) wherever a text holds at least ``words`` consecutive words of an item.

    Words stand between white space in the item; they are compared by the letters and
    digits a reader sees, wherever white space lies in the corpus text. A set join with
    prefix filter over shingles of SHINGLE bytes of that stream. One pass over all texts keeps
    the parts whose shingles all belong to items and which are as long as the shortest run of
    ``words`` words. Shingles are ordered by how often these parts have them; each run is
    looked up by its rarest one, and at each hit compared in full at the place the
    shingle's offset fixes.

    As blanks may be lost or set anew in the text, the edges of words there don't count: a
    text with "start of the ..." holds a run that begins "art of the ...".

    Items are taken in blocks of BLOCK_ITEMS, each sent to the workers and run against all
    rows; the corpus itself isn't shuffled. The parts kept are written (see ``plans.tables.cut``). Items with fewer words, or null, never match;
    null and empty texts hold nothing; repeated rows give one row.
    """
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    blocks = -(-items.count() // BLOCK_ITEMS)
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        block = prepare(sorted((r["item_id"], r["text"]) for r in rows), words)
        part = _block_leaks(documents, doc_id, text, block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.select(doc_id, F.lit("").alias("item_id")).where(F.lit(False))
    return out
