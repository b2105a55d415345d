"""Encoding texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the pattern that splits a text before merging, as the vocabulary was made with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pairs a worker remembers before it starts afresh.
KEPT = 200_000


def vocabulary_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe(dict):
    """Words (as text) to tuples of token ids; a missing word is encoded and kept.

    ``ranks`` maps the bytes of tokens to ids, in the order in which they were merged.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        names = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.ids = names
        self.size = {i: len(t) for t, i in names.items()}
        self.trie = ahocorasick.Automaton()
        for t, i in names.items():
            self.trie.add_word(t, (len(t), i))
        self.trie.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for t, i in sorted(names.items(), key=lambda x: x[1]):
            self._learn(t, i)
        self.fits.clear()

    def _learn(self, t: str, i: int) -> None:
        """How a token came about: the two earlier tokens that stand side by side unmerged until then."""
        prefixes = [self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids]
        self.shorter[i] = prefixes[0] if prefixes else None
        self.parts[i] = (i, i)
        for a in prefixes:
            b = self.ids.get(t[self.size[a] :])
            if b is not None and a < i and b < i and self.beside(a, b):
                self.parts[i], self.merged[a, b] = (a, b), i
                break

    def beside(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay two tokens when the bytes of both are encoded together.

        They don't if somewhere along the seam an earlier merge would join the inner parts;
        the later of the two is taken apart until no part is left.
        """
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * KEPT:
                self.fits.clear()
            known = self.fits[a, b] = self._beside(a, b)
        return known

    def _beside(self, a: int, b: int) -> bool:
        """The pair test of the published backtracking encoding of byte pairs, with its seam walked from the outside in."""
        bound = None
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and (bound is None or joined < bound):
                return False
            inner_a, inner_b = self.parts[a][1], self.parts[b][0]
            if a > b:
                if inner_a != a:
                    bound, a = a, inner_a
                elif inner_b != b:
                    bound, b = b + 1, inner_b
                else:
                    return True
            elif inner_b != b:
                bound, b = b + 1, inner_b
            elif inner_a != a:
                bound, a = a, inner_a
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Longest matches first; where one doesn't fit the token before it, a shorter one, else back."""
        text = word.encode("utf-8").decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        n = len(text)
        longest: list[tuple[int, int]] = [(0, 0)] * n
        for end, found in self.trie.iter(text):
            at = end - found[0] + 1
            if found > longest[at]:
                longest[at] = found
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0][1]
        while at < n:
            before = out[-1] if out else None
            while token is not None and (dead[at + self.size[token]] or (before is not None and not self.beside(before, token))):
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += self.size[token]
                token = longest[at][1] if at < n else None
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.size[token]
        return tuple(out)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KEPT:
            self.clear()
        ids = self.encode_word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def load_bpe(path: str) -> ByteBpe:
    """A rank file (token in base64, blank, id) as an encoder, once per worker."""
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(t): int(i) for t, i in (x.split() for x in lines if x.strip())})


def encode_texts(bpe: ByteBpe, texts: list[str | None], split=regex.compile(PATTERN).findall) -> pa.ListArray:
    flat, ends = array("i"), [0]
    get = bpe.__getitem__
    for t in texts:
        if t:
            flat.extend(chain.from_iterable(map(get, split(t))))
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, dtype=np.int32)))


def encode_corpus(documents: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids) of every document: token ids of the whole text, no special tokens.

    Null and empty texts have an empty list; strings of special tokens in a text are ordinary
    text. Repeated rows stay repeated. ``path`` is a rank file all workers can read.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_texts(bpe, part.column(1).to_pylist())], names=[id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
