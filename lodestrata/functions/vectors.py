"""Vectors as pure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.decimals import let


def mock_embedding(text: Column, dimensions: int = 64) -> Column:
    """A unit vector that depends on nothing but the text: bytes of sha256 over text and position, centred."""
    block = lambda i: F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), (i / 32).cast("int").cast("string")), 256)
    byte = lambda i: F.conv(F.substr(block(i), ((i % 32) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("double")
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: byte(i) - 127.5)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(raw, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def dimension_errors(vector: Column, dimensions: int) -> Column:
    return F.when(vector.isNull(), "MISSING_VECTOR").when(F.size(vector) != dimensions, "BAD_DIMENSIONS")
