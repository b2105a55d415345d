"""Identifiers that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX32 = "^[0-9a-f]{32}$"
USUAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid_key(c: Column) -> Column:
    """Comparable form of a UUID: 32 lower-case hex digits.

    Blanks around it, ``urn:uuid:``, braces, hyphens and case don't matter. Null and blank
    give null. What is no UUID keeps its trimmed lower-case spelling, so that two such
    strings still compare as text.
    """
    # nearly all are spelled in the usual way, which one test and no rewriting settles
    low = F.lower(F.trim(F.regexp_replace(c, r"[\p{Z}\s]+", " ")))
    bare = F.regexp_replace(low, r"^urn:uuid:|[-{} ]", "")
    return F.when(c.rlike(USUAL), F.translate(c, "-", "")).when(bare.rlike(HEX32), bare).otherwise(F.when(low != "", low))


def uuid_text(key: Column) -> Column:
    """The hyphenated spelling of a key made by :func:`uuid_key`; other keys stay as they are."""
    cut = [F.substring(key, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(key.rlike(HEX32), F.concat_ws("-", *cut)).otherwise(key)


def packed(key: Column) -> Column:
    """A key made by :func:`uuid_key` in 16 bytes; other keys behind 17 zero bytes. Order is kept among UUIDs."""
    return F.coalesce(F.when(F.length(key) == 32, F.unhex(key)), F.concat(F.unhex(F.lit("00" * 17)), F.encode(key, "UTF-8")))


def unpacked(b: Column) -> Column:
    """The key :func:`packed` was made of."""
    return F.when(F.octet_length(b) == 16, F.lower(F.hex(b))).otherwise(F.decode(F.substring(b, 18, 1 << 30), "UTF-8"))


def accession_key(c: Column) -> Column:
    """An accession compares by its digits; null where it has none."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(digits != "", digits)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of ``name`` under a namespace given as 32 hex digits, without a UDF."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)), 2, "0"))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12),
    )
