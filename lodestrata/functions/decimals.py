"""Exact decimal text: shifting by powers of ten without a width limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^([-+]?)([0-9]*)\.?([0-9]*)(?:[eE]([-+]?[0-9]{1,4}))?$"


def plain_number(c: Column) -> Column:
    """The number in a text with grouping commas, a Unicode minus or parentheses, else null."""
    t = F.translate(F.trim(c), "\u2212, \u00a0\u202f", "-")
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    return F.when(t.rlike(NUMBER) & t.rlike("[0-9]"), t)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _read(t: Column) -> Column:
    part = lambda i: F.regexp_extract(t, NUMBER, i)
    exponent = F.coalesce(F.regexp_replace(part(4), r"^\+", "").try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    return F.struct((part(1) == "-").alias("negative"), digits.alias("digits"), (exponent - F.length(part(3))).alias("power"))


def _write(r: Column) -> Column:
    digits, power = r["digits"], r["power"]

    def pointed(padded: Column) -> Column:
        rest = F.regexp_replace(F.right(padded, -power), "0+$", "")
        return F.concat(F.left(padded, F.length(padded) + power), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))

    number = F.when(power >= 0, F.concat(digits, F.repeat(F.lit("0"), power))).otherwise(let(F.lpad(digits, F.greatest(F.length(digits), 1 - power), F.lit("0")), pointed))
    return F.when(power.isNull(), F.lit(None).cast("string")).when(digits == "", F.lit("0")).otherwise(F.concat(F.when(r["negative"], F.lit("-")).otherwise(F.lit("")), number))


def _multiplied(digits: Column, times: Column) -> Column:
    """Digit text x a small whole number, at any length: digit by digit from the right, with a carry."""
    by = F.aggregate(
        F.reverse(F.split(digits, "")), F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("out")),
        lambda s, d: let(d.cast("bigint") * times + s["carry"], lambda n: F.struct(F.floor(n / 10).alias("carry"), F.concat((n % 10).cast("string"), s["out"]).alias("out"))),
    )
    return let(by, lambda r: F.concat(r["carry"].cast("string"), r["out"]))


def _divided(digits: Column, over: Column) -> Column:
    """Digit text / a small whole number, rounded half up, at any length: digit by digit from the left, with a remainder."""
    by = F.aggregate(
        F.split(digits, ""), F.struct(F.lit(0).cast("bigint").alias("rest"), F.lit("").alias("out")),
        lambda s, d: let(s["rest"] * 10 + d.cast("bigint"), lambda n: F.struct((n % over).alias("rest"), F.concat(s["out"], F.floor(n / over).cast("string")).alias("out"))),
    )
    rounded = let(by, lambda r: F.when(r["rest"] * 2 >= over, F.struct(r["out"].alias("out"), F.lit(1).alias("up"))).otherwise(F.struct(r["out"].alias("out"), F.lit(0).alias("up"))))
    carried = lambda t: F.aggregate(
        F.reverse(F.split(t["out"], "")), F.struct(t["up"].cast("bigint").alias("carry"), F.lit("").alias("out")),
        lambda s, d: let(d.cast("bigint") + s["carry"], lambda n: F.struct(F.floor(n / 10).alias("carry"), F.concat((n % 10).cast("string"), s["out"]).alias("out"))),
    )
    return let(rounded, lambda t: let(carried(t), lambda r: F.concat(r["carry"].cast("string"), r["out"])))


#: Places behind the last digit to which a quotient that doesn't end is rounded.
PLACES = 15


def shifted(c: Column, power: Column, times: Column | None = None, over: Column | None = None) -> Column:
    """``c`` x 10^power (x times / over) as plain decimal text without needless zeros.

    ``c`` is text as :func:`plain_number` takes it; null or unreadable gives null, and so
    does a null power. All is done on the digits, so no precision is lost at any
    length. ``times`` and ``over`` are small whole numbers; a quotient that doesn't end is
    rounded half up to the fifteenth place behind the last digit.
    """

    def scaled(r: Column) -> Column:
        p = r["power"] + power
        if times is None:
            return F.struct(r["negative"].alias("negative"), r["digits"].alias("digits"), p.alias("power"))
        odd = ((times != 1) | (over != 1)) & (r["digits"] != "")
        digits = F.regexp_replace(_divided(F.concat(_multiplied(r["digits"], times), F.lit("0" * PLACES)), over), "^0+", "")
        return F.struct(r["negative"].alias("negative"), F.when(odd, digits).otherwise(r["digits"]).alias("digits"), F.when(odd, p - PLACES).otherwise(p).alias("power"))

    return let(plain_number(c), lambda t: F.when(t.isNotNull(), let(_read(t), lambda r: let(scaled(r), _write))))


#: Numbers as nearly all are written: they are shifted by plain text functions, in generated code.
USUAL = "^-?[0-9]{1,30}([.][0-9]{1,30})?$"


def with_shifted(rows: DataFrame, name: str, value: str, power: Column, times: Column, over: Column) -> DataFrame:
    """``rows`` with the column ``name``: :func:`shifted` of ``value``, in projections that don't leave generated code for usual numbers."""
    usual = F.col("__raw").rlike(USUAL)
    plain = (F.col("__times") == 1) & (F.col("__over") == 1)
    out = rows.withColumns({"__raw": F.trim(value), "__power": power, "__times": times, "__over": over})
    dot = F.instr(F.col("__raw"), ".")
    places = F.when(dot > 0, F.length("__raw") - dot).otherwise(F.lit(0))
    out = out.withColumns({"__usual": usual & plain, "__down": F.col("__power") - places, "__digits": F.ltrim(F.translate("__raw", "-.", ""), F.lit("0"))})
    padded = F.lpad("__digits", F.greatest(F.length("__digits"), 1 - F.col("__down")), F.lit("0"))
    out = out.withColumn("__padded", F.when(F.col("__usual") & (F.col("__down") < 0), padded))
    whole, rest = F.left("__padded", F.length("__padded") + F.col("__down")), F.rtrim(F.right("__padded", -F.col("__down")), F.lit("0"))
    number = F.when(F.col("__down") >= 0, F.concat("__digits", F.repeat(F.lit("0"), F.col("__down")))).otherwise(F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit(""))))
    signed = F.when(F.col("__digits") == "", F.lit("0")).otherwise(F.concat(F.when(F.col("__raw").startswith("-"), F.lit("-")).otherwise(F.lit("")), number))
    fast = F.when(F.col("__power").isNotNull(), signed)
    slow = shifted(F.col(value), F.col("__power"), F.col("__times"), F.col("__over"))
    return out.withColumn(name, F.when(F.col("__usual"), fast).otherwise(slow)).drop("__raw", "__power", "__times", "__over", "__usual", "__down", "__digits", "__padded")
