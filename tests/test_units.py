import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.decimals import shifted
from lodestrata.functions.units import plain, quantity, read_unit
from lodestrata.operators.units import conversions, declared_units, in_common_units, link_estimates, payload_presentations, payload_quantities, payload_sides, source_links


@pytest.mark.parametrize("label, common, power", [
    ("USD", "USD", 0), ("U.S. dollars", "USD", 0), ("ISO4217:usd", "USD", 0), ("iso4217:USD/xbrli:shares", "USD/shares", 0), ("USD per share", "USD/shares", 0),
    ("USDm", "USD", 6), ("kUSD", "USD", 3), ("T€", "EUR", 3), ("million yen", "JPY", 6), ("USD in millions", "USD", 6), ("US cents", "USD", -2), ("GBX", "GBP", -2),
    ("cents per share", "USD/shares", -2), ("shares (000s)", "shares", 3), ("bps", "pure", -4), ("%", "pure", -2), ("thousands of customers", "count", 3), ("百万円", "JPY", 6),
])
def test_labels(label, common, power):
    u = read_unit(label)
    assert (u.common, u.power) == (common, power)


@pytest.mark.parametrize("label", [None, "", "USD per year", "USD/EUR", "widgets", "shares and dollars and"])
def test_labels_that_are_no_unit(label):
    assert read_unit(label) is None


@pytest.mark.parametrize("record, want", [
    (("$562.9mm", "562.9", "USD", "USD", None), ("USD", "562900000")), (("8.000,5 Mio. €", None, None, None, None), ("EUR", "8000500000")), (("(680 pence)", "-680", "GBP", "GBP", None), ("GBP", "-6.8")),
    (("-約15.64億円", None, None, "JPY", None), ("JPY", "-1564000000")), (("Rs 13.15 crore", None, None, None, None), ("INR", "131500000")), (("1.283x", "12830", "basis points", None, None), ("pure", "1.283")),
    (("546 hours", None, None, None, None), ("days", "22.75")), (("over 544.1 million customers", None, None, None, None), ("count", "544100000")), (("$8,888K as of March 19, 2018", None, None, None, None), ("USD", "8888000")),
    (("−US$452.1 MM", None, None, None, None), ("USD", "-452100000")), (("$5", "5", None, "CAD", 0), ("CAD", "5")), (("see note 4", "7", "percent", None, None), ("pure", "0.07")), (("", "187", "USD", None, 3), ("USD", "187000")),
    (("688.7", "688.7", None, None, None), None), (("see note 4", None, "percent", None, None), None), ((None, None, None, None, None), None), (("low double digits", None, "USD", None, None), None),
])
def test_quantities(record, want):
    got = quantity(*record)
    assert (got and got[:2]) == want


def test_shift_matches_decimal(spark):
    r = random.Random(5)
    rows = [(f"{r.choice(['', '-'])}{r.randint(0, 10 ** r.randint(1, 30))}{r.choice(['', '.' + str(r.randint(0, 10 ** 9))])}", r.randint(-12, 12)) for _ in range(300)]
    rows += [("0", 3), ("-0.00", 1), ("1,234.5", 0), ("(7)", 2), (None, 1), ("x", 1), ("", 1), ("1", None)]
    got = [x[0] for x in spark.createDataFrame(rows, "v string, p int").select(shifted(F.col("v"), F.col("p"))).collect()]
    from lodestrata.functions.units import exact

    want = [plain(Decimal(v).scaleb(p, context=exact(v))) for v, p in rows[:300]] + ["0", "0", "1234.5", "-700", None, None, None, None]
    assert got == want


@pytest.mark.parametrize("task_links", [200_000, 0])
def test_unknown_unit_is_found_by_its_links(spark, monkeypatch, task_links):
    from lodestrata.operators import units

    monkeypatch.setattr(units, "TASK_LINKS", task_links)
    rows = [(f"k{i}", u, str(v), s) for i in range(1, 40) for u, v, s in (("USD", i * 1000 + 7, 0), ("zorkmids", i + 0.007, 0), ("kUSD", i + 0.007, 0), ("twice removed", (i + 0.007) / 1000, 0))]
    rows += [(f"m{i}", u, str(v), 0) for i in range(1, 9) for u, v in (("zorkmids", i), ("far", i * 100))] + [("n", None, "1", 0), ("n", "USD", None, 0), ("n", "USD", "0", None)]
    df = spark.createDataFrame(rows + rows[:4], "k string, unit string, value string, scale int")
    declared = declared_units(df)
    table = {r["label"]: r for r in conversions(declared, link_estimates(df, F.col("k"), "unit", "value", "scale", declared)).collect()}
    assert (table["USD"]["how"], table["kUSD"]["how"]) == ("literal", "confirmed")
    assert (table["zorkmids"]["how"], table["zorkmids"]["common_unit"], table["zorkmids"]["power"]) == ("estimated", "USD", 3)
    assert (table["twice removed"]["power"], table["far"]["power"]) == (6, 1)
    got = in_common_units(df, conversions(declared, link_estimates(df, F.col("k"), "unit", "value", "scale", declared))).where("k = 'k3' and unit = 'zorkmids'").first()
    assert got["common_value"] == "3007" and got["common_unit"] == "USD"


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, unit string, value string, scale int")
    declared = declared_units(df)
    assert in_common_units(df, conversions(declared, link_estimates(df, F.col("k"), "unit", "value", "scale", declared))).count() == 0
    sides = payload_sides(spark.createDataFrame([], "raw_value string, value string, unit string, currency string, scale int"))
    assert payload_quantities(sides, conversions(declared, link_estimates(df, F.col("k"), "unit", "value", "scale", declared))).count() == 0


def test_estimates_reach_the_end_of_a_long_chain(spark):
    chain = ["USD", "za", "zb", "zc", "zd", "ze", "zf"]
    rows = [(f"{j}-{i}", u, str(i * 10 ** (6 - j - n)), 0) for j in range(6) for i in range(1, 9) for n, u in enumerate(chain[j : j + 2])]
    df = spark.createDataFrame(rows, "k string, unit string, value string, scale int")
    declared = declared_units(df)
    got = {r["label"]: (r["common_unit"], r["power"]) for r in conversions(declared, link_estimates(df, F.col("k"), "unit", "value", "scale", declared)).collect()}
    assert got == {u: ("USD", n) for n, u in enumerate(chain)}


def test_long_numbers_in_odd_units_keep_every_digit(spark):
    """24 digits over 24 hours, times 7 days; quotients that don't end; never a null in the text."""
    from fractions import Fraction

    from lodestrata.functions.decimals import with_shifted
    from lodestrata.functions.units import Unit, to_common

    r = random.Random(8)
    rows = [(str(r.randint(0, 10 ** r.randint(1, 40))) + r.choice(["", ".5", ".25", ".000"]), r.randint(-6, 6), *r.choice([(1, 24), (7, 1), (1, 1440), (1, 1)])) for _ in range(150)]
    rows += [("240000000000000000000000", 0, 1, 24), ("0", 0, 1, 24), ("1e3", 0, 1, 1), ("(1,000)", -2, 1, 1), (" 12.50 ", 1, 1, 1), ("-0.00", 0, 1, 1), ("x", 0, 1, 24), (None, 0, 7, 1), ("1", None, 1, 1)]
    df = spark.createDataFrame(rows, "v string, p int, times int, over int")
    cols = [F.col("p"), F.col("times"), F.col("over")]
    got = [x[0] for x in df.select(shifted(F.col("v"), *cols)).collect()]
    assert got[:150] == [to_common(Decimal(v), Unit("days", 0, times, over), p) for v, p, times, over in rows[:150]]
    assert got[150:] == ["10000000000000000000000", "0", "1000", "-10", "125", "0", None, None, None]
    assert [x[0] for x in with_shifted(df, "out", "v", *cols).select("out").collect()] == got
    whole = [(Fraction(v) * times * Fraction(10) ** p / over, g) for (v, p, times, over), g in zip(rows[:150], got)]
    assert all(abs(Fraction(g) - w) <= Fraction(1, 10**8) for w, g in whole)


PAYLOADS = [
    ("$562.9mm", "562.9", "USD", "USD", None), ("8.000,5 Mio. €", None, None, None, None), ("(680 pence)", "-680", "GBP", "GBP", None), ("-約15.64億円", None, None, "JPY", None), ("1.283x", "12830", "basis points", None, None),
    ("546 hours", None, None, None, None), ("$5", "5", None, "CAD", 0), ("see note 4", "7", "percent", None, None), ("", "187", "USD", None, 3), ("688.7", "688.7", None, None, None), ("see note 4", None, "percent", None, None),
    (None, None, None, None, None), ("75 cents", None, None, "CAD", None), ("C$3 bn", "3", "USD", "CAD", 9), ("12", None, "widgets", "EUR", 2), ("9 widgets", "90", "widgets", None, 0), (None, "(1,500)", None, "gbp", None),
]


def test_payloads_convert_by_the_table_as_their_labels_read(spark):
    df = spark.createDataFrame([(str(i), *p) for i, p in enumerate(PAYLOADS)], "id string, raw_value string, value string, unit string, currency string, scale int")
    sides = payload_sides(df)
    declared = declared_units(sides.select(F.explode(F.array("raw_label", "col_label")).alias("unit")))
    got = {r["id"]: r["common_unit"] and (r["common_unit"], r["common_value"]) for r in payload_quantities(sides, conversions(declared, source_links(payload_presentations(sides, "id"), declared))).collect()}
    assert got == {str(i): (q := quantity(*p)) and q[:2] for i, p in enumerate(PAYLOADS)}
    assert got["6"] == ("CAD", "5") and got["12"] == ("CAD", "0.75") and got["13"] == ("CAD", "3000000000") and got["14"] == ("EUR", "1200")


def test_raw_words_that_dont_read_are_found_by_their_columns(spark):
    """Raw texts and columns are two sources: `gazillion` gets its power from the rows that have both; hours and weeks snap to days."""
    rows = [(f"a{i}", f"{i}.5 gazillion $", f"{i}.5", "USD", None, 8) for i in range(1, 9)] + [("only", "4 gazillion $", None, None, None, None)]
    rows += [(f"h{i}", f"{i * 12} stunden", str(i / 2), "days", None, 0) for i in range(1, 9)] + [("h", "30 stunden", None, None, None, None)]
    rows += [(f"n{i}", f"see note {i}", str(7 * i + i % 3), "percent", None, 0) for i in range(1, 9)]
    rows += [("once", "3 sixpacks", "18", "count", None, 0)]
    sides = payload_sides(spark.createDataFrame(rows, "id string, raw_value string, value string, unit string, currency string, scale int"))
    declared = declared_units(sides.select(F.explode(F.array("raw_label", "col_label")).alias("unit")))
    known = conversions(declared, source_links(payload_presentations(sides, "id"), declared))
    how = {r["label"]: (r["how"], r["common_unit"]) for r in known.collect()}
    assert how["gazillion $"] == ("estimated", "USD") and how["stunden"] == ("estimated", "days") and "see note" not in how
    got = {r["id"]: (r["common_unit"], r["common_value"]) for r in payload_quantities(sides, known).collect()}
    assert got["only"] == ("USD", "400000000") and got["h"] == ("days", "1.25") and got["n1"] == ("pure", "0.08") and got["once"] == ("count", "18")


def test_links_outvote_a_label_that_says_otherwise(spark):
    rows = [(f"k{i}", u, str(v), 0) for i in range(1, 20) for u, v in (("USD", i * 1000 + 7), ("USD in millions", i + 0.007))]
    df = spark.createDataFrame(rows, "k string, unit string, value string, scale int")
    declared = declared_units(df)
    row = conversions(declared, link_estimates(df, F.col("k"), "unit", "value", "scale", declared)).where("label = 'USD in millions'").first()
    assert (row["how"], row["power"], row["links"]) == ("estimated", 3, 19)
    few = df.where("k in ('k1', 'k2', 'k3')")
    row = conversions(declared, link_estimates(few, F.col("k"), "unit", "value", "scale", declared)).where("label = 'USD in millions'").first()
    assert (row["how"], row["power"]) == ("declared", 6)


@pytest.mark.parametrize("task_links", [200_000, 0])
def test_a_chain_of_ten_labels_converts(spark, monkeypatch, task_links):
    from lodestrata.operators import units

    monkeypatch.setattr(units, "TASK_LINKS", task_links)
    names = ["USD", *(f"label {chr(97 + i)}x" for i in range(10))]
    rows = [(f"{j}:{i}", u, str((i + 0.5) * 10 ** (12 - j - d)), 0) for j in range(10) for i in range(11) for d, u in ((0, names[j]), (1, names[j + 1]))]
    df = spark.createDataFrame(rows, "k string, unit string, value string, scale int")
    declared = declared_units(df)
    got = {r["label"]: r["power"] for r in conversions(declared, link_estimates(df, F.col("k"), "unit", "value", "scale", declared)).collect()}
    assert got == {n: i for i, n in enumerate(names)}
