import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ingest as I
from lodestrata.sources import filings as S
from lodestrata.sources.html import parse, parse_documents, table_rows
from lodestrata.sources.stores import Manifest, append_new, put_raw

PAGE = """<html><head><title>x</title></head><body><h1>Report</h1><p>Opening <b>words</b>&nbsp;here.</p><h2>Part A</h2><p>Revenue was <ix:nonFraction name="us-gaap:Revenues" contextRef="c1" unitRef="usd" scale="6" format="ixt:num-dot-decimal">1,234.5</ix:nonFraction> million.</p>
<table><caption>Sales</caption><tr><th>metric</th><th>now</th></tr><tr><td>revenue</td><td>(5)</td></tr></table><h2>Part B</h2><p>End <ix:nonFraction name="x:Nil" contextRef="c1"></ix:nonFraction></p><script>no()</script></body></html>"""


def test_html_text_sections_spans_tables_facts():
    r = parse(PAGE)
    assert [(s[3], s[4], s[2]) for s in r["sections"]] == [("Report", ["Report"], None), ("Part A", ["Report", "Part A"], 0), ("Part B", ["Report", "Part B"], 0)]
    assert all(r["text"][a:b] == words for _, a, b, words in r["spans"])
    assert r["sections"][0][6] == r["sections"][1][5] and r["sections"][-1][6] == len(r["text"])
    assert r["tables"] == [(0, 1, "Sales", ["metric", "now"], [["revenue", "(5)"]])]
    fact = r["facts"][0]
    assert r["text"][fact[8] : fact[9]] == "1,234.5" and r["diagnostics"] == ["NIL_OR_EMPTY_FACT"]
    assert "no()" not in r["text"]


def test_html_frame_with_empty_and_broken_documents(spark):
    df = spark.createDataFrame([(1, PAGE, "a"), (2, None, "a"), (3, "", "a"), (4, "<p>open <table><tr><td>x", "a")], "id long, html string, text string")
    got = {r["id"]: r for r in parse_documents(df, "id", "html").collect()}
    assert got[2]["diagnostics"] == ["EMPTY_DOCUMENT"] and got[3]["text"] is None and got[4]["text"].startswith("open")
    assert [tuple(r) for r in table_rows(parse_documents(df, "id", "html"), "id").collect()] == [(1, 0, 0, ["revenue", "(5)"])]


@pytest.mark.parametrize("raw, form, sign, scale, want, code", [
    ("1,234.5", "ixt:num-dot-decimal", None, "6", "1234500000", None), ("1.234,5", "ixt:num-comma-decimal", None, "0", "1234.5", None), ("(12)", None, None, None, "-12", None), ("12", None, "-", "3", "-12000", None),
    ("—", None, None, "6", "0", None), ("nil", None, None, "0", None, "BAD_NUMBER"), ("5", "ixt:date-month", None, "0", None, "UNKNOWN_FORMAT"), (None, None, None, None, None, "BAD_NUMBER"),
])
def test_inline_values(spark, raw, form, sign, scale, want, code):
    df = spark.createDataFrame([(raw, form, sign, scale)], "r string, f string, s string, c string")
    value, why = I.inline_value(F.col("r"), F.col("f"), F.col("s"), F.col("c"))
    assert tuple(df.select(value, why).first()) == (want, code)


def test_keys_first_seen_and_quarantine(spark):
    df = spark.createDataFrame([("d", "k", 1, "5", "a", None), ("d", "k", 2, "5", "b", None), ("d", "k", 3, "6", "c", "FACT_CONFLICT"), ("e", "k", 1, None, "z", None)], "doc string, key string, ord int, value string, id string, code string")
    got = {r["id"]: (r["canonical_id"], r["is_first"], r["conflict"]) for r in I.first_seen(df, "doc", "key", "ord", "value", "id").collect()}
    assert got == {"a": ("a", True, False), "b": ("a", False, False), "c": ("a", False, True), "z": ("z", True, False)}
    good, bad = I.split_quarantine(df, "doc", "code")
    assert [r["doc"] for r in good.collect()] == ["e"] and [tuple(r) for r in bad.collect()] == [("d", ["FACT_CONFLICT"])]
    key, ok = I.job_key(F.col("doc"), F.col("key"))
    assert [tuple(r) for r in df.select(ok, key.isNotNull()).distinct().collect()] == [(True, True)]


def test_submissions_and_company_facts(spark, tmp_path):
    sub = {"cik": "1234", "name": "N", "tickers": ["N"], "filings": {"recent": {"accessionNumber": ["9-1", "9-2"], "form": ["10-K", "8-K"], "filingDate": ["2024-01-02", "soon"], "primaryDocument": ["a.htm", "b.htm"]}}}
    (tmp_path / "s.json").write_text(json.dumps(sub))
    got = S.filing_list(S.read_json(spark, str(tmp_path / "s.json"), S.SUBMISSIONS)).collect()
    assert [(r["cik"], r["form"], r["filed_on"], r["bad_date"]) for r in got] == [("0000001234", "10-K", date(2024, 1, 2), False), ("0000001234", "8-K", None, True)]
    facts = {"cik": 7, "entityName": "E", "facts": {"us-gaap": {"Revenues": {"label": "R", "description": None, "units": {"USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 12345678901234567890.5, "accn": "9-1", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-01-02"}, {"end": "2023-12-31", "val": "NaN", "accn": "9-1"}]}}}}}
    (tmp_path / "f.json").write_text(json.dumps(facts).replace("1.2345678901234567e+19", "12345678901234567890.5"))
    rows = S.company_observations(S.read_json(spark, str(tmp_path / "f.json"), S.COMPANY_FACTS)).collect()
    assert [(r["period_type"], r["value"], r["code"]) for r in rows] == [("duration", "12345678901234567890.5", None), ("instant", "NaN", "NON_FINITE_OR_TEXT")]


def test_vintages_and_bars(spark):
    v = [("g", date(2026, 4, 10), date(2026, 4, 1), "310.0"), ("g", date(2026, 5, 15), date(2026, 5, 1), "311.0"), ("g", date(2026, 5, 15), date(2026, 4, 1), "312.4"), ("g", date(2026, 5, 15), date(2026, 3, 1), "."), ("g", date(2026, 6, 2), date(2026, 5, 1), "311.5")]
    df = spark.createDataFrame(v, "series_id string, published_on date, observed_on date, value string")
    at = lambda d: sorted((r["observed_on"].month, r["value"]) for r in S.series_known(df, F.lit(d).cast("date")).collect())
    assert at("2026-05-14") == [(4, Decimal("310"))] and at("2026-05-15") == [(4, Decimal("312.4")), (5, Decimal("311"))]
    b = [("t", date(2026, 1, 2), 1.0, 5, 0.0, 1.0), ("t", date(2026, 1, 3), 1.0, None, 0.0, 1.0), ("t", date(2026, 1, 4), 0.0, 1, 0.0, 1.0), ("t", date(2026, 2, 1), 1.0, 1, 0.0, 1.0), ("t", date(2026, 1, 5), 1.0, 1, 0.0, 1.0), ("t", date(2026, 1, 5), 1.0, 1, 0.0, 1.0)]
    bars = spark.createDataFrame(b, "ticker string, day date, adjusted_close double, volume long, dividend double, split_factor double")
    codes = [r["code"] for r in S.daily_bars(bars, F.lit("2026-01-01").cast("date"), F.lit("2026-01-31").cast("date")).orderBy("day").collect()]
    assert codes == [None, "MISSING_FIELD", "BAD_PRICE", "DUPLICATE_DAY", "DUPLICATE_DAY"]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "accession string, content string")
    assert put_raw(df, path, "accession").count() == 0
    assert [r["accession"] for r in put_raw(spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w")], "accession string, content string"), path, "accession").collect()] == ["b"]
    assert spark.read.parquet(path).count() == 3
    append_new(df.withColumn("n", F.lit(1)), str(tmp_path / "t"), ["accession"])
    append_new(df.withColumn("n", F.lit(2)), str(tmp_path / "t"), ["accession"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    m = Manifest(spark, f"file://{tmp_path}/m")
    v1 = m.write(df, {"corpus": "1"})
    assert m.active() is None and m.write(df, {"corpus": "1"}) == v1
    m.publish(v1, None)
    assert m.read().count() == 2
    with pytest.raises(RuntimeError):
        m.publish(m.write(df, {"corpus": "2"}), None)


@pytest.mark.parametrize("junk", ["<![ yq^c@]: !", "<![", "<![]", "<![*xs|j; hcnm", "<![İf x", "<![cdatum[ x", "<![if", "<![CDATA[ x"])
def test_html_junk_that_begins_like_a_marked_section(spark, junk):
    table = "<table><tr><td>a</td><td>b</td></tr></table>"
    r = parse(f"one {junk} > two {table} three {junk}")
    assert [t[4] for t in r["tables"]] == [[["a", "b"]]]
    assert r["text"].startswith("one") and r["text"].endswith(f"two\na b\nthree {junk}")
    docs = spark.createDataFrame([(1, f"{table} {junk}"), (2, table)], "doc_id long, html string")
    assert sorted(x["doc_id"] for x in table_rows(parse_documents(docs, "doc_id", "html"), "doc_id").collect()) == [1, 2]
