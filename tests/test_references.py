from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.functions.ids import accession_key, uuid5, uuid_key, uuid_text
from lodestrata.operators.references import broken_references

T0 = datetime(2020, 1, 1)
hour = lambda n: T0 + timedelta(hours=n)
number = lambda n: f"{n:032x}"


def test_runs_late_and_deleted(spark):
    parents = [(number(n), hour(0), None) for n in range(4090, 4100)] + [(number(4094), hour(0), None)]
    parents += [(number(5000), hour(9), None), (number(5001), hour(0), hour(5)), ("odd", hour(0), None), (None, hour(0), None)]
    refs = [(f"r{n}", number(n), hour(1)) for n in (4089, 4090, 4096, 4099, 4100, 5001, 9999)]
    refs += [("late", number(5000), hour(8)), ("ok", number(5000), hour(9)), ("gone", number(5001), hour(5)), ("null", None, hour(1)), ("text", "odd", hour(1)), ("text2", "odder", hour(1)), ("no time", number(5001), None)]
    refs += refs[:3]
    got = broken_references(spark.createDataFrame(refs, "row_id string, key string, t timestamp"), spark.createDataFrame(parents, "key string, written timestamp, gone timestamp"))
    rows = got.collect()
    assert len(rows) == len(set(rows))
    assert {(r["row_id"], r["kind"]) for r in rows} == {("r4089", "missing"), ("r4100", "missing"), ("r9999", "missing"), ("late", "late"), ("gone", "deleted"), ("text2", "missing")}


def test_empty_tables(spark):
    refs, parents = "row_id string, key string, t timestamp", "key string, written timestamp, gone timestamp"
    assert broken_references(spark.createDataFrame([], refs), spark.createDataFrame([], parents)).count() == 0
    assert broken_references(spark.createDataFrame([("r", "k", T0)], refs), spark.createDataFrame([], parents)).count() == 1


def test_spellings_of_ids(spark):
    want = "67bce7074d7e5881849c553a79412272"
    forms = [want, "67BCE707-4D7E-5881-849C-553A79412272", " 67bce707-4d7e-5881-849c-553a79412272\t", "urn:uuid:67bce707-4d7e-5881-849c-553a79412272", "{67bce707-4d7e-5881-849c-553a79412272}", "", "  ", None, " X-1 "]
    got = spark.createDataFrame([(f,) for f in forms], "c string").select(uuid_key(F.col("c")).alias("k"), uuid_text(uuid_key(F.col("c"))).alias("t"), accession_key(F.col("c")).alias("a")).collect()
    assert [r["k"] for r in got] == [want] * 5 + [None] * 3 + ["x-1"]
    assert got[0]["t"] == "67bce707-4d7e-5881-849c-553a79412272" and got[5]["a"] is None


def test_uuid5_is_the_standard_one(spark):
    import uuid

    names = ["a", "", "é日本", "x" * 500]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(uuid5(uuid.NAMESPACE_URL.hex, F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
