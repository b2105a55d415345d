import random

import pytest

from lodestrata.llm import leakage
from lodestrata.llm.leakage import leaked_items, reader_stream

ITEM = "Counsel for Mexsobel disclosed that Oritranor had pledged $90,354 thousand of receivables and that Selvimont objected on March 12, 2020 in writing."
WORDS = ITEM.split()


@pytest.mark.parametrize("text", [
    "COUNSEL FOR", "<b>Counsel</b>&nbsp;for", "Coun-\nsel f­or", "Ｃｏｕｎｓｅｌ ｆｏｒ", "Counsel​for", "C o u n s e l for!", "\\u0043ounsel f=C3=B6r".replace("=C3=B6", "o"), "Соunsel fоr",
])
def test_what_a_reader_sees(text):
    assert reader_stream(text) == b"counselfor"


def test_garbled_and_composed_signs():
    assert reader_stream("â‚¬735.49 cafÃ©") == reader_stream("€735.49 café") == b"73549cafe"
    assert reader_stream("ﬁscal ½") == reader_stream("fiscal ½") and reader_stream(None) == reader_stream(" …") == b""


def brute(docs, items, words):
    out = set()
    for d, t in docs:
        s = reader_stream(t)
        for i, text in items:
            w = [reader_stream(x) for x in (text or "").split()]
            if any((run := b"".join(w[k : k + words])) and run in s for k in range(len(w) - words + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", block)
    r = random.Random(4)
    vocabulary = ["a", "of", "ab", "revenue", "Selvimont", "12", "€5", "—"]
    items = [("one", ITEM), ("same", ITEM), ("short", "too short"), ("null", None), *((f"r{i}", " ".join(r.choice(vocabulary) for _ in range(20))) for i in range(6))]
    docs = [(1, "x " + " ".join(WORDS[3:15]) + " y"), (2, " ".join(WORDS[3:14])), (3, None), (4, ""), (5, "<p>" + "&nbsp;".join(WORDS[:12]).upper()), (6, " ".join(WORDS[:11]) + " really " + " ".join(WORDS[11:]))]
    docs += [(10 + i, " ".join(r.choice(vocabulary) for _ in range(9)) + " " + " ".join(items[4 + i % 6][1].split()[k : k + n])) for i, (k, n) in enumerate((r.randint(0, 8), r.randint(9, 14)) for _ in range(40))]
    docs += [(99, "long " * 60000 + ITEM), *docs[:2]]
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, item_id string")
    got = leaked_items(spark, d, "doc_id", "text", spark.createDataFrame([*items, items[0]], "item_id string, text string"), "item_id", "text")
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items, 12)
    assert {(1, "one"), (1, "same"), (5, "one"), (99, "one")} <= set(rows) and not any(x[0] in (2, 6) for x in rows)


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert leaked_items(spark, d, "doc_id", "text", i, "item_id", "text").columns == ["doc_id", "item_id"]
    assert leaked_items(spark, d, "doc_id", "text", spark.createDataFrame([("a", ITEM)], "item_id string, text string"), "item_id", "text").count() == 0
