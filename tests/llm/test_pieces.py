import random

import pytest

from lodestrata.llm.pieces import finest_needed, passage_boundaries, passage_pieces, split


@pytest.mark.parametrize("text, want", [
    ("a" * 60 + "\n \t\n" + "b" * 60, "paragraph"), ("a" * 60 + "\r\n" + "b" * 60, "line"), ("a" * 60 + '." ' + "b" * 60, "sentence"), ("a" * 60 + ".x " + "b" * 60, "word"), ("a" * 120, "none"),
    (" " * 200, "paragraph"), ("x" + " " * 200 + "y", "word"), ("a" * 100 + "   ", "paragraph"), ("a" * 101 + "   ", "none"),
])
def test_finest_boundary_needed(text, want):
    assert finest_needed(text, 100) == want


def test_pieces_cover_the_text_and_overlap():
    r = random.Random(1)
    for n in (0, 1, 99, 100, 101, 500, 5000):
        text = "".join(r.choice(["a", "b", "é", " ", ". ", "\n", "\n\n", "ccccccccc"]) for _ in range(n))
        got = split(text, 100, 10)
        assert all(e - s <= 100 for s, e, _ in got)
        assert [s for s, _, _ in got] == ([0] if text else []) + [e - 10 for _, e, _ in got[:-1]]
        assert not text or got[-1][1] == len(text)
        assert not text or text == text[: got[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(got, got[1:]))


def test_sizes_of_tokens_bound_the_pieces():
    sizes = [3 if i % 7 == 0 else 0 for i in range(300)]
    assert all(sum(sizes[s:e]) <= 12 for s, e, _ in split("word " * 60, 12, 3, sizes))
    with pytest.raises(ValueError):
        split("x", 10, 10)


def test_tables_with_nulls_repeats_and_clashing_names(spark):
    rows = [("a", 5, "x" * 50 + "\n" + "y" * 80, 1, "t"), ("b", None, None, 1, "t"), ("c", 0, "", 1, "t"), ("d", None, "short", 1, "t")]
    df = spark.createDataFrame(rows + rows[:1], "sid string, base int, body string, piece int, text string")
    assert passage_boundaries(df, "sid", "body", 100).collect() == [("a", "line")]
    got = sorted(tuple(r) for r in passage_pieces(df, "sid", "body", "base", 100, 10).collect())
    assert [g[:5] for g in got] == [("a", 0, 5, 56, "line"), ("a", 1, 46, 136, "end"), ("d", 0, 0, 5, "end")]
    assert passage_boundaries(df.limit(0), "sid", "body", 100).count() == 0


def test_boundary_arrays_match_patterns():
    import re

    from lodestrata.llm.pieces import Offsets

    brk, blank = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])", r"[^\S\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    r = random.Random(7)
    for _ in range(500):
        text = "".join(r.choice(["a", "é", ". ", ".", "\n", "\r\n", "\r", "\n \n", '." ', ") ", " ", " ", "😀", "!\n"]) for _ in range(r.randint(0, 40)))
        marks = {k: v.tolist() for k, v in Offsets(text).marks.items()}
        assert marks["paragraph"] == [m.end() for m in re.finditer(f"{brk}(?!(?<=\r)\n)(?:{blank}*{brk}(?!(?<=\r)\n))+", text)]
        assert marks["line"] == [m.end() for m in re.finditer(brk, text)]
        assert marks["word"] == [m.end() for m in re.finditer(r"\s+", text)]
        assert marks["sentence"] == [m.end() for m in re.finditer(r"\s+", text) if re.search(r"[.!?]['\"’”»)\]}›]*$", text[: m.start()])]
