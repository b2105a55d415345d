import random

import pytest

from lodestrata.llm.tokens import PATTERN, encode_corpus, encode_texts, load_bpe, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_same_ids_as_the_public_tokenizer(reference):
    r = random.Random(2)
    letters = "abcdefg hij éß€日本\n\t  0123456789.,!?😀‍ABC'st"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    texts += ["", None, "<|endoftext|>", "a" * 4000, " " * 3000, "ab" * 900, "\x00\x01", "it's we'll I'd", "=" * 777, "x" * 70 + "y"]
    got = encode_texts(load_bpe(vocabulary_path("byte_bpe_50k.tiktoken")), texts).to_pylist()
    assert got == [reference(t) if t else [] for t in texts]


def test_multilingual_vocabulary_against_its_own_merges():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Die Rückstellungen wurden überprüft.", "決算短信を公表した。", "Отчёт опубликован", "तिमाही", "x" * 300]
    assert encode_texts(load_bpe(path), texts).to_pylist() == [enc.encode_ordinary(t) for t in texts]


def test_every_document_has_a_row(spark):
    df = spark.createDataFrame([(1, "a b", "z"), (2, None, "z"), (3, "", "z"), (1, "a b", "z")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_corpus(df, "doc_id", "text", vocabulary_path("byte_bpe_50k.tiktoken")).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[2][1] == [] and got[3][1] == [] and len(got[0][1]) == 2
    assert encode_corpus(df.limit(0), "doc_id", "text", vocabulary_path("byte_bpe_50k.tiktoken")).count() == 0
