import random

import pytest

from quire.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.vocabulary())


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


CASES = ["a\n b", "a \n b", "a\n\n b", "é\n b\n c", " \n ", "x\r\ny\x1cz\x85", "'s don't", "a\n\tb", "", " ", "<|endoftext|>", "日本語\n+ 変更", "x" * 5000, "🧪" * 300, "a\x00b", "​\xa0"]


def test_same_ids_as_another_engine(own, other):
    rng = random.Random(5)
    random_texts = ["".join(rng.choice(" \n\t\rab1é.-+\x1c　🧪") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for s in [*CASES, *random_texts]:
        assert list(own.ids(s)) == other.encode_ordinary(s), repr(s)
        assert own.count(s) == len(other.encode_ordinary(s))


def test_same_ids_as_the_json_vocabulary(own):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for s in CASES:
        assert list(own.ids(s)) == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_scan_and_heap_agree_and_ids_restore_the_bytes(own):
    word_of = {v: k for k, v in own.ranks.items()}
    rng = random.Random(7)
    for k in range(200):
        w = bytes(rng.choice(b"aab cdeft") if k % 2 else rng.randrange(256) for _ in range(rng.randrange(2, 300)))
        ids = own.scan(w)
        assert ids == own.queue(w)
        assert b"".join(word_of[i] for i in ids) == w


def test_words_kept_are_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    own.words.clear()
    own.count(" ".join(f"w{k}" for k in range(100)))
    assert len(own.words) <= 10


def test_operator(spark, rows):
    df = spark.createDataFrame([(1, "hello", [1]), (1, "hello", [1]), (2, "", None), (3, None, None), (4, " ", None), (5, "ab " * 100_000, None)], "doc_id bigint, text string, ids array<int>")
    out = bpe.encode(df, "doc_id")
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "array<int>"]
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[2] == [] and got[3] == [] and got[4] == [220] and got[1] == [31373]
    assert out.filter("doc_id = 1").count() == 2
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode(df.limit(0), "doc_id").count() == 0
