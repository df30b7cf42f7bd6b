"""Token counts against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from sigflow.llm import tokens
from sigflow.llm.queries import QUERIES
from sigflow.session import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "in", "the", " ", "  ", "\n", "▁", "é", "中", "\U0001f600", "</s>", "<unk>", "<0x41>", "t", "h", "e", "s", ".", ",", "\t", "0", "=", "-", "_", "\x00", "क", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return tokens.PieceCounter(PATH)


def test_counts_equal_the_library(library, counter):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("=-_*/# ") * rng.randint(1, 40) for _ in range(rng.randint(0, 9))) for _ in range(1000)]
    texts += ["", " ", "a" * 5000, " " * 3000, "the" * 4000, "\n" * 700]
    assert counter.tokens(texts).tolist() == [len(x) for x in library.encode(texts)]


def test_rounds_alone_are_right_where_they_say_so(library, counter):
    """Words that the rounds do not hand over get the library's count from the rounds."""
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choice("abceinorst=-") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["▁" * k for k in range(2, 40)]


    out, redo = counter._rounds(words, np.array([len(w) for w in words]))
    named = set(redo.tolist())
    assert len(named) < len(words) // 2
    want = [len(library.encode(w[1:])) for w in words]
    assert [n for k, n in enumerate(out.tolist()) if k not in named] == [n for k, n in enumerate(want) if k not in named]
    assert all(counter._one(w) == n for w, n in zip(words, want))


def test_a_full_memory_gives_the_same_counts(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 20)
    c = tokens.PieceCounter(PATH)
    texts = [f"word{k % 37} and {k}" for k in range(200)]
    for k in range(0, 200, 10):
        assert c.tokens(texts[k : k + 10]).tolist() == [len(x) for x in library.encode(texts[k : k + 10])]
    assert len(c.seen) <= 20


def test_other_models_are_refused():
    with pytest.raises(Exception):
        tokens.PieceCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_edges(spark, library):
    texts = [None, "", " ", "word " * 5000, "é\x1c", "x" * 30000]
    df = spark.createDataFrame([(k, t, 1, True) for k, t in enumerate(texts)] * 2 + [(None, "no id", 1, True)], "doc_id long, text string, n_tokens int, over_limit boolean")
    got = sorted(tuple(r) for r in tokens.token_counts(df, PATH).collect())
    assert got == sorted([(k, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for k, t in enumerate(texts)] * 2)
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_query_on_the_table(spark, library):
    at = "/root/testdata/sf0.001"
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in table(spark, at, "documents").collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op12_token_counts"](spark, at).collect()} == want
