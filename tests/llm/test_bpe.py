import hashlib
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm.queries import WORD_VOCABULARY


@pytest.fixture(scope="module")
def own():
    with open(WORD_VOCABULARY, "rb") as f:
        return bpe.Tokenizer(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_VOCABULARY)


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    packed = own.encode(text)
    assert array("I", packed).tolist() == want
    assert own.decode(packed) == library.decode(want, skip_special_tokens=False)


CASES = ["", " ", "Don't we'll 'S", "ΑΣ Σ ΣΑ", "İı ẞ ﬁ", "é é", "a\x1cb\x85c d", "<|endoftext|>x<|startoftext|>", "<|endoftext|", "٣²Ⅷ 1234", "中文字 💩💩", "a" * 3000, "-=" * 900, "antheiros" * 500, "\x00\x01", "tab\tnew\nline"]


@pytest.mark.parametrize("text", CASES)
def test_cases(own, library, text):
    same(own, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(own, library, text):
    same(own, library, text)


def test_long_words_emit_early_and_stay_small(own, library):
    rng = random.Random(5)
    word = "".join(rng.choice("antheirosd") for _ in range(20_000))
    run, most, early = bpe.Encoder(own.v), 0, 0
    for c in word[:-1]:
        early += len(run.push(own.v.letters[ord(c)]))
        most = max(most, len(run.text))
    assert early > 1000 and most <= own.v.lookahead + 2 * own.v.longest
    same(own, library, word)


def test_pieces_of_long_texts(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    rng = random.Random(7)
    words = ["Don't", "ΑΣ", "e\u0301", "中文字", "-=" * 40, "antheiros" * 30, "<|endoftext|>", "\u0301x", "12345", "İstanbul"]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", "\u2003", "\n\n", "\x1c", ""]) for _ in range(rng.randrange(40)))
        same(own, library, text)
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.digests(text) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_text_machine():
    data = "aé中💩z".encode()
    for size in (1, 2, 3):
        m = bpe.TextMachine()
        out = "".join(m.push(data[i : i + size]) for i in range(0, len(data), size)) + m.finish()
        assert out == "aé中💩z"
    m = bpe.TextMachine()
    assert m.push(b"a\xf0\x9f") + m.finish() == "a�"


def test_columns(spark, library):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello world", 5), (3, "Hello world", 5)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_column(df, "doc_id", "text", WORD_VOCABULARY).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 2, 2] and rows[2] == rows[3] and rows[0][1:] == rows[1][1:]
    got = bpe.tokens_column(df, "doc_id", "text", WORD_VOCABULARY).where("doc_id = 3").first()
    assert got["ids"] == library.encode("Hello world", add_special_tokens=False).ids
    assert bpe.encode_column(df.limit(0), "doc_id", "text", WORD_VOCABULARY).count() == 0
