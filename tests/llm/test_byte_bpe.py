import hashlib

import public_tokenizers
import pytest

from shelfloom.llm import byte_bpe as B
from tests.llm.helpers import documents, words

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return B.Codec.of(PATH, PATTERN)


SAMPLES = ["", " ", "a", "I'll  be\n\n there 12345 é𝒳 %%% ", "\u3000\u3000x", "x" * 3000, " " * 5000, " " * 5000 + "x", "a" + "\n" * 2001 + " b", "\t" * 2500 + "1", "it's " * 4000, "\u00a0" * 2100 + "\u2003" * 50 + "'s"]


@pytest.mark.parametrize("text", SAMPLES)
def test_as_the_library(codec, text):
    ids = codec.encode(text)
    assert ids == codec.encoding.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_texts_are_cut_where_no_match_crosses(codec, monkeypatch):
    monkeypatch.setattr(B, "LONG", 50)
    monkeypatch.setattr(B, "LONG_RUN", 20)
    monkeypatch.setattr(B, "_LONG_RUN", B.re.compile(f"[{B._SPACE}]{{20,}}"))
    for seed in range(30):
        text = "".join(w + [" ", "  ", "\n", " " * 25, " " * 21 + "\n", "'s ", "", "\u3000"][(seed + i) % 8] for i, w in enumerate(words(seed, 200)))
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_run_that_the_library_cannot_match(codec):
    """The library's pattern engine fails on it; the pieces are what the pattern says."""
    text = "ab" + " " * 1_000_000 + "cd"
    ids = codec.encode(text)
    run = codec.encoding._encode_single_piece(" " * 999_999)
    assert ids == codec.encoding.encode_ordinary("ab") + run + codec.encoding.encode_ordinary(" cd")
    assert codec.decode(ids) == text.encode()


def test_tables(spark, codec):
    rows = [(1, "Hé llo"), (2, None), (2, None), (None, "x"), (3, " ".join(words(1, 30_000)))]
    df = documents(spark, rows)
    out = B.encode(df, PATH, PATTERN)
    assert out.columns == ["doc_id", "ids"] and out.count() == 5
    decoded = {r.doc_id: bytes(r.decoded) for r in B.decode(out, PATH, PATTERN).collect()}
    assert decoded == {d: (t or "").encode() for d, t in rows}
    got = {r.doc_id: r for r in B.digests(df, PATH, PATTERN).collect()}
    for d, t in rows:
        ids = codec.encoding.encode_ordinary(t or "")
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.encode(df.filter("false"), PATH, PATTERN).count() == 0
