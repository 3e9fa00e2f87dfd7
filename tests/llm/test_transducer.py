import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from ledgerloom.llm.text_ops import count_tokens, decode, encode  # noqa: E402
from ledgerloom.llm.transducer import Transducer, Utf8, tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def tok():
    return tokenizer("byte_bpe_50k")


@pytest.fixture(scope="module")
def reference(tok):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.transducer.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_as_library(text):
    tok = tokenizer("byte_bpe_50k")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.transducer.ranks, special_tokens={})
    ids = tok.encode(text)
    assert ids == enc.encode_ordinary(text) and tok.decode(ids) == text


def test_transducer_equals_merges_by_definition():
    ranks = {bytes([b]): b for b in range(256)}
    rnd = random.Random(4)
    tokens = list(ranks)
    while len(ranks) < 700:  # a small vocabulary in which merges overlap a lot
        t = rnd.choice(tokens[97:101] + tokens[256:]) + rnd.choice(tokens[97:101] + tokens[256:])
        if t not in ranks and len(t) < 12:
            ranks[t] = len(ranks)
            tokens.append(t)
    m = Transducer(ranks)
    for _ in range(1500):
        s = bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 40)))
        assert list(m.run(s)) == m.merged(s)


def test_special_looking_empty_null_and_long(tok, reference):
    assert tok.encode("<|endoftext|>") == reference.encode_ordinary("<|endoftext|>") != [50256]
    assert tok.encode("") == tok.encode(None) == [] and tok.decode([]) == "" and tok.decode(None) is None
    for long in ("a" * 50_000, "ab \n" * 20_000, "é漢😀" * 5_000):
        assert tok.encode(long) == reference.encode_ordinary(long)


def test_operator(spark, reference):
    rows = [(1, "Hello world", 5), (2, "", 6), (3, None, 7), (4, "  \n", 8), (4, "twice", 9), (5, "नमस्ते 世界 👩‍💻", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode(df, "doc_id", "text").collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    back = {r.doc_id: r.text for r in decode(encode(df.where("doc_id != 4"), "doc_id", "text"), "doc_id").collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 5: "नमस्ते 世界 👩‍💻"}
    assert [r.n_tokens for r in count_tokens(df, "text", ["doc_id"]).orderBy("doc_id").collect()][1:3] == [0, 0]
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_utf8_machine_in_any_cuts():
    data = "aé漢😀z".encode()
    for i in range(len(data)):
        for j in range(i, len(data)):
            m = Utf8()
            assert m.feed(data[:i]) + m.feed(data[i:j]) + m.feed(data[j:]) + m.end() == "aé漢😀z"
    for bad in (b"\xff", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80", b"\xc0\x80", b"a\xf0\x9f\x98b"):
        m = Utf8()
        out = m.feed(bad) + m.end()
        assert "�" in out and all(c == "�" or c.isascii() for c in out)
