import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from fluxmill.llm import bpe
from fluxmill.llm.queries import vocabulary_path

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


CASES = ["", " ", "hello world", "It's we'll 'sx", "<|startoftext|>hi<|endoftext|>", "<|x", "a" * 5000, "the" * 3000, "é<|endoftext|>́", "ΣΑΣ İ ǅ ﬀ", "日本語 🙂‍ 123", "a\x1cb\x85c d\x00e"]


@pytest.mark.parametrize("text", CASES)
def test_cases_equal_library(ours, library, text):
    e = library.encode(text, add_special_tokens=False)
    assert ours.encode(text) == e.ids
    back = library.decode(e.ids, skip_special_tokens=False)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    restored = ours._machine.feed_bytes(e.ids) + ours._machine.finish_bytes()
    assert ours.digests(text) == (len(e.ids), sha(" ".join(map(str, e.ids))), sha(back), sha(restored))
    assert ours.decode(e.ids) == back
    # the bytes of the tokens are the normalised text but for white space
    assert "".join(restored.split()) == "".join("".join(x if x in ours.added else ours.normalise(x) for x in ours.special.split(text)).split())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aehlnorstTH '.,!<|>\n\t éßΣ日🙂0́12")), max_size=80))
def test_random_text_equals_library(text):
    if not hasattr(test_random_text_equals_library, "both"):
        test_random_text_equals_library.both = bpe.Tokenizer(bpe.read_vocabulary(PATH)), Library.from_file(PATH)
    ours, library = test_random_text_equals_library.both
    assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_stream_in_pieces_keeps_bounded_state(ours, library):
    dice, t = random.Random(4), ours.transducer
    word = "".join(dice.choice("aehlnorst") for _ in range(20_000))
    out, most, at = [], 0, 0
    while at < len(word):
        n = dice.randint(1, 300)
        out += t.feed(word[at : at + n])
        most = max(most, len(t._last))
        at += n
    out += t.finish()
    assert out == library.encode(word, add_special_tokens=False).ids == t.word(word) == t.word(word, 7)
    assert most <= 3 * (t.lookahead + t.longest) + 300


def test_byte_decoder_holds_back_unfinished_characters():
    alphabet = bpe.byte_alphabet()
    tokens = {k: alphabet[b] for k, b in enumerate("é🙂".encode())}
    d = bpe.Decoder(tokens, "ByteLevel")
    assert [d.feed([k]) for k in range(6)] == ["", "é", "", "", "", "🙂"]
    assert d.feed([2]) + d.finish() == "�"


def test_frames(spark, library):
    rows = [(1, "Some text", "x"), (2, None, "y"), (2, None, "y"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = bpe.encode_documents(df, PATH, digests=True)
    assert [c.lower() for c in got.columns].count("n_tokens") == 1
    out = {(r["doc_id"], r["text"]): r for r in got.collect()}
    ids = library.encode("Some text", add_special_tokens=False).ids
    assert out[1, "Some text"]["n_tokens"] == len(ids)
    assert out[1, "Some text"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert out[2, None]["n_tokens"] == 0 and out[2, None]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).collect()
    assert sorted(r["decoded"] for r in back) == ["", "", "", library.decode(ids, skip_special_tokens=False)]
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_pieces_do_not_change_a_text(ours):
    dice = random.Random(3)
    text = " ".join("".join(dice.choice("aehlnorstéß🙂") for _ in range(dice.randint(1, 12))) for _ in range(300))
    parts = [(list(ids), d) for d, ids in ours.pieces_of(text, 7)]
    assert [i for ids, _ in parts for i in ids] == ours.encode(text) and " ".join(d for _, d in parts) == " ".join(map(str, ours.encode(text)))
    m = bpe.Decoder(ours.tokens, None, "</w>")
    one = "".join(m.feed([i]) for i in ours.encode(text)) + m.finish()
    assert one == ours.decode(ours.encode(text))
    assert "".join(("".join(m.feed_bytes([i]) for i in ours.encode(text)) + m.finish_bytes()).split()) == "".join(ours.normalise(text).split())
