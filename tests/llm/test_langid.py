import random
import zlib

import numpy as np
import pytest

from fluxmill.llm import langid

SYLLABLES = {"aa": "ka to mi ra ne su".split(), "bb": "sch ung ver lich ein".split(), "cc": "çã õe nho lha qui".split()}


def make(dice, lang, n):
    return " ".join("".join(dice.choice(SYLLABLES[lang]) for _ in range(dice.randint(1, 4))) for _ in range(n))


def naive_phrases(text, reference):
    """Longest matches by substring search."""
    t, r = ("".join(map(chr, langid.letters(x))) for x in (text, reference))
    count = at = 0
    while at < len(t):
        n = 1
        while at + n < len(t) and t[at : at + n + 1] in r:
            n += 1
        at += n
        count += 1
    return count


def test_automaton_knows_exactly_the_substrings():
    text = "abcbcabbaac"
    moves = langid.suffix_automaton([ord(c) for c in text])

    def knows(s):
        state = 0
        for c in s:
            state = moves[state].get(ord(c))
            if state is None:
                return False
        return True

    parts = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(map(knows, parts))
    assert not any(knows(a + b) for a in parts for b in "abcd" if a + b not in parts)


@pytest.mark.parametrize("seed", range(4))
def test_phrases_equal_brute_force(seed):
    dice = random.Random(seed)
    refs = {n: make(dice, n, 60) for n in SYLLABLES}
    parser = langid.Parser(refs)
    known = set("".join(refs.values()))
    texts = ["".join(c for c in make(dice, dice.choice(list(SYLLABLES)), dice.randint(1, 80)) if c in known) for _ in range(12)] + ["", None, "12 %%"]
    count, size = parser.phrases(texts)
    for k, t in enumerate(texts):
        for n, name in enumerate(parser.languages):
            if size[k]:
                assert count[n, k] == naive_phrases(t, refs[name]), (t, name)
            else:
                assert count[n, k] == 0


@pytest.mark.parametrize("piece", [1, 2, 5, 17])
def test_pieces_change_nothing(monkeypatch, piece):
    """Phrases of any length cross any number of pieces."""
    dice = random.Random(piece)
    ref = {"aa": "abcabcabcabdabcabe" * 3, "bb": "xyzxyzzyx"}
    texts = ["".join(dice.choice("abcde") for _ in range(60)) for _ in range(20)] + ["abc" * 40, "z" * 9, ref["aa"], ref["aa"] + "q" + ref["bb"] * 9, "abcabcabd" * 30 + "e"]
    parser = langid.Parser(ref)
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "_LANES", 7)
    count, _ = parser.phrases(texts)
    assert count.T.tolist() == [[naive_phrases(t, ref[n]) for n in parser.languages] for t in texts]


def test_letters():
    assert "".join(map(chr, langid.letters("नमस्ते दुनिया!"))) == "नमस्ते दुनिया"
    assert "".join(map(chr, langid.letters("a𐐀𐐨 🙂𝒳b"))) == "a𐐨𐐨 𝒳b"
    assert "".join(map(chr, langid.letters("  Ab1c!!É\n"))) == "ab c é"
    assert len(langid.letters("12 %")) == len(langid.letters("")) == len(langid.letters("\u0301 \u0301")) == 0


def rows(n=300):
    dice = random.Random(3)
    out = []
    for k in range(n):
        lang = dice.choice(list(SYLLABLES))
        out.append((k, make(dice, lang, dice.randint(5, 60)), lang))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "42 !", None), (1003, data[0][1] * 200, None), (None, data[1][1], data[1][2])]
    df = spark.createDataFrame([(*r, "z") for r in data + extra], "doc_id long, text string, lang string, lang_pred string")
    refs = langid.references(df)
    got = {r["doc_id"]: r for r in langid.identify(df, refs).collect()}
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) >= 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == data[0][2] and all(0 <= r["lang_score"] <= 1 for r in got.values())
    # rows that repeat an id are one, and the number of labels is bounded
    assert langid.references(df.unionByName(df)) == refs and len(langid.references(df, most_languages=2)) == 2
    # neither labels nor texts of held-out rows are learned from
    hidden = spark.createDataFrame([(i, t if zlib.crc32(str(i).encode()) % 5 else "zzzz", n if zlib.crc32(str(i).encode()) % 5 else "zz") for i, t, n in data], "doc_id long, text string, lang string")
    plain = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert langid.references(hidden) == langid.references(plain)


def test_nothing_to_learn_and_nothing_to_do(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.references(df) == {}
    assert langid.identify(df, {}).first()["lang_pred"] == "und"
    assert langid.identify(df.limit(0), {"aa": "abc"}).count() == 0
