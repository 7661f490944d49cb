import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxmill.llm import toxicity
from fluxmill.llm.toxicity import NEGATIONS, REPORTS, SCOPE, TARGETS, THREATS

STEMS = (["moron", "idiot", "estúpido", "trash", "clown"], ["zorg"], ["throttl"])


def scorer(weights=None):
    return toxicity.Scorer(*STEMS, toxicity.prior() if weights is None else weights)


def marks(clause):
    s = scorer()
    return [m for m in toxicity.marked([s.classify(w) for w in toxicity.symbols(toxicity.lower(clause))]) if m[0] in toxicity.KINDS]


@pytest.mark.parametrize(
    "clause, form",
    [
        ("a moron", "I"), ("you are a moron", "I>"), ("he is not a moron", "I~>"), ("not in any way ever a moron", "I"), ("somebody said you moron", 'I">'),
        ("kill them", "H>"), ("you die i kill", "H>"), ("kill the lights", "H"), ("i'll throttle you", "H>"), ("he isn’t an idiot", "I~>"), ('she said: "you are an idiot"', 'I">'),
        ('"you are an idiot", she said', 'I">'), ("an idiot, she said", "I>"), ("l'idiot", "I"), ("Eres ESTÚPIDO", "I"), ("eres estúpido", "I"), ("zorgul", "J"), ("ich werde dich töten", "H>"),
    ],
)
def test_marks_of_what_governs(clause, form):
    assert marks(clause) == [form]


def test_clauses_bound_what_marks_reach():
    s = scorer()
    place = {f: k for k, f in enumerate(toxicity.FORMS)}
    c = s.counts("This is not. A moron! They said; moron")
    assert c[place["I"]] == 2 and c.sum() == 2
    assert s.counts("calm words only") is None and s.counts(None) is None and s.counts("") is None
    assert s.counts("oxymoron skill") is None  # a stem begins a word
    assert s.counts("killer") is None or not s.counts("killer").any()  # fixed verbs are whole words


def test_scores_are_ordered():
    score = scorer().score
    calm = score("")
    assert calm < 0.5 <= score("you are an idiot") and score("i will kill you") >= 0.5 > score("i will kill the lights")
    assert score("he isn't an idiot") < score("an idiot") <= score("you are an idiot")
    assert score("you are not an idiot") < 0.5 and score('she said: "you are an idiot"') < score("you are an idiot")
    assert score("i will not kill you") < score("i will kill you")
    assert score("trash can") < score("you are trash") and score("the clown was funny") < score("you are a clown")
    assert score("zorga") < score("zorga zorgel zorgi") and score("moron. " * 50_000) <= 1
    assert score("eres estúpido") == score("un estúpido") > calm


def naive(text, weights):
    """Clause by clause and word by word, with look-behind and look-ahead in place of machines."""
    total = {}
    low = unicodedata.normalize("NFC", (text or "").lower())
    for clause in re.split(r"[.!?;\n]", low):
        clause = re.sub(r"\b(l|d|j|n|s|c|t|m|qu)['’](?=\w)", r"\1 ", clause)
        words = re.findall(r'[^\W\d_]+|["“”„«»]', re.sub(r"(?<=\w)['’](?=\w)", "", clause))
        real = [k for k, w in enumerate(words) if w[0].isalpha()]
        for k in real:
            w = words[k]
            if w in (*TARGETS, *NEGATIONS, *REPORTS):
                continue
            kind = "I" if w.startswith(tuple(STEMS[0])) else "J" if w.startswith(tuple(STEMS[1])) else "H" if w in THREATS or w.startswith(tuple(STEMS[2])) else None
            if not kind:
                continue
            near = [words[j] for j in real if j < k][-SCOPE:]
            negated = any(x in NEGATIONS for x in near)
            said = any(x in REPORTS for x in words[:k])
            after = words[k + 1 :]
            for j, x in enumerate(after):  # a word of saying behind an odd number of quotation marks
                if x in REPORTS:
                    crossed = sum(not y[0].isalpha() for y in after[: len(after) - after[::-1].index(next(r for r in after[::-1] if r in REPORTS)) - 1])
                    said = said or crossed % 2 == 1
                    break
            aimed = any(x in TARGETS for x in words)
            form = kind + "~" * negated + '"' * said + ">" * aimed
            total[form] = total.get(form, 0) + 1
    z = weights[-1] + sum(weights[toxicity.FORMS.index(f)] * np.log2(1 + n) for f, n in total.items())
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


WORDS = ["you", "not", "said", "moron", "Idiots", "estúpido", "zorgul", "kill", "killing", "throttled", "the", "x", "isn't", "l'idiot", '"', ".", "!", ";", ":", ",", "\n", "n’est", "pas", "they"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=25))
def test_scores_equal_a_naive_reading(words):
    text = " ".join(words)
    assert scorer().score(text) == pytest.approx(naive(text, toxicity.prior()), abs=1e-12)


def corpus(n=500, stem="zorgul", endings=("a", "en", "x", "ist")):
    dice = random.Random(2)
    rows = []
    for k in range(n):
        words = ["".join(dice.choice(["ba", "ko", "ri", "fo", "nu"]) for _ in range(dice.randint(1, 4))) for _ in range(dice.randint(20, 80))]
        bad = k % 8 == 0
        for _ in range(dice.randint(1, 4) if bad else 0):
            words.insert(dice.randrange(len(words)), stem + dice.choice(endings))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_copies_and_repetition_teach_no_stems():
    rows = corpus(200)
    texts, labels = [r[1] for r in rows], [r[2] for r in rows]
    copied, repeated = "quuxword " + texts[0], " ".join(f"{w} barkword" for w in texts[0].split())
    insults, slurs, threats = toxicity.learn_stems([*texts, *[copied] * 60, repeated], [*labels, *[1] * 61])
    assert insults == ["zorgul"] and not slurs and not threats


def test_slurs_and_threats_are_learned():
    rows, dice = corpus(800, "grumf", ("ab", "cd", "ef")), random.Random(5)
    texts, labels = [], []
    for k, (_, t, bad) in enumerate(rows):
        words = t.split()
        if not bad and k % 3 == 0:
            words.insert(5, "grumf" + dice.choice(("ab", "cd", "ef")))  # once is nothing
        if bad:
            words[3:3] = ["grumfab", "x", "grumfcd"]
        words = ["you", *words, (f". {words[0]} snarkle you" if bad else f". {words[0]} snarkle the") if k % 16 in (0, 2, 4) else "ba"]
        texts.append(" ".join(words)), labels.append(bad)
    insults, slurs, threats = toxicity.learn_stems(texts, labels)
    assert "grumf" in slurs and not any(i.startswith("grumf") for i in insults)
    assert threats == ["snarkle"]
    s = toxicity.Scorer(*toxicity.train(texts, labels))
    assert s.score("you grumfab ko") < 0.5 <= s.score("you ba grumfab ko grumfcd ri grumfef ba grumfab")
    assert s.score("snarkle the ba") < s.score("snarkle you ba")


def test_held_out(spark):
    rows = corpus()
    long = "ko ri " * 20_000
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (None, "zorgulx zorgula", 0.0), (903, long + "zorgulx", 0.0)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, rows[1][2]), (None, 1), (5000, 1), (2, None), (903, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert "zorgul" in model[0]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(x) for i, _, x in held]) == 1
    assert got[900] == got[901] < 0.5 <= min(got[903], got[None])
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.learn(docs, flipped) == model
    # rows that repeat a sampled id teach once, and texts that pass the budget of characters stay away from the driver
    assert toxicity.learn(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels)) == model
    assert toxicity.learn(docs, labels, sample_chars=1_000)[0] == []


def test_labels_that_disagree_count_as_toxic(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, x) for i, _, x in rows]
    both = spark.createDataFrame(labels + [(i, 0) for i, _, x in rows if x], "doc_id long, toxic int")
    assert toxicity.learn(docs, both) == toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you moron"), (2, "i will kill you")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert got[1] < 0.5 <= got[2]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_long_texts_take_time_in_proportion():
    s = scorer()
    began = time.perf_counter()
    text = "x moron y. " * 40_000
    c = s.counts(text)
    assert c[toxicity.FORMS.index("I")] == 40_000 and time.perf_counter() - began < 20
