import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fluxmill.llm import lm

SMALL = {"own": 24, "buckets": 4, "dim": 6, "hidden": 8, "rounds": 2, "masked": 1.0, "rate": 0.3}


def corpus(n=120):
    dice = random.Random(1)
    parts = ["the cat sat on the mat", "a dog ran to the park", "we eat red fruit today"]
    return [" ".join(dice.choice(parts) for _ in range(dice.randint(3, 20))) for _ in range(n)]


def frame(spark, texts, first=0):
    return spark.createDataFrame(list(enumerate(texts, first)), "doc_id long, text string")


def test_counts_cover_everything(spark):
    texts = [*corpus(), None, "", "Rare WORDS only", "long " * 30_000]
    df = frame(spark, texts).repartition(5)
    words = Counter(w for t in texts for w in (t or "").lower().split())
    table = lm.word_counts(df)
    assert {r["word"]: r["n"] for r in table.collect()} == words
    pairs = Counter(x for w in words for x in zip(b"\0" + w.encode(), w.encode() + b"\0"))
    got = lm.byte_counts(table)
    assert {(a, b): got[a, b] for a, b in zip(*np.nonzero(got))} == pairs
    log = lm.spelling(got)
    assert np.exp(log).sum(1) == pytest.approx(np.ones(256))
    assert lm.spelled(["cat".encode(), "é".encode()], log) == pytest.approx([sum(log[a, b] for a, b in zip(b"\0" + w, w + b"\0")) for w in ("cat".encode(), "é".encode())])


def test_frequent_words(spark):
    counts = {w: n for n, ws in ((9, "e"), (7, "bdé"), (4, "cafg"), (1, "xyz")) for w in ws}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for most in range(1, 13):
        assert lm._frequent(table, most) == order[:most]
    assert [len(lm._counted(table, k)) for k in (0, 1, 3, 4, 7, 8, 100)] == [0, 1, 1, 4, 4, 8, 11]
    assert lm._frequent(table.limit(0), 5) == lm._counted(table.limit(0), 5) == []


def naive(net, context, target):
    """Log-probability of each row between its neighbours, a place at a time, in plain loops."""
    p, out = net.p, []
    for c, t in zip(context.tolist(), target.tolist()):
        h = [np.tanh(p["shift"][j] + sum(p["embed"][c[k]][i] * p["mix"][k][i][j] for k in range(len(c)) for i in range(p["embed"].shape[1]))) for j in range(len(p["shift"]))]
        top = [p["top_bias"][g] + sum(h[j] * p["top"][j][g] for j in range(len(h))) for g in range(len(p["top_bias"]))]
        g, s = divmod(t - 1, net.per)
        low = [p["out_bias"][g][k] + sum(h[j] * p["out"][g][k][j] for j in range(len(h))) for k in range(net.per)]
        out.append(top[g] - np.log(np.exp(top).sum()) + low[s] - np.log(np.exp(low).sum()))
    return np.array(out)


@pytest.fixture
def tiny():
    rng = np.random.default_rng(3)
    net = lm.Network.fresh(rng.integers(1, 50, 8), rng.integers(1, 50, 3), 3, 4, dtype=np.float64)
    for n in net.p:
        net.p[n] = net.p[n] + rng.standard_normal(net.p[n].shape) * 0.3 * (net.p[n] > -1e8)
    return net, rng.integers(0, 13, (9, 4)), rng.choice([*range(1, 9), 9, 10, 11], 9)


def test_fresh_network_has_the_words_shares():
    counts, buckets = np.array([50, 30, 10, 5, 5]), np.array([1, 1, 8])
    net = lm.Network.fresh(counts, buckets, 3, 4)
    per, first = lm.layout(5, 3)
    rows = np.r_[np.arange(1, 6), first + np.arange(3)]
    share = np.r_[counts + 0.5, buckets + 0.5] / (np.r_[counts, buckets] + 0.5).sum()
    for context in ([0, 0, 0, 0], [1, 5, 2, 7]):
        got = net.log_probabilities(np.tile(context, (8, 1)), rows)
        assert np.exp(got) == pytest.approx(share, rel=1e-5)


def test_probabilities_by_brute_force(tiny):
    net, context, target = tiny
    assert net.log_probabilities(context, target) == pytest.approx(naive(net, context, target))
    assert (net.per, lm.layout(8, 3)) == (4, (4, 9))
    assert np.exp(net.log_probabilities(np.tile(context[0], (11, 1)), np.arange(1, 12))).sum() == pytest.approx(1)


def test_one_update_by_brute_force(tiny):
    """Every parameter's gradient is the difference quotient of the naive loss, and a step moves it by Adagrad's rule."""
    net, context, target = tiny
    loss, grads = net.gradient(context, target)
    assert loss == pytest.approx(-naive(net, context, target).mean())
    before = {n: x.copy() for n, x in net.p.items()}
    dense = {}
    for n, x in net.p.items():
        dense[n] = np.zeros_like(x)
        at, value = grads[n] if isinstance(grads[n], tuple) else (slice(None), grads[n])
        dense[n][at] = value
        for place in np.ndindex(x.shape):
            if x[place] < -1e8:
                continue
            x[place] += 1e-5
            up = -naive(net, context, target).mean()
            x[place] -= 2e-5
            down = -naive(net, context, target).mean()
            x[place] += 1e-5
            assert dense[n][place] == pytest.approx((up - down) / 2e-5, abs=1e-7), (n, place)
    squares = {n: np.full_like(x, 0.25) for n, x in net.p.items()}
    net.update(grads, squares, 0.1)
    for n in net.p:
        assert net.p[n] == pytest.approx(before[n] - 0.1 * dense[n] / (np.sqrt(0.25 + dense[n] ** 2) + 1e-8))


def test_windows_end_at_texts():
    flat = lm.stream([[1, 2, 3], [], [4]])
    assert flat.tolist() == [0, 0, 1, 2, 3, 0, 0, 0, 0, 4, 0, 0]
    assert lm.windows(flat, np.array([2, 4, 9])).tolist() == [[0, 0, 2, 3], [1, 2, 0, 0], [0, 0, 0, 0]]


def test_training_learns_the_order_of_words(spark):
    texts = corpus()
    dice, odd = random.Random(4), []
    for t in texts[:40]:
        w = t.split()
        dice.shuffle(w)
        odd.append(" ".join(w))
    df = frame(spark, texts).coalesce(1)
    model = lm.train(df, **SMALL)
    assert model.losses[-1] < model.losses[0] - 0.3 and model[0][0] == "the"
    extra = spark.createDataFrame([(900, None), (901, ""), (0, texts[0]), (902, "the the " * 60_000)], "doc_id long, text string")
    rows = df.union(frame(spark, odd, 500)).union(frame(spark, ["gribble frobnicate zyx wuggle"], 800)).union(extra).selectExpr("*", "1 AS n_tokens")
    got = {r["doc_id"]: r for r in lm.score(rows, model, buckets=4, within=False).collect()}
    assert got[900]["n_tokens"] == got[901]["n_tokens"] == 0 and got[900]["mean_log_likelihood"] is None and got[901]["log_likelihood"] == 0
    natural = np.mean([got[k]["mean_log_likelihood"] for k in range(40)])
    shuffled = np.mean([got[500 + k]["mean_log_likelihood"] for k in range(40)])
    assert natural > shuffled + 0.5 > got[800]["mean_log_likelihood"] + 3
    # the words all have rows of their own here: the sum is the network's alone
    coder, net = lm.Coder(model[0], 4), lm.Network(model[1])
    flat = lm.stream([coder.rows(lm.words(texts[3]))])
    at = np.flatnonzero(flat)
    assert got[3]["log_likelihood"] == pytest.approx(naive(net, lm.windows(flat, at), flat[at]).sum(), rel=1e-5)
    assert got[902]["n_tokens"] == 120_000
    again = lm.train(df, **SMALL)
    assert again[0] == model[0] and all((again[1][n] == model[1][n]).all() for n in model[1])


def test_every_position_is_trained_on(spark, monkeypatch):
    """By default, over batches and rounds: each word is a target as often as it occurs."""
    texts = [*corpus(), "once", None, ""]
    counts = Counter(w for t in texts for w in (t or "").split())
    coder, seen, gradient = lm.Coder([w for w, _ in counts.most_common(8)], 4), Counter(), lm.Network.gradient
    net = lm.Network.fresh(np.ones(8), np.ones(4), 3, 4)

    def noted(self, context, target):
        seen.update(target.tolist())
        return gradient(self, context, target)

    monkeypatch.setattr(lm.Network, "gradient", noted)
    done = lm.fit_partition(net, iter(texts), coder, (1,), 0.1)[1]
    assert done == counts.total() and seen == Counter(r for t in texts for r in coder.rows(lm.words(t)))
    seen.clear()
    assert lm.fit_partition(net, iter(texts), coder, (1,), 0.1, batch=7)[1] == counts.total() and seen.total() == counts.total()
    monkeypatch.setattr(lm.Network, "gradient", gradient)
    shipped, fit = [], lm._round
    monkeypatch.setattr(lm, "_round", lambda *a: (shipped.append(a[7]), fit(*a))[1])
    lm.train(frame(spark, texts), own=8, buckets=4, dim=3, hidden=4)
    assert shipped == [1.0] * lm.ROUNDS


ODD = ["", None, "  two  Words\n", "\n", "a\tb\x0bc\x0cd\re", "x\x1cy z\x85w q\u3000r", "\u0130x \u03a3\u0391\u03a3 \u00c9t\u00e9", "nul\0nul \0", "w" * 31, "w" * 32 + " " + "w" * 33, "é" * 500, "the end the END"]


def test_arrays_of_words_are_as_words_one_by_one():
    found, sizes = lm.tokens(lm.lowered(ODD))
    plain = [lm.words(t) for t in ODD]
    assert sizes.tolist() == list(map(len, plain)) and found.cast("binary").to_pylist() == sum(plain, [])
    coder = lm.Coder(["the", "w" * 32, "été", "two"], 7)
    assert coder.encode(found).tolist() == coder.rows(sum(plain, []))
    assert coder.encode(found.slice(3, 9)).tolist() == coder.rows(sum(plain, [])[3:12]) and coder.encode(found[:0]).tolist() == []
    for part in (found, found.slice(5), found[:0]):
        held = part.cast("binary").to_pylist()
        assert lm.crc32(part).tolist() == lm.crc32(part, 3).tolist() == list(map(zlib.crc32, held))
        log = np.log(np.random.default_rng(2).random((256, 256)))
        assert lm.spelled(part, log) == pytest.approx([sum(log[x] for x in zip(b"\0" + w, w + b"\0")) for w in held])
    for most in (1, 5, 1000):
        some = list(lm.portions(ODD, most))
        assert sum(some, []) == ODD and all(some)


def test_training_looks_distinct_words_up_once(monkeypatch):
    """Not every word: what a text's rows cost is shared by all that repeat a word."""
    texts = [*corpus(), *ODD]
    coder = lm.Coder(["the", "cat", "sat"], 4)
    want = Counter(r for t in texts for r in coder.rows(lm.words(t)))
    asked, seen, gradient, crc32 = [], Counter(), lm.Network.gradient, getattr(lm, "crc32", None)

    def one_by_one(self, held):
        raise AssertionError("words are looked up one by one")

    monkeypatch.setattr(lm.Coder, "rows", one_by_one)
    monkeypatch.setattr(lm, "crc32", lambda held: (asked.extend(held.to_pylist()), crc32(held))[1], raising=False)
    monkeypatch.setattr(lm.Network, "gradient", lambda self, context, target: (seen.update(target.tolist()), gradient(self, context, target))[1])
    done = lm.fit_partition(lm.Network.fresh(np.ones(3), np.ones(4), 3, 4), iter(texts), coder, (1,), 0.1)[1]
    assert seen == want and done == want.total()
    assert len(asked) == len(set(asked)) < 60


@pytest.mark.parametrize("slice_", [3, 512])
def test_gradient_over_slices(tiny, monkeypatch, slice_):
    """Slices, of the softmaxes and of the neighbours, change nothing."""
    net, _, _ = tiny
    rng = np.random.default_rng(8)
    context, target = rng.integers(0, 13, (70, 4)), rng.choice([*range(1, 9), 9, 10, 11], 70)
    loss, whole = net.gradient(context, target)
    monkeypatch.setattr(lm, "_SLICE", slice_)
    monkeypatch.setattr(lm, "_NEAR", 5)
    again, parts = net.gradient(context, target)
    assert again == pytest.approx(loss) == pytest.approx(-naive(net, context, target).mean())
    assert all(parts[n] == pytest.approx(whole[n]) for n in net.p)
    assert lm.Network(net.p).log_probabilities(context, target) == pytest.approx(naive(net, context, target))


def test_unbounded_logits_by_brute_force(tiny):
    net, context, target = tiny
    net.p["top_bias"] = net.p["top_bias"] + 800
    net.p["out_bias"] = net.p["out_bias"] + 800 * (net.p["out_bias"] > -1e8)
    loss, grads = net.gradient(context, target)
    assert loss == pytest.approx(-naive_shifted(net, context, target).mean()) and all(np.isfinite(g).all() for g in grads.values())


def naive_shifted(net, context, target):
    low = lm.Network({**net.p, "top_bias": net.p["top_bias"] - 800, "out_bias": net.p["out_bias"] - 800 * (net.p["out_bias"] > -1e8)})
    return naive(low, context, target)


def test_training_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "PARTITION_TOKENS", 100)
    df = frame(spark, [*corpus(), None]).repartition(4)
    model = lm.train(df, **SMALL)
    assert model.losses[-1] < model.losses[0] - 0.2


@pytest.mark.parametrize("counted", [0, 5, 1000])
def test_rare_words_by_brute_force(spark, counted):
    """Scores of words in buckets, from the counts of all other documents."""
    texts = ["the cat sat"] * 30 + ["the dolphin sat"] * 8 + ["cat the zebra sat yak zebra\nzebra yak"] * 2 + ["zebra  yak", "yak zebra yak lone zebra\n\n zebra yak\nzebra yak\r\nthe"] + ["the zyxgr sat zyxgr", "the ooo", "the ooo", "the lone sat", None]
    options = {"own": 2, "buckets": 2, "dim": 3, "hidden": 3, "rounds": 1, "counted": counted}
    df = frame(spark, texts).repartition(3)
    model = lm.train(df, **options)
    assert model[0] == ["the", "sat"]
    new = ["the qqqq sat", "the dolphin sat dolphin"]
    coder, net, log = lm.Coder(model[0], 2), lm.Network(model[1]), model[3]
    counts = Counter(w for t in texts for w in (t or "").split())

    lines = Counter(" ".join(x.split()) for t in texts for x in (t or "").split("\n") if x.split())

    def want(text, own):
        flat = lm.stream([coder.rows(text.encode().split())])
        at = np.flatnonzero(flat)
        values = iter(net.log_probabilities(lm.windows(flat, at), flat[at]))
        other = counts - Counter(text.split()) if own else counts
        mine = Counter(" ".join(x.split()) for x in text.split("\n") if x.split())
        total = 0.0
        for line in text.split("\n"):
            if not line.split():
                continue
            sum_ = 0.0
            for w in line.split():
                sum_ += next(values)
                if w not in ("the", "sat"):
                    mates = {x: n for x, n in other.items() if x not in ("the", "sat") and zlib.crc32(x.encode()) % 2 == zlib.crc32(w.encode()) % 2}
                    n, types = sum(mates.values()), len(mates)
                    spell = sum(log[a, b] for a, b in zip(b"\0" + w.encode(), w.encode() + b"\0")) + np.log(2)
                    sum_ += np.log((mates[w] - lm.DISCOUNT) / n) if w in mates else spell + (np.log(lm.DISCOUNT * types / n) if n else 0)
            if own:
                name = " ".join(line.split())
                sum_ = np.log((1 - lm.MEMORY) * np.exp(sum_) + lm.MEMORY * (lines[name] - mine[name]) / (lines.total() - mine.total()))
            total += sum_
        return total

    got = {r["doc_id"]: r["log_likelihood"] for r in lm.score(df, model, buckets=2).collect()}
    assert all(got[k] == pytest.approx(want(t or "", True), rel=2e-3, abs=2e-3) for k, t in enumerate(texts))
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.score(frame(spark, new), model, buckets=2, within=False).collect()}
    assert all(got[k] == pytest.approx(want(t, False), rel=2e-3) for k, t in enumerate(new))


def test_documents_that_occur_twice_score_apart(spark):
    dice = random.Random(9)
    made = lambda: " ".join("".join(dice.choice("abcdefgh") for _ in range(6)) if k % 5 == 0 else dice.choice(["the", "of", "and", "to"]) for k in range(80))
    once, twice = [made() for _ in range(40)], [made() for _ in range(10)]
    df = frame(spark, [*once, *twice, *twice])
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(df, lm.train(df, own=4, buckets=8, dim=4, hidden=4, rounds=1), buckets=8).collect()}
    assert min(got[k] for k in range(40, 60)) > max(got[k] for k in range(40)) + 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, lm.train(df, **SMALL), buckets=4).count() == 0


def test_chunks_do_not_change_scores(spark, monkeypatch):
    texts = [f"{t} rare{k % 37} odd{k}" for k, t in enumerate(corpus(60))]
    df = spark.createDataFrame([*enumerate(texts), (None, "twin rare1"), (None, "twin rare1")], "doc_id long, text string").repartition(2)
    model = lm.train(df, **SMALL)
    key = lambda rows: sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_likelihood"], 3)) for r in rows)
    one = key(lm.score(df, model, buckets=4).collect())
    monkeypatch.setattr(lm, "_CHUNK", 25)
    assert key(lm.score(df, model, buckets=4).collect()) == one and len(one) == 62
