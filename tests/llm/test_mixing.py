import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxmill.llm import mixing


def level(totals, weights=(3, 1, 2), share=1.5):
    """Targets by source, redistributing until none is above twice its size."""
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + ([None] if None in totals else [])
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(totals.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * totals[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: 2 * totals[s] for s in full}
        left -= sum(2 * totals[s] for s in full)
        open_ -= full
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 60))
def test_knapsack_is_best(counts, budget):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    sums = {0}
    for k, c in counts.items():
        sums = {s + k * m for s in sums for m in range(c + 1)}
    got = mixing.knapsack(lengths, n, budget)
    assert (got <= n).all() and (got >= 0).all()
    assert int((got * lengths).sum()) == min(sums, key=lambda s: (abs(s - budget), s))


@pytest.mark.parametrize("target", [0.0, 10.0, 777.4, 5000.0, 9999.9])
def test_fit_comes_near(target):
    dice = random.Random(6)
    lengths = np.array(sorted(dice.sample(range(1, 90), 20)))
    counts = np.array([dice.randint(1, 9) for _ in lengths])
    total = int((lengths * counts).sum())
    target = min(target, 2.0 * total)
    passes, extra = mixing.fit(lengths, counts, target)
    assert (extra <= counts).all() and (passes + (extra > 0) <= 2).all()
    assert abs(int((lengths * (passes * counts + extra)).sum()) - target) <= 1


def test_documents(spark):
    dice = random.Random(7)
    rows = [(k, " ".join("w" * (1 + k % 3) for _ in range(dice.randint(0, 40))), dice.choice(["a", "b", "é", None, "c", "a", "a", "a"])) for k in range(600)]
    rows += [(900, None, "a"), (901, "", None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + len((t or "").split())
    want = level(totals)
    source, taken = {i: s for i, _, s in rows}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "counts, target, miss",
    [
        ({400_000: 1, 300: 2000}, 900_000, 100),
        ({40_000: 1, 30: 2000}, 90_000, 10),
        ({300_000: 5, 200: 500}, 1_200_000, 0),
        ({200_000: 1}, 150_000, 50_000),
        ({200_000: 1}, 90_000, 90_000),
        ({20_000: 1}, 15_000, 5_000),
        ({500_000: 1, 90_000: 4, 70_001: 3, 7: 100_000}, 1_100_000, 3),
    ],
)
def test_fit_with_documents_larger_than_the_table(counts, target, miss):
    lengths = np.array(sorted(counts))
    n = np.array([counts[k] for k in lengths])
    passes, extra = mixing.fit(lengths, n, target)
    assert (extra >= 0).all() and (extra <= n).all() and not passes.any()
    assert abs(int((lengths * extra).sum()) - target) <= miss


def test_long_documents_by_brute_force(monkeypatch):
    monkeypatch.setattr(mixing, "TABLE_WORDS", 64)
    dice = random.Random(11)
    for _ in range(200):
        counts = {n: dice.randint(1, 3) for n in dice.sample(range(33, 400), 4)}
        lengths = np.array(sorted(counts))
        n = np.array([counts[k] for k in lengths])
        target = dice.randint(1, int((lengths * n).sum()) - 1)
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * m for s in sums for m in range(c + 1)}
        _, extra = mixing.fit(lengths, n, target)
        assert (extra <= n).all() and abs(int((lengths * extra).sum()) - target) == min(abs(s - target) for s in sums)


@pytest.mark.parametrize("lengths, target, taken", [([70_000], 69_000, 70_000), ([250_000, 300_000], 260_000, 250_000), ([70_000, 90_000], 71_000, 70_000)])
def test_single_long_documents(lengths, target, taken):
    _, extra = mixing.fit(np.array(lengths), np.ones(len(lengths), np.int64), target)
    assert int((np.array(lengths) * extra).sum()) == taken


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 10**6), st.integers(1, 2), min_size=1, max_size=6), st.floats(0, 1))
def test_any_lengths_by_brute_force(counts, part):
    lengths = np.array(sorted(counts))
    n = np.array([counts[k] for k in lengths])
    target = round(part * int((lengths * n).sum()))
    sums = {0}
    for k, c in counts.items():
        sums = {s + k * m for s in sums for m in range(c + 1)}
    passes, extra = mixing.fit(lengths, n, target)
    assert (extra <= n).all() and abs(int((lengths * (extra + passes * n)).sum()) - target) == min(abs(s - target) for s in sums)


def test_a_very_long_document_among_short_ones(spark):
    rows = [(1, "w " * 70_000, "a"), *[(k, "w " * 7, "a") for k in range(2, 200)], (500, "v " * 90_000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s, ids in (("a", range(1, 200)), ("b", (500,))):
        mine = [r for r in got if r["doc_id"] in ids]
        want = mine[0]["target"]
        reach = {0, 1, 2} if s == "b" else None
        taken = sum(r["taken"] for r in mine)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(taken - want) == min(abs(90_000 * k - want) for k in reach) if reach else abs(taken - want) <= 4
