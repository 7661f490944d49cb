import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from fluxmill.llm import quality
from fluxmill.llm.oracle import quality as quality_sql


def naive(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, " \n\t", "a", "a b", "a b c a b c", "x x x x", "one\none\n\n two\n two\none ", "a#b *$% &|<> é🙂", "  q\x1cw", "a b c d a b c e a b c", "w " * 5000, "\n".join(["l m n"] * 40)]


def test_statistics(spark):
    df = spark.createDataFrame([(k, t, "n") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words string").drop("n_words")
    for r in quality.text_statistics(df).collect():
        assert tuple(r)[1:] == naive(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_chi_square():
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)


def reference(x, share=quality.SHARE):
    """The estimate in plain numpy on the same quantised vectors: distances, the ends' determinants and how many steps they took."""
    floors = np.array(list(quality.FLOORS.values()))
    bins = lambda d: np.floor(64 * np.log1p(np.minimum(d, 1e12)))
    q = x / quality.UNIT
    z = np.abs(x - np.median(x, 0)) / quality.UNIT / np.sqrt((1.4826 * np.median(np.abs(x - np.median(x, 0)), 0) / quality.UNIT) ** 2 + floors**2)
    factor = share / quality._chi2_cdf(quality.chi2_quantile(share, quality.P), quality.P + 2)
    ends = []
    for d in ((z**2).sum(1), z.max(1) ** 2, z.sum(1) ** 2):
        before = None
        for step in range(quality.MOST_STEPS):
            b = bins(d)
            near = q[b <= np.percentile(b, 100 * share)]
            mean, cov = near.mean(0), np.cov(near.T, bias=True).reshape(quality.P, -1) * factor + np.diag(floors**2)
            d = np.einsum("ij,jk,ik->i", q - mean, np.linalg.inv(cov), q - mean)
            if before is not None and np.allclose(before, cov, rtol=1e-12, atol=0):
                break
            before = cov
        ends.append((np.linalg.slogdet(cov)[1], step, d))
    return min(ends, key=lambda e: e[0])[2], [e[0] for e in ends], [e[1] for e in ends]


def sample(dice):
    rows = []
    for k in range(400):
        lang, source = ("en", "a") if k % 2 else ("de", None)
        size = 3 if lang == "en" else 7
        words = ["".join(dice.choice("abcdefghij") for _ in range(max(1, size + dice.randint(-1, 1)))) for _ in range(dice.randint(60, 120))]
        if k % 20 == 0:
            words = [w + "%%%" for w in words]
        rows.append((k, lang, source, " ".join(words)))
    return [*rows, (1000, "xx", "tiny", rows[1][3]), (1001, None, None, None), (7, "en", "a", rows[7][3])]


def vectors_of(rows):
    stats = np.array([naive(r[3]) for r in rows], float)
    n = np.maximum(stats[:, :1], 1)
    return np.rint(quality.UNIT * np.c_[np.log(np.maximum(stats[:, 1:2], 1) / n), np.log1p(100 * stats[:, 2:] / n)])


def test_outliers(spark):
    rows = sample(random.Random(8))
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, lang string, source string, text string, distance double")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1001]["base_failed"] and not by[1001]["kept"]
    assert all(by[k]["kept"] == (k % 20 != 0) for k in range(400))
    for lang in ("en", "de"):
        own = [r for r in rows if r[1] == lang]
        assert [by[r[0]]["distance"] for r in own] == pytest.approx(reference(vectors_of(own))[0].tolist(), rel=0.03, abs=0.03)
    # a group too small for an estimate is judged by its language's, a language too small by that of all documents
    judged = [r for r in rows if not by[r[0]]["base_failed"]]
    everything = reference(vectors_of(judged))[0]
    assert by[1000]["distance"] == pytest.approx(everything[[r[0] for r in judged].index(1000)], rel=0.03, abs=0.03)
    assert quality.judge(df.limit(0)).count() == 0


def test_small_groups_have_verdicts(spark):
    """Sources of ten documents each: all are judged by their language's estimate."""
    rows = [(k, "en", f"s{k % 30}", t) for k, (_, _, _, t) in enumerate(sample(random.Random(4))[:399]) if k % 2]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert [got[r[0]]["distance"] for r in rows] == pytest.approx(reference(vectors_of(rows))[0].tolist(), rel=0.03, abs=0.03)


def test_steps_settle_and_the_smallest_determinant_is_kept(spark):
    """Two clouds, so that the starts end in different halves."""
    dice = np.random.default_rng(11)
    x = np.r_[dice.normal([1500, 0, 0, 0], [40, 300, 200, 900], (130, 4)), dice.normal([2600, 4000, 2500, 0], [300, 20, 400, 300], (121, 4)), dice.normal([2000, 2000, 0, 3000], 900, (20, 4))].round()
    want, ends, steps = reference(x)
    assert max(steps) < quality.MOST_STEPS - 1
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "__g string, x0 long, x1 long, x2 long, x3 long")
    got = quality.estimate(df, 1).first()
    assert got["volume"] == pytest.approx(min(ends), abs=1e-6)


def test_each_statistic_alone_rejects(spark):
    """Documents whose only fault is repeated lines, repeated windows, symbols or long words."""
    dice = random.Random(5)
    word = lambda n=5: "".join(dice.choice("abcdefghijklmnop") for _ in range(n))
    lines = lambda k: [" ".join(word() for _ in range(10)) for _ in range(k)]
    rows = [(k, "\n".join(lines(20))) for k in range(200)]
    dull, twice = lines(1), lines(1)[0].split()
    rows += [(1000, "\n".join(lines(10) + ["-"] * 40)), (1001, "\n".join(" ".join(x.split()[:7] + twice[:3]) for x in lines(20)))]
    rows += [(1002, "\n".join(x.replace(" ", "$ ") for x in lines(20))), (1003, "\n".join(" ".join(word(9) for _ in range(10)) for _ in range(20)))]
    df = spark.createDataFrame([(k, "en", "a", t) for k, t in rows], "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert not any(got[k]["base_failed"] for k in got) and all(got[k]["kept"] for k in range(200))
    assert [got[k]["kept"] for k in range(1000, 1004)] == [False] * 4


def test_equals_sql_on_large_and_small_groups(spark, tmp_path):
    rows = sample(random.Random(3))
    for k, r in enumerate(sample(random.Random(6))):
        rows.append((5000 + k, r[1], f"small{k % 40}", r[3]))
    rows = list({r[0]: r for r in rows}.values())  # the SQL goes by id
    pd = pytest.importorskip("pandas")
    documents = pd.DataFrame(rows, columns=["doc_id", "lang", "source", "text"])  # noqa: F841
    con = duckdb.connect()
    want = sorted(con.execute(quality_sql()).fetchall())
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).drop("distance")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_main_path_is_native(spark):
    df = spark.createDataFrame(sample(random.Random(9)), "doc_id long, lang string, source string, text string")
    plan = quality.judge(df)._jdf.queryExecution().toString() + quality.text_statistics(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
