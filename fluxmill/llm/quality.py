"""Quality rules: word statistics, base rules, and robust multivariate outliers.

Statistics come from whole texts with built-in functions only.  Per language and
source a minimum-covariance-determinant estimate is fitted to transformed
statistic vectors: from each of several starts (the half of the group nearest its
medians by three norms), concentration steps (distances, the nearest half, that
half's mean and covariance) until they change nothing, at most ``MOST_STEPS``; of
the starts' ends, the one with the smallest determinant is kept.  A document is
rejected when it fails a base rule or its squared Mahalanobis distance passes a
chi-square quantile.

Vectors are held as whole multiples of 1/1024, so sums are exact and reruns
agree whatever the partitioning.  A group of fewer than ``min_group`` documents is
judged by the estimate of its whole language, a language of fewer by that of all
documents, so every document that passes the base rules has a verdict.
Covariances get a floor on the diagonal, the resolution of a statistic in a text of
ordinary length, so statistics that are constant in most of a group stay usable; each
coordinate alone can reject.

Null texts count as empty (they fail the base rule); null languages and sources
form groups of their own; very long texts are read whole; repeated rows each get the
same verdict; a distance at the quantile is kept, of starts with equal determinants
the first counts, and rows whose distances fall into the bin at the half's edge are
all in the half; an empty table gives an empty result; extra columns are ignored.  A
group may hold any share of the rows: every pass aggregates before its shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxmill.llm.common import code_key, join_small, stash

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
UNIT = 1024
#: The vector's coordinates, with the least standard deviation each is given.
FLOORS = {"length": 0.05, "symbols": 0.3, "lines": 0.3, "repeats": 0.6}
P = len(FLOORS)
#: Share of a group that an estimate rests on, the quantile beyond which a document is rejected, documents of a group of its own, and steps.
SHARE, QUANTILE, MIN_GROUP, MOST_STEPS = 0.5, 0.999, 40, 12
#: Norms of the scaled deviations from the medians that the starts go by.
STARTS = ("sum of squares", "greatest", "sum")


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < q else (low, mid)
    return (low + high) / 2


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; drop the text.

    Narrow.  Repeated windows are found per document by sorting its three-word
    windows beside their places; most documents have none and skip the sort.
    """
    others = [df[c] for c in df.columns if c != text]
    t = F.coalesce(df[text], F.lit(""))
    out = df.select(*others, t.alias("__t"), F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("__w"))
    names = [c for c in df.columns if c != text]
    count = lambda a: F.size(a).cast("long")
    later = lambda a, k: F.slice(a, k, F.greatest(F.size(a), F.lit(1)))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = out.select(
        *names,
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        lines.alias("__l"),
        "__w",
    )
    # windows as 64-bit hashes: sorting and comparing numbers is cheap, and a text holds far fewer windows than would collide
    words = F.transform("__w", lambda w: F.xxhash64(w))
    out = out.select(
        *names,
        "n_symbols",
        "word_chars",
        (count(F.col("__l")) - count(F.array_distinct("__l"))).alias("n_dup_lines"),
        count(F.col("__w")).alias("n_words"),
        words.alias("__h"),
    )
    held = [*names, "n_symbols", "word_chars", "n_dup_lines", "n_words"]
    triples = F.zip_with(F.zip_with("__h", later(F.col("__h"), 2), lambda a, b: F.xxhash64(a, b)), later(F.col("__h"), 3), lambda ab, c: F.xxhash64(ab, c))
    out = out.select(*held, F.slice(triples, 1, F.greatest(F.size("__h") - 2, F.lit(0))).alias("__v"))
    placed = F.transform("__v", lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    out = out.select(*held, F.when(F.size(F.array_distinct("__v")) < F.size("__v"), F.array_sort(placed)).alias("__s"))
    twins = F.zip_with(F.col("__s"), later(F.col("__s"), 2), lambda a, b: F.when(a["s"] == b["s"], F.array(a["i"], b["i"])))
    twins = F.flatten(F.filter(twins, lambda x: x.isNotNull()))
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(twins), lambda i: F.array(i, i + 1, i + 2))))
    return out.select(*held, F.coalesce(F.size(covered).cast("long"), F.lit(0).cast("long")).alias("__r")).select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.greatest("__r", F.lit(0).cast("long")).alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """Word length, symbols, repeated lines and repeated words, each on a logarithmic scale in units."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    logs = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *(F.log1p(100 * F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))]
    return [F.round(UNIT * x).cast("long").alias(f"x{k}") for k, x in enumerate(logs)]


def _distance() -> Column:
    """Squared distance: the centred vector times the inverse triangular factor."""
    c = [F.col(f"x{k}") / UNIT - F.col(f"m{k}") for k in range(P)]
    rows = [sum((F.col(f"w{i}{j}") * c[j] for j in range(1, i + 1)), F.col(f"w{i}0") * c[0]) for i in range(P)]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def _bin(d: Column) -> Column:
    """Distances in 1/64 steps of their logarithm: few values, so that exact quantiles stay small."""
    return F.floor(64 * F.log1p(F.least(d, F.lit(1e12)))).cast("int")


def _factor(params: DataFrame) -> DataFrame:
    """From covariances s_ij to the inverse w of their triangular root, one column set at a time, and the logarithm of the determinant."""
    keep = ["__g", "start", *[f"m{k}" for k in range(P)]]
    made: list[str] = []
    sources = [f"s{i}{j}" for i in range(P) for j in range(i + 1)]
    for j in range(P):
        diagonal = F.col(f"s{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        params = params.select(*keep, *sources, *made, F.sqrt(F.greatest(diagonal, F.lit(1e-12))).alias(f"l{j}{j}"))
        made.append(f"l{j}{j}")
        below = [((F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")).alias(f"l{i}{j}") for i in range(j + 1, P)]
        params = params.select(*keep, *sources, *made, *below)
        made += [f"l{i}{j}" for i in range(j + 1, P)]
    done: list[str] = []
    for i in range(P):
        own = [(F.lit(1.0) / F.col(f"l{i}{i}") if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")).alias(f"w{i}{j}") for j in range(i + 1)]
        params = params.select(*keep, *made, *done, *own)
        done += [f"w{i}{j}" for j in range(i + 1)]
    volume = sum((2 * F.log(F.col(f"l{k}{k}")) for k in range(1, P)), 2 * F.log(F.col("l00")))
    return params.select(*keep, *done, volume.alias("volume"))


def _started(vectors: DataFrame, join) -> DataFrame:
    """(group, start, bin of the distance, vector): distances from the medians, scaled by median deviations, by each start's norm."""
    medians = stash(vectors.groupBy("__g").agg(*[F.percentile(f"x{k}", 0.5).alias(f"c{k}") for k in range(P)]), "mcd-median")
    spread = join(vectors, medians).groupBy("__g").agg(*[F.first(f"c{k}").alias(f"c{k}") for k in range(P)], *[F.percentile(F.abs(F.col(f"x{k}") - F.col(f"c{k}")), 0.5).alias(f"a{k}") for k in range(P)])
    spread = stash(spread, "mcd-spread")
    floors = list(FLOORS.values())
    z = [F.abs(F.col(f"x{k}") - F.col(f"c{k}")) / UNIT / F.sqrt((1.4826 * F.col(f"a{k}") / UNIT) ** 2 + floors[k] ** 2) for k in range(P)]
    total = lambda parts: sum(parts[1:], parts[0])
    norms = [total([c * c for c in z]), F.greatest(*z) * F.greatest(*z), total(z) * total(z)]
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), _bin(d).alias("b")) for k, d in enumerate(norms)])).alias("__d")
    return join(vectors, spread).select("__g", *[f"x{k}" for k in range(P)], starts).select("__g", F.col("__d.start").alias("start"), F.col("__d.b").alias("__b"), *[f"x{k}" for k in range(P)])


def _concentrate(placed: DataFrame, share: float, many: int) -> DataFrame:
    """One concentration step: the nearest ``share`` of each group, from each start, gives a mean and a covariance."""
    keys = ["__g", "start"]
    cuts = stash(placed.groupBy(*keys).agg(F.percentile("__b", share).alias("__cut")), "mcd-cut")
    near = join_small(placed, cuts, keys, "inner", len(STARTS) * many).where(F.col("__b") <= F.col("__cut"))
    sums = near.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(f"x{k}").cast("double").alias(f"t{k}") for k in range(P)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).cast("double").alias(f"t{i}{j}") for i in range(P) for j in range(i + 1)],
    )
    consistent = share / _chi2_cdf(chi2_quantile(share, P), P + 2)
    floors = list(FLOORS.values())
    cov = lambda i, j: (F.col(f"t{i}{j}") / F.col("n") - F.col(f"t{i}") / F.col("n") * F.col(f"t{j}") / F.col("n")) / UNIT**2 * consistent + (floors[i] ** 2 if i == j else 0.0)
    moments = sums.select(*keys, *[(F.col(f"t{k}") / F.col("n") / UNIT).alias(f"m{k}") for k in range(P)], *[cov(i, j).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)])
    return stash(_factor(moments), "mcd-step")


def _groups(stats: DataFrame, min_group: int) -> tuple[DataFrame, int]:
    """Each language and source beside the group it is judged by, and how many there are."""
    counts = stash(stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")), "mcd-groups")
    language = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    keyed = counts.alias("c").join(language.select(F.col("lang").alias("__lang"), "n_lang"), F.col("c.lang").eqNullSafe(F.col("__lang")), "left")
    own, wider = F.concat(F.lit("s"), code_key("lang", "source")), F.concat(F.lit("l"), code_key("lang"))
    judge_by = F.when(F.col("n") >= min_group, own).when(F.col("n_lang") >= min_group, wider).otherwise(F.lit("r"))
    out = stash(keyed.select(code_key("lang", "source").alias("__k"), own.alias("own"), wider.alias("wider"), judge_by.alias("__g")), "mcd-pools")
    return out, out.count()


def estimate(vectors: DataFrame, many: int, share: float = SHARE, most_steps: int = MOST_STEPS) -> DataFrame:
    """(group, means, inverse root, volume) of at most ``many`` groups: from each start steps until nothing changes, then the smallest determinant."""
    join = lambda left, right: join_small(left, right, ["__g"], "inner", len(STARTS) * many)
    params = _concentrate(_started(vectors, join), share, many)
    for _ in range(most_steps - 1):
        placed = join(vectors, params).select("__g", "start", _bin(_distance()).alias("__b"), *[f"x{k}" for k in range(P)])
        after = _concentrate(placed, share, many)
        names = [f"m{k}" for k in range(P)] + ["volume"]
        moved = after.join(params.select("__g", "start", *[F.col(n).alias(f"_{n}") for n in names]), ["__g", "start"], "left").where(" OR ".join(f"NOT ({n} <=> _{n})" for n in names))
        params, settled = after, moved.isEmpty()
        if settled:
            break
    best = params.groupBy("__g").agg(F.min(F.struct("volume", "start")).alias("b")).select("__g", F.col("b.start").alias("start"))
    return params.join(best, ["__g", "start"], "left_semi").drop("start")


def judge(df: DataFrame, text: str = "text", ident: str = "doc_id", share: float = SHARE, most_steps: int = MOST_STEPS, quantile: float = QUANTILE, min_group: int = MIN_GROUP) -> DataFrame:
    """Per document: its statistics, base_failed, kept and the squared distance (null where no document at all passes the base rules)."""
    stats = text_statistics(df.select(df[ident], df["lang"], df["source"], df[text].alias("__text")), "__text")
    stats = stash(stats.withColumn("base_failed", base_failed()).select("*", *_vector()), "quality")
    pools, many = _groups(stats, min_group)
    stats = join_small(stats.withColumn("__k", code_key("lang", "source")), pools, ["__k"], "left", many)
    needed = pools.select("__g").distinct()
    vectors = stats.where(~F.col("base_failed")).select(F.explode(F.array("own", "wider", F.lit("r"))).alias("__g"), *[f"x{k}" for k in range(P)])
    vectors = stash(join_small(vectors, needed, ["__g"], "left_semi", many), "mcd-vectors")
    params = stash(estimate(vectors, many, share, most_steps), "mcd-estimate")
    judged = join_small(stats, params, ["__g"], "left", many).withColumn("distance", _distance())
    fine = F.coalesce(F.col("distance") <= chi2_quantile(quantile, P), F.lit(True))
    return judged.select(ident, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), "distance")
