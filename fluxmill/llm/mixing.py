"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source whose target is
``e`` whole times its size plus a rest takes every document ``e`` times; the rest
is fitted: first each length gives its share of its documents, which keeps the
lengths' proportions, then single documents go from the longest down while they
fit, and a bounded-knapsack dynamic program over the counts still left closes
what remains.  Where that misses the budget, the documents too long for the
program's table are chosen first, over their distinct sums, so that the others
can close the rest, and the nearer result is taken.  Which documents a length gives is decided by a seeded hash.

Null texts have length zero and are never taken more than zero words; texts of any
length are counted whole and chosen or left like any other; a null
source is a source of its own, after all others; equal hashes are ordered by id,
so reruns agree; rows that repeat count separately; an empty table gives an empty
result; extra columns are ignored.  No step puts a source's documents in one
task: counts are aggregated before their shuffle, and the seeded order is built
from hash buckets within a source and length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxmill.llm.common import code_key, join_small, stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 20240
BUCKETS = 4096
#: The largest remaining budget, in words, that the dynamic program is given.
TABLE_WORDS = 1 << 16
#: Lengths (each counted once for every power of two in its number of documents) up to which all go through the sums together.
FEW = 48


def sizes(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, source, size): whole texts, counted with built-in functions."""
    words = F.array_remove(F.split(F.coalesce(df[text], F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return df.select(df[ident].alias("doc_id"), df["source"].cast("string").alias("source"), F.size(words).cast("long").alias("size"))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares, filled up to each source's limit.

    One row per source; the level that all unfilled sources share is found by
    rounds that aggregate, at most one per source that fills.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = stash(totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))), "mix-weights")
    everything = rows.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * everything, 0.0
    limit = epochs * F.col("source_size")
    filled = F.lit(False)
    while True:
        got = rows.agg(F.sum(F.when(filled, limit).otherwise(0)).alias("full"), F.sum(F.when(~filled, F.col("weight"))).alias("open"), F.count(F.when(filled, 1)).alias("n")).first()
        if not got["open"]:
            break
        level = max(level, (budget - got["full"]) / got["open"])
        now = filled | (F.lit(level) * F.col("weight") > limit)
        if rows.where(now).count() == got["n"]:
            break
        filled = now
    return rows.select("source", "source_size", F.when(filled, limit.cast("double")).otherwise(F.least(F.lit(float(level)) * F.col("weight"), limit.cast("double"))).alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length come nearest to ``budget``, below rather than above, by exact dynamic programming.

    ``first[s]`` is the length index that first reached sum ``s``; within a length
    the fewest uses are kept, so counts are respected.  Sums beyond twice the
    budget are further off than taking nothing.
    """
    most = min(2 * budget, budget + int(lengths.max(initial=0)))
    first = np.full(most + 1, -1, np.int64)
    uses = np.zeros(most + 1, np.int64)
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    for k, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist())):
        if n <= 0 or n > most or c <= 0:
            continue
        frontier = reached.copy()
        for use in range(1, min(c, most // n) + 1):
            moved = np.zeros(most + 1, bool)
            moved[n:] = frontier[:-n]
            new = moved & ~reached
            if not new.any():
                break
            reached |= new
            first[new], uses[new] = k, use
            frontier = new
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - budget).argmin()])
    out = np.zeros(len(lengths), np.int64)
    while at:
        out[first[at]] += uses[at]
        at -= int(uses[at] * lengths[first[at]])
    return out


def subset_sums(lengths: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """The distinct sums up to ``most``, ascending, and the uses of each length that give the sum at a place.

    Counts are split into powers of two.  Beyond ``cap`` sums, one is kept in each
    of as many equal steps, and the largest.
    """
    items = []
    for k, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist())):
        c, use = min(c, most // n), 1
        while c > 0:
            use = min(use, c)
            items.append((k, use, use * n))
            c, use = c - use, 2 * use
    cap = max(1 << 10, min(TABLE_WORDS, (1 << 24) // max(1, len(items))))
    sums, back = np.zeros(1, np.int64), []
    for _, _, size in items:
        both = np.concatenate([sums, sums + size])
        both, at = np.unique(both, return_index=True)
        both, at = both[both <= most], at[: int((both <= most).sum())]
        if len(both) > cap:
            step = both * cap // (most + 1)
            keep = np.r_[True, step[1:] != step[:-1]]
            keep[-1] = True
            both, at = both[keep], at[keep]
        back.append((at.astype(np.int32), len(sums)))
        sums = both

    def uses(place: int) -> np.ndarray:
        out = np.zeros(len(lengths), np.int64)
        for (k, use, _), (at, before) in zip(reversed(items), reversed(back)):
            place = int(at[place])
            if place >= before:
                out[k] += use
                place -= before
        return out

    return sums, uses


def _close(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Each length's share of its documents, single documents from the longest down, and the knapsack for the rest."""
    extra, total = np.zeros(len(lengths), np.int64), int((lengths * counts).sum())
    if budget <= 0 or not total:
        return extra
    real = lengths > 0
    extra[real] = np.floor(counts[real] * min(1.0, budget / total)).astype(np.int64)
    left = budget - int((extra * lengths).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if left <= TABLE_WORDS:
            break
        if lengths[k] > 0 and (more := int(min(counts[k] - extra[k], (left - TABLE_WORDS // 2) // lengths[k]))) > 0:
            extra[k] += more
            left -= more * int(lengths[k])
    if 0 < left <= TABLE_WORDS:
        extra += knapsack(lengths, counts - extra, left)
    return extra


def _long_first(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents longer than half the table are chosen so that the others can close the rest; small budgets are exact."""
    if budget <= TABLE_WORDS:
        return knapsack(lengths, counts, budget)
    few = sum(int(c).bit_length() for n, c in zip(lengths, counts) if n > 0) <= FEW
    long = lengths > (0 if few else TABLE_WORDS // 2)  # of few documents, all sums at once
    rest = np.where(long, 0, counts)
    short_total, long_total = int((lengths * rest).sum()), int((lengths[long] * counts[long]).sum())
    most = min(long_total, budget + int(lengths.max(initial=0)))
    sums, uses = subset_sums(lengths[long], counts[long], most)
    # how far off the others must leave it; then near the lengths' proportions
    off = np.maximum(np.maximum(budget - short_total - sums, sums - budget), 0)
    share = budget * long_total / (long_total + short_total)
    best = None
    for place in np.lexsort((np.abs(sums - share), off))[:8].tolist():
        out = np.zeros(len(lengths), np.int64)
        out[long] = uses(place)
        out += _close(lengths, rest, budget - int(sums[place]))
        if best is None or _miss(lengths, out, budget) < _miss(lengths, best, budget):
            best = out
        if _miss(lengths, best, budget)[0] == 0:
            break
    return best


def _miss(lengths: np.ndarray, uses: np.ndarray, budget: int) -> tuple[int, int]:
    got = int((lengths * uses).sum())
    return abs(got - budget), got


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Whole passes over all documents and, per length, how many documents one pass more takes."""
    total = int((lengths * counts).sum())
    passes = min(epochs, int(target // total)) if total else 0
    extra = np.zeros(len(lengths), np.int64)
    if not total or passes >= epochs:
        return np.full(len(lengths), passes), extra
    budget = int(round(target)) - passes * total
    if budget <= 0:
        return np.full(len(lengths), passes), extra
    extra = _close(lengths, counts, budget)
    if _miss(lengths, extra, budget)[0]:
        other = _long_first(lengths, counts, budget)
        if _miss(lengths, other, budget) < _miss(lengths, extra, budget):
            extra = other
    return np.full(len(lengths), passes), extra


def mix(df: DataFrame, text: str = "text", ident: str = "doc_id", weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): how often each document is taken."""
    docs = stash(sizes(df, text, ident), "mix-sizes")
    histogram = stash(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    goal = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, epochs)
    goal = stash(goal.withColumn("__s", code_key("source")).drop("source"), "mix-targets")
    listed = histogram.groupBy(code_key("source").alias("__s")).agg(F.collect_list(F.struct("size", "n")).alias("lengths"))
    listed = listed.join(goal, "__s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, rows, target in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("__s", "lengths", "target"))):
                lengths, counts = np.array(sorted((r["size"], r["n"]) for r in rows), np.int64).T
                passes, extra = fit(lengths, counts, target, epochs)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(lengths)), pa.array(lengths), pa.array(passes.astype(np.int32)), pa.array(extra)], ["__s", "size", "passes", "extra"])

    fitted = stash(listed.mapInArrow(run, "__s string, size bigint, passes int, extra bigint"), "mix-fitted")
    # the seeded order of a source and length: by hash bucket, then by hash within the bucket
    hashed = docs.select("doc_id", "size", code_key("source").alias("__s"), F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("__h")).withColumn("__b", F.pmod(F.shiftrightunsigned("__h", 40), F.lit(BUCKETS)).cast("int"))
    keys = ["__s", "size", "__b"]
    per_bucket = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s", "size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    quota = join_small(per_bucket, fitted, ["__s", "size"], "inner", fitted.count())
    quota = quota.select(*keys, "passes", (F.col("extra") - F.col("__before")).alias("__room"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "doc_id"))
    chosen = hashed.withColumn("__place", place).join(quota, keys)
    copies = (F.col("passes") + F.when(F.col("__place") <= F.col("__room"), 1).otherwise(0)).cast("int")
    out = chosen.select("doc_id", "size", "__s", copies.alias("copies"))
    out = join_small(out, goal, ["__s"], "inner", goal.count())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
