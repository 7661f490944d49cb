"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where over half of a text's shingle hashes have it.
Distinct fingerprints are dealt by blocks of bits: within the radius at least
one choice of blocks is equal, so each fingerprint is sent once per choice and
only meets those that share its blocks.  There it is compared by tiles:
exclusive-or and bit counts on numpy arrays sorted by blocks and population count,
where tile pairs that share no blocks, or whose population counts differ beyond the
radius, are skipped.  Blocks that very many fingerprints share are dealt again as
pairs of tiles to many tasks: tiles hold one population count each, only pairs whose
counts come within the radius are sent, and a pair is compared across its sides
alone.  A task gives a spanning forest of what it linked, never all pairs; the
components of the forests are those of the links.

Null and empty texts have fingerprint zero and link like any other; texts with
fewer words than a shingle use the whole sequence; long texts are read whole, their
hashes counted a part at a time; a bit that exactly half of the hashes set is 0;
equal fingerprints are one node, so copies of any number cost one comparison; an
empty table gives an empty result; extra columns are ignored; rows with a null id
take part, and a group is named by its smallest id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxmill.llm.common import BROADCAST_ROWS, join_salted, join_small, stash
from fluxmill.llm.components import connected

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints in one tile of a task, and above how many a shared block is dealt to several tasks, as pairs of tiles of half as many.
TILE = 256
SPLIT = 4096
#: Documents of one fingerprint from which its group's name is broadcast to them instead of being shuffled.
HOT_DOCUMENTS = 100_000
#: Sides of a pair of tiles: compared across only; rows of side ALONE are compared with each other.
ALONE = 2
_LINKS = 1 << 21
_HASHES = 1 << 16  # shingle hashes whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space are special
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), 0
    spans = list(zip(starts, ends[last:]))
    for first in range(0, len(spans), _HASHES):
        part = np.array([digest(joined[a:b], SEED) for a, b in spans[first : first + _HASHES]], np.uint64)
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text: str = "text", output: str = "fingerprint", ident: str = "doc_id", also: Sequence[str] = ()) -> DataFrame:
    """(ident, also, output): the fingerprint as a signed long of the same 64 bits; narrow."""
    source = df.select(df[ident].cast("long").alias("i"), *[df[c] for c in also], df[text].alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py()) for t in b.column(len(also) + 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(also) + 1)), pa.array(prints, pa.int64())], [ident, *also, output])

    return source.mapInArrow(run, ", ".join([f"`{ident}` bigint", *(f"`{c}` {kinds[c]}" for c in also), f"`{output}` bigint"]))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what the links (a, b) connect: every other node of a tree with its smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[far]], nodes[far]


def link_tiles(key: np.ndarray, prints: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the fingerprints of equal keys within ``radius`` of each other; exact.

    Rows are sorted by key, side and population count.  A pair of tiles is skipped
    where it shares no key, where both are of one side that isn't compared with
    itself, or where all population counts differ beyond the radius.
    """
    side = np.full(len(key), ALONE, np.int8) if side is None else side.astype(np.int8)
    count = np.bitwise_count(prints).astype(np.int16)
    order = np.lexsort((count, side, key))
    k, s, p, c = key[order], side[order], prints[order], count[order]
    held_a, held_b, held = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
    for i in range(0, len(p), tile):
        x = slice(i, min(i + tile, len(p)))
        last = x.stop - 1
        for j in range(i, len(p), tile):
            if k[j] != k[last] and j > i:
                break
            y = slice(j, min(j + tile, len(p)))
            end = y.stop - 1
            if k[i] == k[end] and s[i] == s[last] and s[j] == s[end]:  # one key, one side each
                if s[i] == s[j] != ALONE or c[j] - c[last] > radius or c[i] - c[end] > radius:
                    continue
            near = np.bitwise_count(p[x, None] ^ p[None, y]) <= radius
            near &= k[x, None] == k[None, y]
            near &= (s[x, None] != s[None, y]) | (s[x, None] == ALONE)
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            held_a.append(p[i + a])
            held_b.append(p[j + b])
            held += len(a)
            if held > _LINKS:
                made = spanning(np.concatenate(held_a), np.concatenate(held_b))
                held_a, held_b, held = [made[0]], [made[1]], len(made[0])
    return spanning(np.concatenate(held_a), np.concatenate(held_b))


def _choices(radius: int, blocks: int) -> list[int]:
    """Masks of the bits that must agree: every choice of blocks - radius of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_prints(distinct: DataFrame, column: str, rows: int, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints within ``radius`` of each other.

    The number of blocks follows the number of fingerprints, so that a shared
    block has few of them; every number gives the same components.
    """
    blocks = radius + 1
    while blocks < radius + 4 and rows >> (64 * (blocks - radius) // blocks) > SPLIT // 4:
        blocks += 1
    keyed = distinct.select(F.col(column).alias("p")).select(
        "p", F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col("p").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("v")) for k, m in enumerate(_choices(radius, blocks))])).alias("k")
    ).select("p", F.col("k.c").alias("c"), F.col("k.v").alias("v"))
    keyed = stash(keyed, "simhash-keys")
    hot = stash(keyed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("c", "v"), "simhash-hot")
    alone = [F.lit(x).alias(n) for n, x in (("i", 0), ("j", 0), ("side", ALONE))]
    many = hot.count()
    dealt = keyed.select("p", "c", "v", *alone)
    if many:
        cold = join_small(keyed, hot, ["c", "v"], "left_anti", many).select("p", "c", "v", *alone)
        dealt = cold.union(_tile_pairs(join_small(keyed, hot, ["c", "v"], "left_semi", many), many, radius))
    dealt = dealt.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cut: int) -> pa.RecordBatch:
            change = np.any([h[1:cut] != h[: cut - 1] for h in held[1:5]], axis=0) if cut > 1 else np.empty(0, bool)
            a, b = link_tiles(np.r_[0, np.cumsum(change)], held[0][:cut].view(np.uint64), held[5][:cut], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["a", "b"])

        held: list[np.ndarray] = [np.empty(0, np.int64)] * 6
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            change = np.flatnonzero(np.any([h[1:] != h[:-1] for h in held[1:5]], axis=0))
            if not len(change):
                continue  # one key so far; keys hold few rows by construction
            cut = int(change[-1]) + 1  # the last key may go on
            yield flush(cut)
            held = [h[cut:] for h in held]
        if len(held[0]):
            yield flush(len(held[0]))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _tile_pairs(keyed: DataFrame, many: int, radius: int) -> DataFrame:
    """(p, c, v, i, j, side) of ``many`` hot blocks: each fingerprint once for every pair of tiles that it has to be compared in.

    A tile holds fingerprints of one population count and, where that count has
    many, of one part by hash; its number is the count times 2^16 plus the part.
    """
    rows = keyed.withColumn("w", F.bit_count("p").cast("int"))
    counts = stash(rows.groupBy("c", "v", "w").agg(F.ceil(F.count(F.lit(1)) / (SPLIT // 2)).cast("int").alias("k")), "simhash-tiles")
    # at most 65 counts a block
    spread = counts.groupBy("c", "v").agg(F.map_from_entries(F.collect_list(F.struct("w", "k"))).alias("parts"))
    rows = join_small(rows, spread, ["c", "v"], "inner", many)
    part = lambda w: F.coalesce(F.try_element_at("parts", w), F.lit(0))
    own = F.col("w") * 65536 + F.pmod(F.xxhash64("p", F.lit(7)), part(F.col("w"))).cast("int")
    near = F.filter(F.sequence(F.col("w") - radius, F.col("w") + radius), lambda w: part(w) > 0)
    others = F.flatten(F.transform(near, lambda w: F.transform(F.sequence(F.lit(0), part(w) - 1), lambda x: w * 65536 + x)))
    out = rows.select("p", "c", "v", own.alias("t"), F.explode(others).alias("o"))
    side = F.when(F.col("t") == F.col("o"), F.lit(ALONE)).when(F.col("t") < F.col("o"), F.lit(0)).otherwise(F.lit(1))
    return out.select("p", "c", "v", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), side.alias("side"))


def hex16(column: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id", radius: int = RADIUS, also: Sequence[str] = ()) -> DataFrame:
    """(ident, fingerprint, component_id, also) per row of ``df``."""
    prints = stash(with_fingerprint(df, text, "p", ident, also), "simhash")
    distinct = stash(prints.groupBy("p").agg(F.min(ident).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    linked = connected(stash(link_prints(distinct, "p", distinct.count(), radius), "simhash-links"))
    # a fingerprint without links names its own group; of the linked ones, a group of any size is named by an aggregate
    linked = stash(linked.withColumnRenamed("node", "p").join(distinct.select("p", "least"), "p"), "simhash-linked")
    named = stash(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    by_root = join_salted(linked.select("p", "root"), named, "root", named.count(), F.col("p")).select("p", F.col("component_id").alias("of"))
    by_print = stash(distinct.join(by_root, "p", "left").select("p", F.when(F.col("of").isNull() & F.col("least").isNotNull(), F.col("least")).otherwise(F.col("of")).alias("component_id"), "n"), "simhash-groups")
    # fingerprints of very many documents (at most one for every HOT_DOCUMENTS rows) are looked up in place, the others by a shuffle
    hot = by_print.where(F.col("n") >= HOT_DOCUMENTS).select("p", "component_id")
    out = [prints.join(by_print.select("p", "component_id"), "p", "left")]
    if many := hot.count():
        out = [prints.join(F.broadcast(hot), "p"), prints.join(F.broadcast(hot.select("p")), "p", "left_anti").join(by_print.select("p", "component_id"), "p", "left")] if many <= BROADCAST_ROWS else out
    return reduce(DataFrame.unionByName, [x.select(ident, hex16("p").alias("fingerprint"), "component_id", *also) for x in out])
