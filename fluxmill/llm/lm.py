"""Masked pseudo-likelihood with a bidirectional window network.

Every word is predicted from the two words on each of its sides; a document's
score is the sum of the conditional log-probabilities.

*Words.*  The corpus's ``OWN`` most frequent words have an embedding and an output
row of their own; the others share ``BUCKETS`` hashed rows, and one row is the
document's edge.  The network's output is a softmax in two steps, over clusters of
rows and over the rows of one cluster, so a word's probability costs the square
root of their number.  Within a bucket a word has its probability from the exact
counts of all words of the corpus, less those of the document that is scored: with
n of the N tokens of V words elsewhere, (n - D) / N; a word that occurs nowhere else
takes its part of the mass D * V / N left over, by the probability of its spelling
under a byte-bigram model of the corpus's words.  So a text of rare words scores
lower than one of common words, and a text whose words are its own lower still.

*Memory.*  Within its corpus, a document is scored by what stands in all the others.
A line's probability is a mixture: the product of its words' with weight 1 - MEMORY,
and with weight MEMORY the line's share of all lines of the other documents.  So a
document whose lines others repeat scores apart.  Words and lines are looked up by
64 bits of a hash.

*Training.*  Every position of every document is masked and predicted once; the
documents are dealt over ``ROUNDS`` rounds by a hash of their text.  In a round, each
partition of the corpus trains the common network by stochastic gradients (Adagrad,
numpy; batches grow with a partition's words) and ships its change; changes are averaged block by block, each parameter
over the partitions that moved it.  The network starts as the exact unigram model.  Nothing
that is collected or broadcast grows with the corpus: the frequent words, the
network, the buckets' totals, the byte table and the counts of the ``COUNTED`` most
frequent words have fixed bounds.  The word table
grows with the corpus and is never in one place: documents are dealt into chunks,
and each chunk is sent the counts of its own rare words.

Null and empty texts have no tokens, log-likelihood 0 and a null mean; long texts
are trained on and scored whole; frequent words tie by code point; rows that
repeat are counted as often as they occur and score alike; reruns over the same
files and splits train the same network (other splits another one, close by); an
empty table trains nothing and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxmill.llm.common import stash

OWN = 20_000
BUCKETS = 512
COUNTED = 200_000  # words whose counts are sent to all tasks; only rarer ones are looked up
DIM = 16
HIDDEN = 16
SIDE = 2  # neighbours on each side
ROUNDS = 2
BATCH, LEAST_BATCH = 32_768, 4096
STEPS = 48  # of a partition in a round, where its words make batches between these sizes
RATE = 0.15
DISCOUNT = 0.75
MEMORY = 0.1
EDGE = 0
PARTITION_TOKENS = 1_000_000  # least tokens that a training partition has, so that what it ships is small beside what it reads
_FLUSH = 4_000_000  # words a task counts before it passes them on
_PORTION = 1 << 22  # characters that are split at once, one text at least
_KNOWN = 300_000
_CHUNK = 2_000_000  # words of a chunk, one document at least
_BLOCK = 2048  # parameters in a shipped row
_SLICE = 512  # positions whose logits are held at once, within a core's cache
_NEAR = 4096  # positions whose neighbours are gathered at once
_WAITING = 1 << 17  # words that are scored together


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, in lower case, as UTF-8."""
    return text.lower().encode().split() if text else []


def portions(texts: Iterable[str | None], most: int) -> Iterator[list[str | None]]:
    """The texts in order, some of them at a time: about ``most`` characters, one text at least."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "") + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def lowered(texts: list[str | None]) -> pa.Array:
    return pa.array([t.lower() if t else "" for t in texts], pa.string())


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words`` of lowered texts, in one array, and how many each text has."""
    found = pc.ascii_split_whitespace(texts)
    flat, ends = found.values, found.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at a text's ends leaves empty words there
    return flat.filter(pa.array(full)), np.diff(np.r_[0, np.cumsum(full)][ends])


def raw(held: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an array's strings, where each begins and its size."""
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64) if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(held) else np.zeros(0, np.uint8)
    return data, ends[:-1] - ends[0], np.diff(ends)


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ 0xEDB88320, _CRC >> 1).astype(np.uint32)


def crc32(held: pa.Array, side: int = 32) -> np.ndarray:
    """zlib.crc32 of an array's strings: their first ``side`` bytes side by side, the rest of longer ones one by one."""
    data, starts, sizes = raw(held)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    got = np.full(len(held), 0xFFFFFFFF, np.uint32)
    for k in range(min(side, int(sizes[0])) if len(held) else 0):
        some = got[: np.searchsorted(-sizes, -k)]
        some[:] = _CRC[(some ^ data[starts[: len(some)] + k]) & 255] ^ some >> 8
    got ^= 0xFFFFFFFF
    for k in range(np.searchsorted(-sizes, -side)):
        got[k] = zlib.crc32(data[starts[k] + side : starts[k] + sizes[k]], int(got[k]))
    out = np.empty_like(got)
    out[order] = got
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; tasks count their own words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def rows() -> pa.RecordBatch:
            counts = pc.value_counts(pa.chunked_array(held, pa.string()))
            held.clear()
            return pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])

        for some in portions((t.as_py() for b in batches for t in b.column(0)), _PORTION):
            held.append(tokens(lowered(some))[0])
            if sum(map(len, held)) >= _FLUSH:
                yield rows()
        if held:
            yield rows()

    return docs.select(F.col(text)).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte follows each in the distinct words, byte 0 standing before and after a word; (256, 256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.frombuffer(b"\0" + b"\0".join(b.column(0).cast(pa.binary()).to_pylist()) + b"\0", np.uint8).astype(np.int64)
            total += np.bincount(flat[:-1] << 8 | flat[1:], minlength=1 << 16)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], ["pair", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in words.select("word").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(256, 256)


def spelling(table: np.ndarray) -> np.ndarray:
    """Log-probability of each byte after each, from ``byte_counts``."""
    return np.log((table + 1 / 16) / (table.sum(1, keepdims=True) + 16))


def spelled(held: list[bytes] | pa.Array, log: np.ndarray) -> np.ndarray:
    """Log-probability of each word's bytes and its end."""
    if not len(held):
        return np.empty(0)
    data, starts, sizes = raw(held if isinstance(held, pa.Array) else pa.array(held, pa.binary()))
    starts = starts + np.arange(len(held))
    flat = np.zeros(len(data) + len(held) + 1, np.int64)
    flat[np.arange(1, len(data) + 1) + np.repeat(np.arange(len(held)), sizes)] = data
    return np.add.reduceat(log.reshape(-1)[flat[:-1] << 8 | flat[1:]], starts)


def layout(own: int, buckets: int) -> tuple[int, int]:
    """Rows of a cluster, and the first bucket's row, which begins a cluster of its own."""
    per = max(1, int(np.ceil(np.sqrt(own + buckets))))
    return per, -(-own // per) * per + 1


class Coder(dict):
    """Words to rows: the edge, the frequent words in order, then the buckets; rare words are remembered for a while."""

    def __init__(self, frequent: list[str], buckets: int = BUCKETS):
        self.first, self.buckets = layout(len(frequent), buckets)[1], buckets
        self.own = {w.encode(): k + 1 for k, w in enumerate(frequent)}
        self.listed = pa.array(frequent, pa.string())
        super().__init__(self.own)

    def __missing__(self, word: bytes) -> int:
        return self.bucket(word)

    def bucket(self, word: bytes) -> int:
        if len(self) >= _KNOWN + len(self.own):
            self.clear()
            self.update(self.own)
        got = self[word] = self.first + zlib.crc32(word) % self.buckets
        return got

    def rows(self, held: list[bytes]) -> list[int]:
        return list(map(self.__getitem__, held))

    def encode(self, held: pa.Array) -> np.ndarray:
        """``rows`` of an array of words; each distinct word is looked up once."""
        found = held.dictionary_encode()
        rows = pc.index_in(found.dictionary, value_set=self.listed).fill_null(-1).to_numpy() + np.int32(1)
        rare = np.flatnonzero(rows == 0)
        rows[rare] = self.first + crc32(found.dictionary.take(pa.array(rare))) % self.buckets
        return rows[found.indices.to_numpy()]


def stream(coded: Sequence[Sequence[int]]) -> np.ndarray:
    """The rows of several texts with edges between and around them."""
    gap = np.full(SIDE, EDGE, np.int32)
    out = [gap]
    for c in coded:
        out += (np.asarray(c, np.int32), gap)
    return np.concatenate(out)


def windows(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Neighbours of each place, (places, 2 * SIDE)."""
    return np.stack([flat[places + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]).T


class Network:
    """Embeddings of the neighbours, by position, feed a hidden layer; a two-step softmax predicts the row between them."""

    NAMES = ("embed", "mix", "shift", "top", "top_bias", "out", "out_bias")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts
        self.per = parts["out"].shape[1]

    @classmethod
    def fresh(cls, counts: np.ndarray, buckets: np.ndarray, dim: int = DIM, hidden: int = HIDDEN, seed: int = 5, dtype=np.float32) -> Network:
        """``counts`` of the frequent words and of the buckets. The fresh network predicts exactly their shares, whatever the window."""
        rng = np.random.default_rng(seed)
        per, first = layout(len(counts), len(buckets))
        clusters = (first - 1) // per + -(-len(buckets) // per)
        mass = np.zeros(clusters * per)
        mass[: len(counts)] = counts + 0.5
        mass[first - 1 : first - 1 + len(buckets)] = buckets + 0.5
        n = clusters * per
        mass = mass.reshape(clusters, per)
        with np.errstate(divide="ignore"):
            bias = np.maximum(np.log(mass / mass.sum(1, keepdims=True)), -1e9)
        parts = {
            "embed": rng.standard_normal((n + 1, dim)) * 0.5,
            "mix": rng.standard_normal((2 * SIDE, dim, hidden)) / np.sqrt(2 * SIDE * dim),
            "shift": np.zeros(hidden),
            "top": np.zeros((hidden, clusters)),
            "top_bias": np.log(mass.sum(1) / mass.sum()),
            "out": np.zeros((clusters, per, hidden)),
            "out_bias": bias,
        }
        return cls({k: v.astype(dtype) for k, v in parts.items()})

    @property
    def _rows(self) -> type:
        """A type of rows that sorts by radix, if they fit it."""
        return np.uint16 if len(self.p["embed"]) < 1 << 16 else np.int64

    def _stacked(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of both softmaxes, their biases as a last row."""
        return np.vstack([self.p["top"], self.p["top_bias"]]), np.concatenate([self.p["out"].transpose(0, 2, 1), self.p["out_bias"][:, None]], 1)

    @cached_property
    def _mixed(self) -> np.ndarray:
        """What each row adds to the hidden layer at each place around a word; for a network that isn't trained any more."""
        return np.stack([self.p["embed"] @ m for m in self.p["mix"]])

    @cached_property
    def _bounded(self) -> bool:
        """Can no logit of a hidden layer within -1 and 1 pass what an exponential holds? For a network that isn't trained any more."""
        top = np.abs(self.p["top"]).sum(0) + self.p["top_bias"]
        return max(float(top.max()), float((np.abs(self.p["out"]).sum(2) + self.p["out_bias"]).max())) < 60

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target row between its neighbours. Sorted by target, a cluster's places lie together."""
        p, n, kind = self.p, len(target), self.p["shift"].dtype
        if not n:
            return np.empty(0)
        order = np.argsort(target.astype(self._rows), kind="stable")
        cluster, slot = np.divmod(target[order] - 1, self.per)
        size = len(p["shift"])
        h, near = np.ones((n, size + 1), kind), np.empty((min(n, _NEAR), size), kind)  # the last column meets the bias
        for k in range(0, n, _NEAR):
            around = context[order[k : k + _NEAR]]
            room = near[: len(around)]
            h[k : k + _NEAR, :size] = p["shift"]
            for d in range(2 * SIDE):
                h[k : k + _NEAR, :size] += np.take(self._mixed[d], around[:, d], 0, room, "clip")
            np.tanh(h[k : k + _NEAR, :size], out=h[k : k + _NEAR, :size])
        top, low = self._stacked()
        room, count, ones = np.empty(min(n, _SLICE) * max(top.shape[1], self.per), kind), np.arange(_SLICE), np.ones(max(top.shape[1], self.per), kind)
        mine, total = np.empty((2, n), kind), np.empty((2, n), kind)

        def descend(which: int, w: np.ndarray, a: int, b: int, at: np.ndarray) -> None:
            z = np.matmul(h[a:b], w, out=room[: (b - a) * w.shape[1]].reshape(b - a, -1))
            if not self._bounded:
                z -= z.max(1, keepdims=True)
            mine[which, a:b] = z[count[: b - a], at[a:b]]
            np.exp(z, out=z)
            np.matmul(z, ones[: w.shape[1]], out=total[which, a:b])

        for k in range(0, n, _SLICE):
            descend(0, top, k, min(k + _SLICE, n), cluster)
        cuts = np.flatnonzero(np.r_[True, np.diff(cluster) != 0, True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for k in range(a, b, _SLICE):
                descend(1, low[cluster[a]], k, min(k + _SLICE, b), slot)
        out = np.empty(n)
        out[order] = (mine - np.log(total)).sum(0)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of a batch, and its gradient: of the embeddings as (places, values).

        The batch is sorted by its targets, so that a cluster's places and a row's lie
        together. A softmax's gradient is taken as what it expects less what was there,
        and divided by its total in the narrow factor, so its wide one is passed once.
        """
        p, n, kind = self.p, len(target), self.p["shift"].dtype
        order = np.argsort(target.astype(self._rows), kind="stable")
        target, around = target[order], context[order]
        size, (top, low) = len(p["shift"]), self._stacked()
        h = np.ones((n, size + 1), kind)  # the last column meets the bias
        near, mix = np.empty((n, 2 * SIDE, p["embed"].shape[1]), kind), p["mix"].reshape(-1, size)
        for k in range(0, n, _NEAR):
            part = slice(k, min(k + _NEAR, n))
            into = np.take(p["embed"], around[part], 0, near[part], "clip").reshape(-1, len(mix)) @ mix
            into += p["shift"]
            np.tanh(into, out=h[part, :size])
        bounded = [float((np.abs(w[..., :size, :]).sum(-2) + w[..., size, :]).max()) < 60 for w in (top, low)]
        cluster, slot = np.divmod(target - 1, self.per)
        dh, extra = np.empty((n, size), kind), np.empty((_SLICE, size), kind)
        wide = max(top.shape[1], self.per)
        room, count, ones = np.empty(min(n, _SLICE) * wide, kind), np.arange(_SLICE), np.ones(wide, kind)
        mine, total = np.empty((2, n), kind), np.empty((2, n), kind)

        def descend(which: int, w: np.ndarray, back: np.ndarray, a: int, b: int, at: np.ndarray, into: np.ndarray) -> np.ndarray:
            """What a slice of the batch expects of a softmax's weights; its part of the loss, and ``into`` what it expects of the rows."""
            z = np.matmul(h[a:b], w, out=room[: (b - a) * w.shape[1]].reshape(b - a, -1))
            if not bounded[which]:
                z -= z.max(1, keepdims=True)
            mine[which, a:b] = z[count[: b - a], at[a:b]]
            np.exp(z, out=z)
            share = 1 / np.matmul(z, ones[: w.shape[1]], out=total[which, a:b])[:, None]
            np.matmul(z, back, out=into)
            into *= share
            return (h[a:b] * share).T @ z

        d_top, d_low, back = np.zeros_like(top), np.zeros_like(low), np.ascontiguousarray(p["top"].T)
        for k in range(0, n, _SLICE):
            d_top += descend(0, top, back, k, min(k + _SLICE, n), cluster, dh[k : k + _SLICE])
        cuts = np.flatnonzero(np.r_[True, np.diff(cluster) != 0, True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            g = cluster[a]
            dh[a:b] -= back[g]
            for k in range(a, b, _SLICE):
                to = min(k + _SLICE, b)
                d_low[g] += descend(1, low[g], p["out"][g], k, to, slot, extra[: to - k])
                dh[k:to] += extra[: to - k]
        dh -= np.take(p["out"].reshape(-1, size), target - 1, 0)
        loss = float(np.log(total).sum(dtype=np.float64) - mine.sum(dtype=np.float64))
        first = np.flatnonzero(np.r_[True, np.diff(target) != 0])
        there = np.add.reduceat(h, first, axis=0)
        d_low[cluster[first], :, slot[first]] -= there
        d_top[:, cluster[cuts[:-1]]] -= np.add.reduceat(there, np.searchsorted(first, cuts[:-1]), axis=0).T
        d_top /= n
        d_low /= n
        grads: dict = {"top": d_top[:size], "top_bias": d_top[size], "out": d_low[:, :size].transpose(0, 2, 1), "out_bias": d_low[:, size]}
        hidden = h[:, :size]
        da = dh * (1 - hidden * hidden)
        da /= n
        grads["shift"] = da.sum(0)
        grads["mix"] = (near.reshape(n, -1).T @ da).reshape(p["mix"].shape)
        moved = (p["mix"].transpose(1, 0, 2).reshape(-1, size) @ da.T).reshape(near.shape[2], -1)  # of each value of an embedding, by neighbours
        places = around.T.reshape(-1).astype(np.int64)
        grads["embed"] = np.stack([np.bincount(places, m, len(p["embed"])) for m in moved], 1).astype(kind)
        return loss / n, grads

    def update(self, grads: dict, squares: dict[str, np.ndarray], rate: float) -> None:
        """One step of Adagrad."""
        for name, g in grads.items():
            at, value = g if isinstance(g, tuple) else (slice(None), g)
            squares[name][at] += value * value
            self.p[name][at] -= rate * value / (np.sqrt(squares[name][at]) + 1e-8)

    def dump(self) -> np.ndarray:
        return np.concatenate([self.p[n].reshape(-1) for n in self.NAMES])

    def like(self, flat: np.ndarray) -> Network:
        """A network of this one's shapes with other parameters."""
        out, at = {}, 0
        for n in self.NAMES:
            size = self.p[n].size
            out[n] = flat[at : at + size].reshape(self.p[n].shape).astype(self.p[n].dtype)
            at += size
        return Network(out)


def fit_partition(net: Network, texts: Iterator[str | None], coder: Coder, seed: tuple[int, ...], rate: float, masked: float = 1.0, batch: int = LEAST_BATCH) -> tuple[Network, int, float]:
    """The network after one pass over all positions of the texts (a seeded share of them, if ``masked`` says so), how many they were, and their mean loss on the way."""
    net = net.like(net.dump())
    squares = {n: np.zeros_like(x) for n, x in net.p.items()}
    rng, held, size, done, loss = np.random.default_rng(seed), [], 0, 0, 0.0

    def step(flat: np.ndarray) -> None:
        nonlocal done, loss
        places = np.flatnonzero(flat != EDGE)
        if masked < 1:
            places = places[rng.random(len(places)) < masked]
        rng.shuffle(places)
        for k in range(0, len(places), batch):
            part = places[k : k + batch]
            one, grads = net.gradient(windows(flat, part), flat[part])
            net.update(grads, squares, rate)
            done += len(part)
            loss += one * len(part)

    for some in portions(texts, _PORTION):
        found, sizes = tokens(lowered(some))
        for one in np.split(coder.encode(found), np.cumsum(sizes)[:-1]):
            held.append(one)
            size += len(one)
            if size * masked >= 8 * batch:
                step(stream(held))
                held, size = [], 0
    if held:
        step(stream(held))
    return net, done, loss / max(done, 1)


class Model(tuple):
    """(frequent words, network's parameters, tokens and words counted in each bucket, byte table, counts of the next most frequent words), of bounded size, and the table (word, n) of all words."""

    words: DataFrame
    losses: list[float]

    @classmethod
    def of(cls, frequent: list[str], network: dict, buckets: tuple[tuple[int, int], ...], log: np.ndarray, counted: dict[bytes, int], words: DataFrame, losses: list[float]) -> Model:
        out = cls((frequent, network, buckets, log, counted))
        out.words, out.losses = words, losses
        return out


def _bucket(buckets: int):
    """The bucket of a column of words, as ``Coder.bucket`` has it."""
    return F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(buckets)).cast("int")


def _round(docs: DataFrame, frequent: list[str], net: Network, number: int, rounds: int, rate: float, buckets: int, masked: float, batch: int) -> tuple[Network, float]:
    """Every partition trains the network on its documents; their changes are averaged, each parameter over those that moved it."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = shared.value
        start = Network(parts)
        after, done, loss = fit_partition(start, (t.as_py() for b in batches for t in b.column(0)), Coder(own, buckets), (7, number, TaskContext.get().partitionId()), rate, masked, batch)
        if not done:
            return
        change = (after.dump() - start.dump()).astype(np.float16)
        blocks = -(-len(change) // _BLOCK)
        for k in range(0, blocks, 512):
            some = range(k, min(k + 512, blocks))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([done] * len(some), pa.int64()), pa.array([change[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in some], pa.binary()), pa.array([loss] * len(some))], ["block", "n", "change", "loss"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # of one block at a time; blocks arrive in order

        def flush() -> Iterator[pa.RecordBatch]:
            for b, (top, low, loss, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([(top / np.maximum(low, 1)).astype(np.float32).tobytes()], pa.binary()), pa.array([loss / n])], ["block", "change", "loss"])
            held.clear()

        for batch in batches:
            for b, n, data, loss in zip(*(batch.column(k).to_pylist() for k in range(4))):
                change = np.frombuffer(data, np.float16).astype(np.float64)
                if b not in held:
                    yield from flush()
                    held[b] = [np.zeros(len(change)), np.zeros(len(change)), 0.0, 0]
                got = held[b]
                got[0] += n * change
                got[1] += n * (change != 0)
                got[2] += n * loss
                got[3] += n
        yield from flush()

    dealt = docs.where(F.pmod(F.xxhash64(docs.columns[0], F.lit(9)), F.lit(rounds)) == number)
    shipped = dealt.mapInArrow(run, "block int, n bigint, change binary, loss double")
    rows = shipped.repartition("block").sortWithinPartitions("block", "n", "loss").mapInArrow(average, "block int, change binary, loss double").collect()
    if not rows:
        return net, float("nan")
    flat = net.dump()
    for r in rows:
        change = np.frombuffer(r["change"], np.float32)
        flat[r["block"] * _BLOCK : r["block"] * _BLOCK + len(change)] += change
    return net.like(flat), rows[0]["loss"]


def _cut(table: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach; from how many words each count has, an aggregate of few rows."""
    sizes = table.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    above = Window.orderBy(F.col("n").desc())
    reached = sizes.orderBy(F.col("n").desc()).limit(max(most, 1)).withColumn("k", F.sum("k").over(above)).where(F.col("k") <= most)
    return reached.agg(F.min("n")).first()[0] or (1 << 62)


def _frequent(table: DataFrame, most: int) -> list[tuple[str, int]]:
    """The ``most`` most frequent words, of equal counts the first by code point; tasks pass on no more than the words near the cut."""
    cut = _cut(table, most)
    sure = [(r["word"], r["n"]) for r in table.where(F.col("n") >= cut).collect()]
    if most > len(sure):  # words of the next count, as many as are left
        below = table.where(F.col("n") < cut)
        following = below.agg(F.max("n")).first()[0]
        if following is not None:
            sure += [(r["word"], r["n"]) for r in below.where(F.col("n") == following).orderBy("word").limit(most - len(sure)).collect()]
    return sorted(sure, key=lambda r: (-r[1], r[0]))


def _counted(table: DataFrame, most: int) -> list[tuple[str, int]]:
    """All words whose counts at most ``most`` words reach."""
    return [(r["word"], r["n"]) for r in table.where(F.col("n") >= _cut(table, most)).collect()] if most else []


def train(docs: DataFrame, text: str = "text", own: int = OWN, buckets: int = BUCKETS, dim: int = DIM, hidden: int = HIDDEN, rounds: int = ROUNDS, masked: float = 1.0, rate: float = RATE, counted: int = COUNTED) -> Model:
    """The model. Only its parts of fixed size reach the driver."""
    table = stash(word_counts(docs, text), "lm-words")
    top = _frequent(table, own)
    more = _counted(table, counted)
    frequent = [w for w, _ in top]
    more = {w.encode(): n for w, n in more}
    for w in frequent:
        more.pop(w.encode(), None)
    spark = docs.sparkSession
    listed = spark.createDataFrame([(w,) for w in frequent], "word string")
    tail = table.join(F.broadcast(listed), "word", "left_anti")  # at most ``own`` words
    sizes = {r["b"]: (r["n"], r["v"]) for r in tail.groupBy(_bucket(buckets).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    held = tuple(sizes.get(k, (0, 0)) for k in range(buckets))
    counts, rest = np.array([n for _, n in top], np.float64), np.array([n for n, _ in held], np.float64)
    net, losses = Network.fresh(counts, rest, dim, hidden), []
    texts = docs.select(F.col(text)).where(F.col(text).isNotNull())
    tokens = int(counts.sum() + rest.sum())
    fit, held_in = max(1, tokens // PARTITION_TOKENS), texts.rdd.getNumPartitions()
    if held_in > fit:
        texts = texts.coalesce(fit)
    batch = min(max(tokens // (max(min(held_in, fit), 1) * rounds * STEPS), LEAST_BATCH), BATCH)
    for k in range(rounds):
        net, loss = _round(texts, frequent, net, k, rounds, rate * 0.6**k, buckets, masked, batch)
        losses.append(loss)
    return Model.of(frequent, net.p, held, spelling(byte_counts(table)), more, table, losses)


def keys(texts: Sequence[bytes]) -> np.ndarray:
    """What Spark's xxhash64 makes of the texts."""
    return np.array(list(map(xxhash.xxh64_intdigest, texts, repeat(42))), np.uint64).view(np.int64)


def rare_scores(document: np.ndarray, tail: np.ndarray, net: np.ndarray, n: np.ndarray, spell: np.ndarray, bucket: np.ndarray, tokens: np.ndarray, types: np.ndarray, within: bool) -> np.ndarray:
    """Log-probabilities of rare words, of the given documents, at places ``tail`` in a list of words that occur ``n`` times (within the corpus, 0 for once).

    ``net`` are the network's log-probabilities of their buckets.
    """
    if not len(tail):
        return np.zeros(0)
    pairs, at, mine = np.unique(document.astype(np.int64) << 32 | tail, return_inverse=True, return_counts=True)
    places = pairs & 0xFFFFFFFF
    b = bucket[places]
    left = np.maximum(n[places] - mine, 0) if within else n[places]
    total, kinds = tokens[b].astype(np.float64), types[b].astype(np.float64)
    if within:
        _, own = np.unique((pairs >> 32) * len(tokens) + b, return_inverse=True)  # a document's words of one bucket
        total -= np.bincount(own, mine)[own]
        kinds -= np.bincount(own, left == 0)[own]
    safe = np.maximum(total, 1)
    seen = np.log(np.maximum(left - DISCOUNT, 1e-9) / safe)
    mass = np.where(total > 0, np.log(np.maximum(DISCOUNT * kinds, 1e-9) / safe), 0.0)
    return net + np.where(left > 0, seen, mass + spell[places] + np.log(len(tokens)))[at]


def recalled(document: np.ndarray, values: np.ndarray, places: np.ndarray, every: np.ndarray, lines: int) -> np.ndarray:
    """The lines' log-likelihoods, given ``values`` without memory, at ``places`` in a list of lines that occur ``every`` times among ``lines``."""
    unique, at, mine = np.unique(document.astype(np.int64) << 32 | places, return_inverse=True, return_counts=True)
    other = np.maximum(every[unique & 0xFFFFFFFF] - mine, 0)[at]
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(1 - MEMORY) + values, np.log(MEMORY * other / np.maximum(lines - np.bincount(document)[document], 1)))


def score(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id", buckets: int = BUCKETS, within: bool = True) -> DataFrame:
    """(ident, n_tokens, log_likelihood, mean_log_likelihood): natural logarithms, summed over a text's words.

    ``within``: the documents are the corpus that was counted, so each is scored by
    the counts of all the others, and its lines by theirs.  Texts stay where they
    are; a chunk's distinct rare words go to the word table and its distinct lines
    to the other chunks', and the counts of those that occur elsewhere come back to
    the chunk's documents, which hold places in its lists.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    source = docs.select(docs[ident].alias("i"), docs[text].alias("t"))
    kind = source.schema["i"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, parts, _, log, counted = shared.value
        coder, net = Coder(frequent, buckets), Network(parts)
        more, times = pa.array(list(counted), pa.string()), np.array([0, *counted.values()], np.int64)
        part, done = TaskContext.get().partitionId(), 0
        idents, sizes, lines_of = [], [], []  # of the chunk's documents: id, words, lines
        coded, line_sizes = [], []  # of the texts that wait: rows, and how many words each line has
        common, rares, net_values, rare_rows = [], [], [], []  # of the chunk's lines: frequent words' sum, rare words; of the rare words: the network's value, row
        tail: list[pa.Array] = []  # the rare words
        line_names: list[pa.Array] = []
        many = waiting = 0
        schema = None

        def predict() -> None:
            """Log-likelihoods of the texts that wait, line by line, without their rare words' parts."""
            nonlocal waiting
            flat = stream(coded)
            at = np.flatnonzero(flat != EDGE)
            found = flat[at]
            values = np.concatenate([np.zeros(0), *(net.log_probabilities(windows(flat, at[k : k + _WAITING]), found[k : k + _WAITING]) for k in range(0, len(at), _WAITING))])
            rare = found >= coder.first
            cuts = np.cumsum([0, *line_sizes])
            common.append(np.diff(np.concatenate([np.zeros(1), np.where(rare, 0.0, values)]).cumsum()[cuts]).astype(np.float32))
            rares.append(np.diff(np.concatenate([np.zeros(1, np.int64), rare]).cumsum()[cuts]).astype(np.int32))
            net_values.append(values[rare].astype(np.float16))
            rare_rows.append(found[rare] - coder.first)
            coded.clear()
            line_sizes.clear()
            waiting = 0

        def listed(held: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
            """The distinct ones of all, and each one's place among them."""
            found = pa.chunked_array(held, pa.string()).combine_chunks().dictionary_encode()
            return found.dictionary, found.indices.to_numpy()

        arrays = ("lines_of", "common", "rares", "net", "tail", "lines", "bucket", "spell", "counted")

        def batch(n: int, /, **given) -> pa.RecordBatch:
            kinds = {"chunk": pa.int64(), "kind": pa.int32(), "ident": schema.field(0).type, "size": pa.int64(), **dict.fromkeys(arrays, pa.binary()), "key": pa.int64(), "place": pa.int32(), "n": pa.int64()}
            given["chunk"] = np.full(n, (part << 32) + done)
            given["kind"] = np.full(n, given["kind"], np.int32)
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal done, many
            predict()
            held, places = listed(tail)
            bucket = np.zeros(len(held), "<i4")
            bucket[places] = np.concatenate(rare_rows)
            yield batch(len(idents), kind=0, ident=idents, size=sizes, place=np.arange(len(idents), dtype=np.int32))
            known = times[pc.index_in(held, value_set=more).fill_null(-1).to_numpy() + 1]
            names, line_places = listed(line_names)
            made = (np.array(lines_of, "<i4"), *(np.concatenate(x) for x in (common, rares, net_values)), places.astype("<i4"), line_places.astype("<i4"), bucket, spelled(held, log).astype(np.float16), known)
            yield batch(1, kind=1, **{c: [a.tobytes()] for c, a in zip(arrays, made)})
            asked = np.flatnonzero(known == 0).astype(np.int32)
            for k in range(0, len(asked), 1 << 17):
                cut = asked[k : k + (1 << 17)]
                yield batch(len(cut), kind=2, key=keys(held.take(pa.array(cut)).to_pylist()), place=cut)
            line_counts = np.bincount(line_places, minlength=len(names))
            for k in range(0, len(names), 1 << 17):
                cut = names.slice(k, 1 << 17).to_pylist()
                yield batch(len(cut), kind=3, key=keys(cut), place=np.arange(k, k + len(cut), dtype=np.int32), n=line_counts[k : k + len(cut)])
            for x in (idents, sizes, lines_of, common, rares, net_values, rare_rows, tail, line_names):
                x.clear()
            done, many = done + 1, 0

        for b in batches:
            schema, after = b.schema, b.column(0).to_pylist()
            for some in portions((t.as_py() for t in b.column(1)), min(_PORTION, 2 * _CHUNK)):
                split = pc.split_pattern(lowered(some), "\n")
                found, in_line = tokens(split.values)
                made = coder.encode(found)
                ends = np.r_[0, np.cumsum(in_line)]
                if within:
                    line_names.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ").filter(pa.array(in_line > 0)))
                tail.append(found.filter(pa.array(made >= coder.first)))
                line_sizes += in_line[in_line > 0].tolist()
                cuts = split.offsets.to_numpy()
                in_text = np.diff(ends[cuts])
                coded += np.split(made, np.cumsum(in_text)[:-1])
                sizes += in_text.tolist()
                lines_of += np.diff(np.r_[0, np.cumsum(in_line > 0)][cuts]).tolist()
                idents += after[: len(some)]
                del after[: len(some)]
                many += len(made)
                waiting += len(made)
                if waiting >= _WAITING:
                    predict()
                if many >= _CHUNK or len(idents) >= 50_000:
                    yield from rows()
        if idents:
            yield from rows()

    kinds = f"chunk bigint, kind int, ident {kind}, size bigint, lines_of binary, common binary, rares binary, net binary, tail binary, lines binary, bucket binary, spell binary, counted binary, key bigint, place int, n bigint"
    parts = stash(source.mapInArrow(chunks, kinds), "lm-chunks")
    table = model.words.where(F.col("n") > int(within)).select(F.xxhash64("word").alias("key"), "n")
    told = parts.where("kind = 2").select("key", "chunk", "place").join(table.hint("merge"), "key").select(F.col("chunk").alias("of"), F.lit(2).alias("what"), F.col("place").alias("at"), F.col("n").alias("times"))
    lines = 0
    if within:
        asked = parts.where("kind = 3").select("key", "chunk", "place", "n")
        lines = asked.agg(F.sum("n")).first()[0] or 0
        repeated = asked.groupBy("key").agg(F.sum("n").alias("every")).where("every > 1")
        told = told.unionByName(asked.drop("n").join(repeated.hint("merge"), "key").select(F.col("chunk").alias("of"), F.lit(3).alias("what"), F.col("place").alias("at"), F.col("every").alias("times")))
    texts = parts.where("kind < 2").drop("key", "n")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, types = np.array(shared.value[2], np.int64).reshape(-1, 2).T
        about = left.filter(pc.equal(left.column("kind"), 1))
        left = left.filter(pc.equal(left.column("kind"), 0))
        types_of = {"lines_of": "<i4", "common": np.float32, "rares": "<i4", "net": np.float16, "tail": "<i4", "lines": "<i4", "bucket": "<i4", "spell": np.float16, "counted": np.int64}
        lines_of, common, rares, net, tail, own, bucket, spell, counts = (np.frombuffer(about.column(c)[0].as_py(), t) for c, t in types_of.items())
        which, place, n = (right.column(c).to_numpy() for c in ("what", "at", "times"))
        counts = counts.copy()
        counts[place[which == 2]] = n[which == 2]
        document = np.repeat(np.arange(len(lines_of)), lines_of)  # of each line
        line = np.repeat(np.arange(len(rares)), rares)  # of each rare word
        rare = rare_scores(document[line], tail, net.astype(np.float64), counts, spell.astype(np.float64), bucket, tokens, types, within)
        values = common + np.bincount(line, rare, len(rares))
        if within and len(values):
            every = np.ones(int(own.max()) + 1, np.int64)
            every[place[which == 3]] = n[which == 3]
            values = recalled(document, values, own, every, lines)
        order = left.column("place").to_numpy()
        sizes, sums = left.column("size").to_pylist(), np.bincount(document, values, len(lines_of))[order].tolist()
        means = [s / k if k else None for s, k in zip(sums, sizes)]
        return pa.table([left.column("ident").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=[ident, "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return texts.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(add, f"`{ident}` {kind}, n_tokens bigint, log_likelihood double, mean_log_likelihood double")
