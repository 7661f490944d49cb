"""Language identification by cross-parsing entropy.

A suffix automaton per language holds a reference text.  A document is parsed
against each of them into the longest phrases the automaton knows; the language
whose phrases are fewest, normalised by the cost of naming a phrase in its
reference, explains the text best.  All documents of a batch are parsed side by
side, one character of every piece at a step, on numpy arrays.  Pieces are first
parsed as if a phrase began with each; then the phrase that reaches into a piece is
carried on until both parses begin a phrase at the same letter, from where they
agree.  So every phrase is a longest match of the whole text.

References come from a bounded sample of labelled rows, chosen by a hash of the id:
at most ``sample_docs`` documents a language, of each an excerpt of at most
``excerpt`` characters from a place that the hash chooses, ``reference`` characters
a language, and the ``most_languages`` most frequent labels.  Rows that repeat an id
and label are one.  Prediction sees only the text, and all of it.

Letters are letters of any script with the marks that combine with them.  Null
texts and texts without letters give ``und`` and score 0; ties go to the language
that sorts first; long texts are parsed whole; with no labelled rows every text is
``und``; repeated rows are predicted alike; an empty table gives an empty result;
extra columns are dropped unless kept.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxmill.llm.common import kept, slices

UND = "und"
SAMPLE_DOCS = 96
REFERENCE = 16_000
EXCERPT = 2000
MOST_LANGUAGES = 1000
PIECE = 128
_LANES = 1 << 14
_TABLE = 1 << 16


def _letter(point: int) -> int:
    """The lower-case letter's (or mark's) code point, or 32 for anything else."""
    ch = chr(point)
    if unicodedata.category(ch)[0] not in "LM":
        return 32
    low = ch.lower()
    return ord(low) if len(low) == 1 else point


_classes: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case letters and marks as code points, with one space for each run of anything else; none at the ends."""
    if not _classes:
        _classes.append(np.array([_letter(c) for c in range(_TABLE)], np.int32))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wide = points >= _TABLE
    if wide.any():
        rare, at = np.unique(points[wide], return_inverse=True)
        out = _classes[0][np.where(wide, 32, points)]
        out[wide] = np.array([_letter(int(c)) for c in rare], np.int32)[at]
    else:
        out = _classes[0][points]
    space = out == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = out[keep]
    if not ((out > 96) & (out < 123)).any() and not any(unicodedata.category(chr(c))[0] == "L" for c in np.unique(out)):
        return out[:0]  # marks alone are no letters
    return out[:-1] if out[-1] == 32 else out


def suffix_automaton(text: Sequence[int]) -> list[dict[int, int]]:
    """Transitions by state of the smallest automaton of all substrings of ``text`` (Blumer et al.)."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return move


class Parser:
    """Cross-parses texts against the references of several languages."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        texts = [letters(references[n]) for n in self.languages]
        known = sorted({int(c) for t in texts for c in t} | {32})
        self.code = np.zeros(0x110000, np.int32)  # 0 is a letter that no reference has
        for k, c in enumerate(known):
            self.code[c] = k + 1
        self.width = len(known) + 1
        tables, self.cost = [], []
        for t in texts:
            moves = suffix_automaton(self.code[t].tolist())
            grid = np.full((len(moves) + 1, self.width), -1, np.int32)  # the last state has no way on: a letter the reference lacks
            for s, m in enumerate(moves):
                for c, to in m.items():
                    grid[s, c] = to
            tables.append(grid.reshape(-1))
            self.cost.append(np.log2(max(len(t), 2)))  # bits that name a phrase's place
        self.tables = tables
        self.space = int(self.code[32])

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language of each text, and its number of symbols; (languages, texts)."""
        coded = [self.code[letters(t)] if t else np.empty(0, np.int64) for t in texts]
        size = np.array([len(c) for c in coded], np.int64)
        pieces = -(-size // PIECE)
        flat = np.concatenate([*coded, np.empty(0, np.int64)])
        base = np.repeat(np.cumsum(size) - size, pieces)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = base + nth * PIECE
        length = np.minimum(PIECE, np.repeat(size, pieces) - nth * PIECE)
        edges = np.cumsum(size) - size
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        some = size > 0
        for n, table in enumerate(self.tables):
            begins = np.zeros(len(flat), np.int8)  # where a phrase begins
            end = np.zeros(len(start), np.int64)  # the state in which each piece is left
            self._parse(table, flat, begins, np.arange(len(start)), start, length, end, None)
            carried = np.flatnonzero(nth > 0)
            while len(carried):  # pieces whose parse may begin within a phrase
                before = end[carried - 1]
                moved = self._parse(table, flat, begins, carried, start, length, end, before)
                carried = moved + 1
                carried = carried[carried < len(start)]
                carried = carried[nth[carried] > 0]
            if some.any():
                out[n, some] = np.add.reduceat(begins, edges[some], dtype=np.int64)
        return out, size

    def _parse(self, table: np.ndarray, flat: np.ndarray, begins: np.ndarray, which: np.ndarray, start: np.ndarray, length: np.ndarray, end: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """Parse pieces side by side, noting where phrases begin and the last states.

        With the states ``before`` them, a piece is followed until its phrases begin
        where they are noted already.  Returns the pieces that were followed to
        their end, so that their last state may be another.
        """
        dead = len(table) // self.width - 1
        open_: list[np.ndarray] = []
        for first in range(0, len(which), _LANES):
            lane = which[first : first + _LANES]
            order = np.argsort(-length[lane], kind="stable")
            lane = lane[order]
            state = np.full(len(lane), dead) if before is None else before[first : first + _LANES][order].copy()
            at, left = start[lane], length[lane]
            step = 0
            while len(lane):
                running = int(np.searchsorted(-left, -step, side="left")) if before is None else len(lane)
                if before is not None:
                    over = left <= step
                    if over.any():
                        end[lane[over]] = state[over]
                        open_.append(lane[over])
                        lane, at, left, state = (x[~over] for x in (lane, at, left, state))
                        continue
                elif running < len(lane):
                    end[lane[running:]] = state[running:]
                    lane, at, left, state = (x[:running] for x in (lane, at, left, state))
                    continue
                place = at + step
                symbol = flat[place]
                to = table[state * self.width + symbol].astype(np.int64)
                stuck = to < 0
                # a phrase ended; the symbol begins the next, or is one itself where the reference lacks it
                begun = table[symbol[stuck]]
                to[stuck] = np.where(begun < 0, dead, begun)
                if before is None:
                    begins[place[stuck]] = 1
                    state = to
                else:
                    agreed = stuck & (begins[place] == 1)
                    begins[place] = stuck
                    state = to
                    if agreed.any():
                        lane, at, left, state = (x[~agreed] for x in (lane, at, left, state))
                step += 1
        return np.sort(np.concatenate([*open_, np.empty(0, np.int64)]).astype(np.int64))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, score (how much cheaper than the second best, 0 to 1), bits a letter in it, and number of letters and gaps."""
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [len(letters(t)) if t else 0 for t in texts]
        count, size = self.phrases(texts)
        bits = count * np.array(self.cost)[:, None]
        best = bits.argmin(0)
        low = bits[best, np.arange(len(texts))]
        rest = bits.copy()
        rest[best, np.arange(len(texts))] = np.inf
        second = rest.min(0) if len(self.languages) > 1 else low * 2
        some = size > 0
        score = np.where(some, 1 - low / np.maximum(np.where(np.isfinite(second), second, 1), 1e-9), 0.0).clip(0, 1)
        return [self.languages[b] if s else UND for b, s in zip(best, some)], score.tolist(), (low / np.maximum(size, 1)).tolist(), size.tolist()


def held_out(ident: Column) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % 5 == 0


def references(df: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "lang", learn: Column | None = None, sample_docs: int = SAMPLE_DOCS, reference: int = REFERENCE, excerpt: int = EXCERPT, most_languages: int = MOST_LANGUAGES) -> dict[str, str]:
    """Reference text by language: excerpts of labelled texts in the order of a hash of their id.

    Only ids and labels are aggregated over all rows; a hash threshold set from
    the counts brings down about twice ``sample_docs`` excerpts a language.
    """
    rows = df.where(learn if learn is not None else ~held_out(F.col(ident))).where(F.col(label).isNotNull() & F.col(text).isNotNull())
    place = F.pmod(F.xxhash64(F.col(ident), F.lit(11)), F.lit(1 << 30))
    frequent = rows.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l").limit(most_languages)
    counts = {r["l"]: r["n"] for r in frequent.collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 2 * sample_docs / n) * (1 << 30))))])
    picked = rows.where(place < F.element_at(share, F.col(label)))
    begin = F.pmod(F.xxhash64(F.col(ident), F.lit(12)), F.greatest(F.length(text) - excerpt + 1, F.lit(1)).cast("long")).cast("int") + 1
    parts = picked.select(place.alias("p"), F.col(ident).alias("i"), F.col(label).alias("l"), F.substring(F.col(text), begin, F.lit(excerpt)).alias("t"))
    found: dict[str, list] = {}
    for r in parts.groupBy("p", "i", "l").agg(F.min("t").alias("t")).collect():
        found.setdefault(r["l"], []).append((r["p"], str(r["i"]), r["t"]))
    out = {}
    for name, texts in found.items():
        kept, total = [], 0
        for _, _, t in sorted(texts)[:sample_docs]:
            kept.append(t[: reference - total])
            total += len(kept[-1])
            if total >= reference:
                break
        joined = "\n".join(kept)
        if len(letters(joined)):
            out[name] = joined
    return out


def _parser(refs: dict[str, str]) -> Parser:
    return kept("langid" + hashlib.sha256(repr(sorted(refs.items())).encode()).hexdigest(), lambda: Parser(refs))


def identify(df: DataFrame, refs: dict[str, str], text: str = "text", keep: Sequence[str] = ("doc_id",), outputs: Sequence[str] = ("lang_pred", "lang_score", "lang_bits", "lang_letters")) -> DataFrame:
    """``keep`` plus language, score, bits a letter and number of letters under the names ``outputs``; narrow, one pass."""
    shared = df.sparkSession.sparkContext.broadcast(refs)  # bounded: languages times the reference length
    names = list(keep)
    others = [n for n in names if n != text]
    source = df.select(*others, df[text].alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in names] + [f"`{n}` {t}" for n, t in zip(outputs, ("string", "double", "double", "bigint"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in slices(batches, len(others)):
            texts = batch.column(len(others))
            langs, scores, bits, size = parser.predict(texts.to_pylist())
            columns = [texts if n == text else batch.column(others.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(size, pa.int64())], [*names, *outputs])

    return source.mapInArrow(run, schema)
