"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

For a proper merge list the encoding of ``prefix + token`` ends in ``token``
exactly when the last token of the prefix's own encoding and ``token`` may
stand side by side.  So one left-to-right pass keeps, for every position, the
last token of the encoding of the text up to there.  Walking those links back
from the newest position gives the current encoding, and whatever lies further
back than the merge list's sufficient lookahead can't change any more: it is
emitted and forgotten.  Memory is that lookahead plus the longest token, however
long a word grows.  What the transducer emitted for frequent words is remembered,
in two bounded generations.

Decoding reads the stream of ids, an id at a time, through a machine that holds no
more than whether it has begun and the bytes of an unfinished character.  A
document's ids and texts go into running digests piece by piece.

Null texts count as empty and give no tokens; very long words stream; repeated
rows give equal rows; an empty table gives an empty result; extra columns are
untouched.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fluxmill.llm.common import kept, slices

END = "\ue000"  # stands for the end-of-word suffix inside match strings
_MARK = "</w>"
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_SPLIT = re.compile(r"[\x1c-\x1f]")  # str.split would part at these, too
_GENERATION = 120_000
_PAIRS = 1_500_000
_VOCABULARY_BYTES = 64 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: itself where visible, else the next code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in visible:
        out[b] = chr(b)
    spare = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


def sufficient_lookahead(merges: list[tuple[int, int]], length: dict[int, int], made: list[int], parts: dict[int, tuple[int, int]]) -> int:
    """Symbols to the right that can still decide about a token, from the merge list alone.

    Rule (a, b) is undone only if b's tail is taken first by a rule of lower
    rank, which in turn may be undone further right by one of still lower rank;
    ranks fall along the chain, so one pass in rank order finds the longest.
    """
    reach: dict[int, int] = {}
    longest = 1
    for (a, b), token in zip(merges, made, strict=True):
        tail, most = b, 0
        while True:
            most = max(most, reach.get(tail, 0))
            if tail not in parts:
                break
            tail = parts[tail][1]
        span = length[b] + most
        reach[a] = max(reach.get(a, 0), span)
        longest = max(longest, span)
    return longest + max(length.values())


_BYTE_OF = {c: b for b, c in enumerate(byte_alphabet())}


class Transducer:
    """Streams the symbols of one word at a time; ``feed`` returns the ids that became stable."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str = _MARK):
        glue = lambda s: s[: -len(suffix)] + END if suffix and s.endswith(suffix) else s
        self.strings = {i: glue(s) for s, i in vocabulary.items()}
        ids = {s: i for i, s in self.strings.items()}
        self.length = {i: len(s) for i, s in self.strings.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.join: dict[tuple[int, int], int] = {}
        pairs, made = [], []
        for rank, (a, b) in enumerate(merges):
            left, right = ids[glue(a)], ids[glue(b)]
            token = ids[glue(a) + glue(b)]
            if token in self.parts:
                raise ValueError("two merges make one token: not a proper merge list")
            self.parts[token], self.rank[token] = (left, right), rank
            self.join[left, right] = rank
            pairs.append((left, right))
            made.append(token)
        self.lookahead = sufficient_lookahead(pairs, self.length, made, self.parts)
        self.longest = max(self.length.values())
        self._pairs: dict[int, bool] = {}
        alive = {i for i in self.strings if i not in self.parts and len(self.strings[i].removesuffix(END)) == 1}
        for token in made:
            left, right = self.parts[token]
            if left in alive and right in alive and self._apart(left, right, self.rank[token]):
                alive.add(token)
        self.found = ahocorasick.Automaton()
        for i in alive:
            self.found.add_word(self.strings[i], (i, self.length[i]))
        self.found.make_automaton()
        self._reset()

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Do the two tokens meet unmerged, counting only rules below ``limit``? Undoes the later merge, step by step."""
        join, rank, parts = self.join, self.rank, self.parts
        while True:
            m = join.get((left, right))
            if m is not None and m < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of equal rules the left one goes first, so a tie across the border merges
                limit, right = b + 1, parts[right][0]

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= _PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(left, right, len(self.rank))
        return known

    def _reset(self) -> None:
        self._last: list[int] = []  # last token of the encoding up to each kept position
        self._base = 0  # position before the first kept one: a border that no longer moves
        self._border = -1  # the token that ends there
        self._at = 0
        self._scan = None

    def feed(self, symbols: str) -> list[int]:
        """Take more symbols of the word; return what is now stable."""
        if self._scan is None:
            self._scan = self.found.iter(symbols)
        else:
            self._scan.set(symbols)
        last, base, border, known = self._last, self._base, self._border, self._pairs.get
        last.extend([-1] * len(symbols))
        for end, (token, n) in self._scan:
            here = end - base
            if last[here] >= 0:
                continue
            start = here - n
            if start >= 0:
                before = last[start]
                if before >= 0:
                    apart = known(before << 20 | token)
                    if apart or apart is None and self.may_follow(before, token):
                        last[here] = token
            elif start == -1 and (border < 0 or self.may_follow(border, token)):
                last[here] = token
        self._at += len(symbols)
        return self._emit(self.lookahead) if len(last) > 2 * (self.lookahead + self.longest) else []

    def _emit(self, keep: int) -> list[int]:
        """The tokens of the current encoding that end further back than ``keep`` symbols."""
        last, out, length = self._last, [], self.length
        at, stop = len(last) - 1, len(last) - keep
        while at >= 0:
            token = last[at]
            if token < 0:
                raise ValueError("the lookahead was too short")
            if at < stop:
                out.append(token)
            at -= length[token]
        if at != -1:
            raise ValueError("the lookahead was too short")
        out.reverse()
        if keep and out:
            done = sum(self.length[t] for t in out)
            del last[:done]
            self._base += done
            self._border = out[-1]
        return out

    def finish(self) -> list[int]:
        """End the word: mark its last symbol and return the rest of the ids."""
        out = self.feed(END) + self._emit(0) if self._at else []
        self._reset()
        return out

    def word(self, symbols: str, piece: int = 4096) -> list[int]:
        """A whole word's ids, fed in pieces, the last with the word's end."""
        out: list[int] = []
        if len(symbols) > piece:
            last = (len(symbols) - 1) // piece * piece
            for i in range(0, last, piece):
                out += self.feed(symbols[i : i + piece])
            symbols = symbols[last:]
        out += self.feed(symbols + END)
        out += self._emit(0)
        self._reset()
        return out


class Decoder:
    """Ids to text, an id at a time.

    ``feed`` gives what the library's decoder makes of the ids: for a byte-level
    decoder text, of which unfinished characters are held back, and without a
    decoder the tokens themselves, parted by spaces.  ``feed_bytes`` is the
    byte-to-text machine for either: the tokens' bytes as UTF-8, a space at each
    word's end.
    """

    def __init__(self, tokens: dict[int, str], kind: str | None, suffix: str = ""):
        self.tokens, self.kind = tokens, kind
        self.bytes = {}
        for i, t in tokens.items():
            body = t.removesuffix(suffix) if suffix else t
            own = bytes(_BYTE_OF[c] for c in body) if all(c in _BYTE_OF for c in body) else body.encode()
            self.bytes[i] = own + b" " * (len(body) < len(t))
        self._state = codecs.getincrementaldecoder("utf-8")("replace")
        self._text = codecs.getincrementaldecoder("utf-8")("replace")
        self._begun = False

    def feed(self, ids: Iterable[int]) -> str:
        if self.kind == "ByteLevel":
            return "".join([self._state.decode(self.bytes[i]) for i in ids if i in self.bytes])
        made = list(map(self.tokens.get, ids))
        if None in made:
            made = [t for t in made if t is not None]
        out = " " * (self._begun and bool(made)) + " ".join(made)
        self._begun = self._begun or bool(made)
        return out

    def feed_bytes(self, ids: Iterable[int]) -> str:
        return self._text.decode(b"".join(map(self.bytes.get, ids, repeat(b""))))

    def finish(self) -> str:
        out = self._state.decode(b"", True) if self.kind == "ByteLevel" else ""
        self._begun = False
        self._state.reset()
        return out

    def finish_bytes(self) -> str:
        out = self._text.decode(b"", True)
        self._text.reset()
        return out


class Tokenizer:
    """A word-end BPE tokenizer read from its public JSON file's bytes."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("not a tokenizer with lower case and word ends")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.transducer = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        self.pieces = regex.compile(split)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")")
        self.alphabet = byte_alphabet()
        self.tokens = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.added.items()}
        self.decoder = (spec["decoder"] or {}).get("type")
        self._machine = Decoder(self.tokens, self.decoder, model["end_of_word_suffix"])
        self._young: dict[str | int, tuple[str, bytes]] = {}
        self._old: dict[str | int, tuple[str, bytes]] = {}

    def normalise(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case goes by character here, never by position
        return text.lower()

    def symbols(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.alphabet.__getitem__, piece.encode()))

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of text without white space."""
        return array("i", self._entry(chunk)[1]).tolist()

    def _chunks(self, text: str) -> Iterator[str | int]:
        parts = self.special.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.added:
                yield self.added[part]
            elif part:
                low = self.normalise(part)
                yield from (low.split() if not _ODD_SPLIT.search(low) else filter(None, _SPACE.split(low)))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for chunk in self._chunks(text or ""):
            out.extend(array("i", self._entry(chunk)[1]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self._machine.feed(ids) + self._machine.finish()

    def _entry(self, chunk: str | int) -> tuple[str, bytes]:
        """What the transducer emits for a chunk, in decimal and as integers, remembered for frequent chunks and their pieces."""
        got = self._young.get(chunk)
        if got is not None:
            return got
        got = self._old.get(chunk)
        if got is None:
            if isinstance(chunk, int):
                ids = [chunk]
            elif chunk.isalpha():
                ids = self.transducer.word(chunk if chunk.isascii() else self.symbols(chunk))
            else:
                pieces = self.pieces.findall(chunk)
                ids = self.transducer.word(self.symbols(pieces[0])) if len(pieces) == 1 else None
            if ids is not None:
                got = (" ".join(map(str, ids)), array("i", ids).tobytes())
            else:
                parts = [self._entry(p) for p in pieces]
                got = (" ".join([p[0] for p in parts]), b"".join([p[1] for p in parts]))
        if len(self._young) >= _GENERATION:
            self._old, self._young = self._young, {}
        self._young[chunk] = got
        return got

    def pieces_of(self, text: str | None, size: int = 4096) -> Iterator[tuple[str, array]]:
        """The text's ids as they become stable, in decimal and as integers, some thousand chunks at a time."""
        entry, chunks = self._entry, iter(self._chunks(text or ""))
        while part := list(islice(chunks, size)):
            get = self._young.get
            held = [get(c) or entry(c) for c in part]
            ids = array("i")
            ids.frombytes(b"".join([more for _, more in held]))
            yield " ".join([d for d, _ in held if d]), ids

    def packed(self, text: str | None) -> bytes:
        """The ids as native 32-bit integers."""
        return b"".join([ids.tobytes() for _, ids in self.pieces_of(text)])

    def digests(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids, and digests of the ids in decimal joined by spaces, of the decoded text and of the text that the tokens' bytes make.

        Ids go through the decoder as they come; nothing but the pieces is held.
        """
        n, machine = 0, self._machine
        listed, decoded, restored = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        for decimal, ids in self.pieces_of(text):
            if ids:
                listed.update((" " + decimal if n else decimal).encode())
                n += len(ids)
                decoded.update(machine.feed(ids).encode())
                restored.update(machine.feed_bytes(ids).encode())
        decoded.update(machine.finish().encode())
        restored.update(machine.finish_bytes().encode())
        return n, listed.hexdigest(), decoded.hexdigest(), restored.hexdigest()


def _tokenizer(data: bytes) -> Tokenizer:
    return kept("bpe" + hashlib.sha256(data).hexdigest(), lambda: Tokenizer(data))


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file's bytes; refused beyond the size that is safe to broadcast."""
    with open(path, "rb") as f:
        data = f.read(_VOCABULARY_BYTES + 1)
    if len(data) > _VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {_VOCABULARY_BYTES} bytes")
    return data


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", output: str = "ids", digests: bool = False) -> DataFrame:
    """Add ``output`` (array of ids), or with ``digests`` the columns n_tokens, ids_sha256, decoded_sha256 and restored_sha256.

    Narrow: one pass, no shuffle.  The vocabulary file is read by the driver and
    broadcast; its size is checked first.  An input column of an output's name is
    replaced.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    added = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("restored_sha256", "string")] if digests else [(output, "array<int>")]
    names = {n.lower() for n, _ in added}
    kept = [c for c in df.columns if c.lower() not in names]
    source = df.select(*[df[c] for c in kept]) if text in kept else df
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept] + [f"`{n}` {t}" for n, t in added])

    place = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value)
        for batch in slices(batches, place):  # a slice's ids stay far below the 2^31 that one list array can hold
            texts = batch.column(place).to_pylist()
            kept_columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            if digests:
                rows = [tok.digests(t) for t in texts]
                cols = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3))]
            else:
                parts = [tok.packed(t) for t in texts]
                ends = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype=np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))]
            yield pa.RecordBatch.from_arrays(kept_columns + cols, kept + [n for n, _ in added])

    return source.mapInArrow(run, schema)


def decode_documents(df: DataFrame, vocabulary: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add ``output``, the text of the array ``ids`` (null ids give an empty text)."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kept = [c for c in df.columns if c.lower() != output.lower()]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept] + [f"`{output}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([tok.decode(r or []) for r in rows], pa.string())], [*kept, output])

    return df.mapInArrow(run, schema)
