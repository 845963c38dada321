"""Byte-level BPE as a lazily determinised finite-state transducer.

The merge table is compiled into a non-deterministic transducer whose configurations are
(last finished token, trie node of the token in progress). A token may follow another only if
re-merging their joint bytes gives back just these two, which makes exactly one finished path
per prefix (the encoding of a prefix by ordered merges is a chain of pairwise compatible tokens).
Subsets of configurations are the states of the deterministic machine; they and their transitions
are built the first time an input reaches them. A state names the token that ends at its place, so
paths are read back from the states passed; the tokens that all paths of a subset agree on leave
after a bounded lookahead. Short pieces go through the machine side by side, a byte of each at a
time. Decoding runs the tokens through an incremental UTF-8 state machine, whose moves over whole
tokens are remembered.

Edge cases: null and empty texts have no tokens; any text goes through, whatever its length;
special-token strings are ordinary text; ids may be null or repeat: rows are independent, so each
gets its own result and equal texts equal ones; of merges of equal rank the left one goes first; an
empty table gives an empty result; other columns of the input, whatever their names, pass through
``encode`` and ``decode`` untouched and are ignored by ``digest``.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm._core import byte_views, released, row_chunks, table, worker_state

#: Bounds of the lazily built tables; beyond them they start afresh, which changes no result.
MAX_STATES, MAX_PAIRS, MAX_STEPS = 160_000, 100_000, 50_000
#: Bytes of text that are split and encoded at once, and of the pieces that go side by side.
CHUNK, SIDE_BY_SIDE = 1 << 19, 64
#: Bytes after which agreed tokens leave the transducer; an agreement takes at most the longest token.
LOOKAHEAD = 256


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 token and rank per line; ids without one are empty."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
    tokens = [b""] * (max(i for _, i in pairs) + 1)
    for t, i in pairs:
        tokens[i] = t
    return tokens


class _Moves:
    """Moves of the machine by state and byte: an open hash table that is asked for many at once."""

    def __init__(self) -> None:
        self.bits, self.size = 16, 0
        self._empty()

    def _empty(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key leads, -1 if that isn't known."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], np.int32(-1))
        live = np.flatnonzero((there != keys) & (there >= 0))
        while len(live):
            slot[live] = slot[live] + 1 & (1 << self.bits) - 1
            there = self.keys[slot[live]]
            hit = there == keys[live]
            out[live[hit]] = self.to[slot[live[hit]]]
            live = live[~hit & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.size += len(keys)
        if 2 * self.size > 1 << self.bits:
            old = self.keys >= 0
            keys, to = np.concatenate([self.keys[old], keys]), np.concatenate([self.to[old], to])
            while 2 * self.size > 1 << self.bits:
                self.bits += 1
            self._empty()
        slot, live = self._slots(keys), np.arange(len(keys))
        while len(live):
            free = live[self.keys[slot[live]] < 0]
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot[live]] == keys[live]
            self.to[slot[live[placed]]] = to[live[placed]]
            live = live[~placed]
            slot[live] = slot[live] + 1 & (1 << self.bits) - 1

    def one(self, key: int) -> int:
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while (there := self.keys.item(slot)) >= 0:
            if there == key:
                return self.to.item(slot)
            slot = slot + 1 & (1 << self.bits) - 1
        return -1


class Transducer:
    """Encoder of byte pieces. ``tokens``: bytes by id, an earlier id is an earlier merge."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.child: dict[int, int] = {}
        self.final: list[int] = [-1]
        self.inner: list[bool] = [False]
        for t, i in self.rank.items():
            node = 0
            for b in t:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.final)
                    self.final.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.final[node] = i
        self.sizes = np.array([len(t) for t in tokens], np.int32)
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        # a configuration is (last finished token + 1) << 20 | trie node; the oldest in progress comes first;
        # a state's configurations are kept as their bytes
        self.states: list[bytes] = []
        self.last = np.zeros(1024, np.int32)  # the token that ends at a state's place
        self.ids: dict[bytes, int] = {}
        self.moves = _Moves()
        self._state(array("q", [0]).tobytes(), -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ordered merges, done naively: the definition that all else rests on."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _edge(self, t: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at one edge of token t while it is merged: (part, rank of the merge that takes it).

        Empty if ordered merges of the token's bytes don't end in the token.
        """
        known = self.edges.get((t, right))
        if known is None:
            known, whole, until = [], self.tokens[t], 1 << 60
            if self.merge(whole) == [t]:
                while True:
                    known.append((whole, until))
                    if len(whole) == 1:
                        break
                    until = self.rank[whole]
                    whole = self._halves(whole)[right]
            self.edges[t, right] = known
        return known

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge is the last of the token's."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def follows(self, u: int, t: int) -> bool:
        """Whether merging the joint bytes of two tokens gives back the two.

        It doesn't if, while both are being merged, the parts that meet at their border form a token
        of lower rank than the merges that take either part away (of equal ranks the left one goes first).
        """
        ok = self.pairs.get(u + 1 << 32 | t)
        if ok is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            left = [(b"", 0)] if u < 0 else self._edge(u, True)
            right = self._edge(t, False)
            ok = bool(left) and bool(right)
            if u >= 0 and ok:
                rank = self.rank
                for a, a_until in left:
                    for b, b_until in right:
                        joint = rank.get(a + b)
                        if joint is not None and joint < a_until and joint <= b_until:
                            ok = False
                            break
                    if not ok:
                        break
            self.pairs[u + 1 << 32 | t] = ok
        return ok

    def _state(self, configurations: bytes, last: int) -> int:
        to = self.ids.get(configurations)
        if to is None:
            to = self.ids[configurations] = len(self.states)
            self.states.append(configurations)
            if to == len(self.last):
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[to] = last
        return to

    def _configurations(self, state: int) -> array:
        out = array("q")
        out.frombytes(self.states[state])
        return out

    def _move(self, state: int, byte: int) -> int:
        """Where a state goes with a byte, determinised now."""
        new, ended = array("q"), -1
        child, inner, final, pairs = self.child.get, self.inner, self.final, self.pairs.get
        for c in self._configurations(state):
            nxt = child((c & 0xFFFFF) << 8 | byte)
            if nxt is None:
                continue
            u = c >> 20
            if inner[nxt]:
                new.append(u << 20 | nxt)
            t = final[nxt]
            if t >= 0 and ended < 0:
                ok = pairs(u << 32 | t)
                if ok is None:
                    ok = self.follows(u - 1, t)
                if ok:
                    ended = t
        new.append(ended + 1 << 20)
        return self._state(new.tobytes(), ended)

    def _walk(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where each state goes with its byte."""
        key = state.astype(np.int64) << 8 | byte
        to = self.moves.find(key)
        if (new := to < 0).any():
            fresh, back = np.unique(key[new], return_inverse=True)
            made = np.array([self._move(k >> 8, k & 0xFF) for k in fresh.tolist()], np.int32)
            self.moves.add(fresh, made)
            to[new] = made[back]
        return to

    def _path(self, seen: list[int], place: int) -> list[int]:
        """Tokens of the finished path at a place, last first; ``seen`` are the states by place."""
        out, last, tokens = [], self.last, self.tokens
        while place > 0:
            t = last.item(seen[place])
            out.append(t)
            place -= len(tokens[t])
        return out

    def _agreed(self, seen: list[int]) -> list[int]:
        """Tokens that all paths alive at the end of ``seen`` begin with."""
        depth = self._depths()
        paths = [self._path(seen, len(seen) - 1 - depth[c & 0xFFFFF])[::-1] for c in self._configurations(seen[-1])]
        n = 0
        while all(len(p) > n for p in paths) and all(p[n] == paths[0][n] for p in paths):
            n += 1
        return paths[0][:n]

    def _depths(self) -> list[int]:
        if not hasattr(self, "depth"):
            self.depth = [0] * len(self.final)
            for key, node in self.child.items():  # parents come before their children
                self.depth[node] = self.depth[key >> 8] + 1
        return self.depth

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token.

        Every LOOKAHEAD bytes the tokens that all paths agree on are emitted and forgotten.
        """
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._reset()
        find = self.moves.one
        state, seen, out, start = 0, [0], [], 0
        while start < len(piece):
            for b in piece[start : start + LOOKAHEAD]:
                nxt = find(state << 8 | b)
                if nxt < 0:
                    nxt = self._move(state, b)
                    self.moves.add(np.array([state << 8 | b]), np.array([nxt], np.int32))
                state = nxt
                seen.append(state)
            start += LOOKAHEAD
            if start < len(piece):
                done = self._agreed(seen)
                out += done
                del seen[: sum(len(self.tokens[t]) for t in done)]
                if len(self.states) > MAX_STATES:  # a huge piece: keep its own states in a fresh table
                    kept = [(self.states[s], self.last.item(s)) for s in seen]
                    self._reset()
                    seen = [self._state(*k) for k in kept]
                    state, find = seen[-1], self.moves.one
        return out + self._path(seen, len(seen) - 1)[::-1]

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and where each piece's begin (one more for the end)."""
        out: dict[int, list[int]] = {}
        short: list[int] = []
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) <= SIDE_BY_SIDE:
                short.append(i)
            else:
                out[i] = self.encode(p)
        count = np.zeros(len(pieces), np.int64)
        count[list(out)] = [len(x) for x in out.values()]
        found = []
        for a in range(0, len(short), 1 << 15):
            found.append(self._side_by_side(part := np.array(short[a : a + (1 << 15)]), [pieces[i] for i in part.tolist()]))
            np.add.at(count, found[-1][0], 1)
        bounds = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(bounds[-1], np.int32)
        if out:
            at = np.repeat(bounds[list(out)] - np.cumsum([0, *map(len, out.values())])[:-1], [len(x) for x in out.values()])
            ids[at + np.arange(len(at))] = list(chain.from_iterable(out.values()))
        for piece, back, token in found:
            ids[bounds[piece + 1] - 1 - back] = token
        return ids, bounds

    def _side_by_side(self, number: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, place from its end, token) of all tokens; the pieces' bytes are walked in step."""
        if len(self.states) > MAX_STATES:
            self._reset()
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")  # those that still go on are always the first
        begin = (np.cumsum(size) - size)[order]
        number, size = number[order], size[order]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        state, seen, offset = np.zeros(len(size), np.int32), [], [0]
        for j in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -j))  # longer than j
            state = self._walk(state[:n], data[begin[:n] + j].astype(np.int64))
            seen.append(state)
            offset.append(offset[-1] + n)
        ends = self.last[np.concatenate(seen)] if seen else np.zeros(0, np.int32)
        offset = np.array(offset)
        live, place, back, out = np.arange(len(size)), size.copy(), 0, []
        while len(live):
            t = ends[offset[place[live] - 1] + live]
            out.append((number[live], np.full(len(live), back), t))
            place[live] -= self.sizes[t]
            live, back = live[place[live] > 0], back + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (number[:0], number[:0], number[:0])


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes in, text out as soon as a character is whole.

    Ill-formed input gives U+FFFD for each maximal ill-formed part, as the Unicode standard advises.
    """

    def __init__(self, place: tuple[int, int, int, int] = (0, 0, 0x80, 0xBF)) -> None:
        self.need, self.code, self.low, self.high = place

    def place(self) -> tuple[int, int, int, int]:
        """Where the machine stands; another one can go on from there."""
        return (self.need, self.code, self.low, self.high) if self.need else (0, 0, 0x80, 0xBF)

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.low, self.high = 0x80, 0xBF
                    self.code = self.code << 6 | b & 0x3F
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def decode_stream(ids: Iterable[int], tokens: list[bytes]) -> Iterator[str]:
    """Text of a token stream, piece by piece; a character split over tokens comes with its last byte."""
    machine = Utf8Machine()
    for i in ids:
        if text := machine.feed(tokens[i]):
            yield text
    if text := machine.finish():
        yield text


class Decoder:
    """The UTF-8 machine over whole tokens: what it says and where it stands after each, remembered."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole: list[str | None] = []  # text of a token that begins and ends between characters
        for t in tokens:
            machine = Utf8Machine()
            text = machine.feed(t)
            self.whole.append(None if machine.need else text)
        self.steps: dict[tuple, tuple[str, tuple]] = {}

    def text(self, ids: list[int]) -> str:
        parts = list(map(self.whole.__getitem__, ids))
        if None not in parts:
            return "".join(parts)
        out, start = [], Utf8Machine().place()
        place = start
        for i, part in zip(ids, parts, strict=True):
            if part is not None and place == start:
                out.append(part)
                continue
            step = self.steps.get((place, i))
            if step is None:
                if len(self.steps) >= MAX_STEPS:
                    self.steps.clear()
                machine = Utf8Machine(place)
                step = self.steps[place, i] = machine.feed(self.tokens[i]), machine.place()
            out.append(step[0])
            place = step[1]
        out.append(Utf8Machine(place).finish())
        return "".join(out)


class _Numbers(dict):
    """Number of each piece of text, in the order in which they come."""

    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self)
        return i


class Coder:
    """Encoder and decoder of whole texts for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.fst, self.decoder, self.split = Transducer(tokens), Decoder(tokens), regex.compile(pattern)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more for the end)."""
        numbers = _Numbers()
        flat: list[int] = []
        stops = [0]
        for t in texts:
            if t:
                flat += map(numbers.__getitem__, self.split.findall(t))
            stops.append(len(flat))
        ids, bounds = self.fst.encode_all([p.encode() for p in numbers])
        piece = np.array(flat, np.int64)
        size = np.diff(bounds)[piece]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(bounds[piece] - ends[:-1], size) + np.arange(ends[-1])], ends[stops]


def coder(tokens: list[bytes], pattern: str, key: str) -> Coder:
    """The worker's coder for this vocabulary and split pattern, made once per worker."""
    state = worker_state("bpe")
    if getattr(state, "key", None) != key:
        state.coder, state.key = Coder(tokens, pattern), key
    return state.coder


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of parts of the column."""
    for a, b in row_chunks(byte_views(column)[1], CHUNK):
        yield a, column.slice(a, b - a).to_pylist()


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """Read on the driver and broadcast: a vocabulary file is of fixed, small size (under 1 MB)."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    tokens = load_ranks(path)
    key = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
    return spark.sparkContext.broadcast(tokens), pattern, key


def encode(df: DataFrame, text: str = "text", into: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add column ``into``: array<int> of token ids of the whole text (null and empty: no ids)."""
    shared, pattern, key = _vocabulary(df.sparkSession, path, pattern)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        import pandas as pd

        tool = coder(shared.value, pattern, key)
        out = []
        for _, part in _chunks(pa.array(texts, pa.string())):
            found, bounds = tool.encode(part)
            out += np.split(found, bounds[1:-1])
        return pd.Series(out)

    return df.withColumn(into, ids(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """Add column ``into``: the text of the ids, ill-formed bytes as U+FFFD (null: empty)."""
    shared, _, _ = _vocabulary(df.sparkSession, path, "")

    @F.pandas_udf(T.StringType())
    def text(rows):
        import pandas as pd

        return pd.Series(["" if r is None else "".join(decode_stream(r, shared.value)) for r in rows])

    return df.withColumn(into, text(F.col(ids)))


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode each whole text, decode the ids again, and report counts and hashes of both."""
    shared, pattern, key = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(shared.value, pattern, key)
        names = [str(i) for i in range(len(shared.value))]
        text, sha = tool.decoder.text, hashlib.sha256
        for batch in batches:
            for a, part in _chunks(batch.column(1)):
                found, bounds = tool.encode(part)
                ids_sha, text_sha = [], []
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = found[i:j].tolist()
                    ids_sha.append(sha(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(sha(text(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
