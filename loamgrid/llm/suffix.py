"""Exact substring dedup: winnowed candidates, then a run-length BWT index over what may repeat.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier in the corpus (smaller
doc_id, or same document and earlier start). Four steps:

1. Winnowing: of the k-gram hashes of each document the minimum of every window is kept. Two equal
   strings of LENGTH bytes keep the same k-gram at the same place, so every repeat shares a kept
   hash. Each is sent with a name of its context, the bytes that strings around it can cover: 95
   bits of two hashes, modulo 2**64 and in a prime field. Equal contexts are one class; its first
   stands for all in the index, where copies would only lengthen runs, and the copies are repeats of
   it from end to end. Within a part of a task only the first of a class is sent, so a hot passage
   sends one row per part.
2. Rows meet by k-gram hash, sorted; classes are closed. Firsts of groups with several classes
   (passages' edges) ask for their bytes. A k-gram with many classes in one part of a task is spread
   over ``SALTS`` groups, all of whose firsts ask.
3. Those contexts are fetched by a join with the documents. A string with its k-gram at one of 15 or
   16 consecutive places holds 85 bytes at least, the places' core, that stand alike around the
   k-gram; a context is cut down to the places whose core another context has too, and goes if there
   are none: a short line that many texts share has no such core. Two contexts that are left alone
   with each other are compared byte by byte. The rest is indexed in blocks: of the
   Burrows-Wheeler transform only its runs are kept, with text positions and longest-common-prefix
   values sampled at the runs' ends. Streaming the text over the samples gives each position's
   matching statistic and the position that it matches; matches of at least LENGTH bytes chain
   positions together, of which the earliest stays. Groups too large for one block meet by core
   instead, equal parts as one class; what is too large even then goes by a shuffle on the
   LENGTH-byte strings themselves.
4. Intervals are united per document and cut out of its bytes.

Edge cases: null and empty texts have zero bytes and lose nothing; texts shorter than LENGTH lose
nothing, and very long ones are read whole; rows of an id that other texts have too, or without an
id, are documents of their own, in order of id (null first) and then of a hash of the text; rows
repeated with id and text are one document: all get its result and aren't repeats of each other;
strings that tie for the earliest start don't exist but for these; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm._core import byte_views, checkpoint, merge_intervals, mix, prefix_hash, prefix_prime, released, row_chunks, span_hash, span_prime, table, winnow

LENGTH, GRAM = 100, 40
#: Contexts of one k-gram that are indexed in one block; groups of more take the shuffle on strings.
BLOCK_CONTEXTS = 4096
BLOCK_BYTES = 1 << 19
#: Parts into which the places of a k-gram in a string are divided.
CORES = 4
#: Text within which equal contexts are thinned before they are sent; bounds a task's memory.
SCAN_BYTES = 1 << 22
#: Contexts of one k-gram within SCAN_BYTES from which on it is spread, and over how many groups.
HOT, SALTS = 64, 61
#: Ids of several rows that may be broadcast.
MAX_BROADCAST_IDS = 1_000_000
_NULL_ID = -(2**63)
_OPEN = "kind int, h long, salt int, ctx long, id long, key long, at long, len int, size int"
_SPANS = "id long, key long, start long, end long"
_CORE = "core long, id long, key long, at long, data binary"


def _contexts(pos: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    reach = length - gram
    return np.maximum(pos - reach, low), np.minimum(pos + length, high)


def _winnow_rows(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, k-gram hash, context hash, k-gram position, context start, context end), in rows' own bytes."""
    for a, b in row_chunks(off):
        base = off[a]
        buf = raw[base : off[b]]
        if len(buf) < length:
            continue
        bounds = off[a : b + 1] - base
        prefix = prefix_hash(buf)
        at = np.arange(len(buf) - gram + 1)
        h = span_hash(prefix, at, at + gram)
        # windows that run over a document's end select too; their k-grams are harmless if whole
        sel = np.flatnonzero(winnow(h, length - gram + 1))
        row = np.searchsorted(bounds, sel, side="right") - 1
        # a k-gram over a document's end, minimal in a window, hides none of the windows inside documents
        whole = sel + gram <= bounds[row + 1]
        sel, row = sel[whole], row[whole]
        lo, hi = _contexts(sel, bounds[row], bounds[row + 1], length, gram)
        use = hi - lo >= length
        sel, row, lo, hi = sel[use], row[use], lo[use], hi[use]
        prime = span_prime(prefix_prime(buf), lo, hi).astype(np.uint64)
        ctx = span_hash(prefix, lo, hi) ^ mix(prime << np.uint64(8) | (sel - lo).astype(np.uint64))
        yield row + a, h[sel], ctx, sel - bounds[row], lo - bounds[row], hi - bounds[row]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Mask of the rows that begin a new value of the sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _documents(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each row's document, in order of id and key; id and key of each number)."""
    order = np.lexsort((keys, ids))
    new = _first_of(ids[order], keys[order])
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, ids[order][new], keys[order][new]


def _scan(length: int, gram: int):
    def rows(raw: np.ndarray, off: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = list(_winnow_rows(raw, off, length, gram))
        if not parts:
            return
        row, h, ctx, pos, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        number, ids, keys = _documents(ids, keys)
        doc = number[row]
        order = np.lexsort((pos, doc, ctx, h))
        h, ctx, pos, lo, hi, doc = (x[order] for x in (h, ctx, pos, lo, hi, doc))
        first = _first_of(h, ctx)
        # a later row of the same document and place (a repeated row) is not a repeat
        twin = ~first
        twin[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
        rest = ~first & ~twin
        if rest.any():
            d, s, e = merge_intervals(doc[rest], lo[rest], hi[rest])
            yield _rows(1, ids[d] * np.int64(-7046029254386353131), 0, 0, ids[d], keys[d], s, 0, e - s)
        h, ctx, pos, lo, hi, doc = (x[first] for x in (h, ctx, pos, lo, hi, doc))
        begin = np.flatnonzero(_first_of(h))
        many = np.diff(np.append(begin, len(h))) >= HOT
        hot = np.repeat(many, np.diff(np.append(begin, len(h))))
        salt = np.where(hot, 1 + (ctx % np.uint64(SALTS)).astype(np.int64), 0)
        yield _rows(0, h.view(np.int64), salt, ctx.view(np.int64), ids[doc], keys[doc], lo, pos - lo, hi - lo)
        if many.any():  # tells rows that stay in the k-gram's own group that others are elsewhere
            yield _rows(0, h[begin[many]].view(np.int64), 0, 0, 0, 0, 0, 0, 0)

    def part(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, texts = pa.Table.from_batches(held).combine_chunks().columns
        raw, off = byte_views(texts)
        return rows(raw, off, ids.to_numpy(), keys.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if held and size + batch.nbytes > SCAN_BYTES:
                yield from part(held)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from part(held)

    return run


def _rows(kind, h, salt, ctx, ident, key, at, lead, size) -> pa.RecordBatch:
    """A batch of _OPEN rows; numbers stand for whole columns."""
    kinds = (np.int32, np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
    columns = [np.broadcast_to(np.asarray(x, t), len(h)) for x, t in zip((kind, h, salt, ctx, ident, key, at, lead, size), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [x.split(" ")[0] for x in _OPEN.split(", ")])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task sorted by (kind, h, salt, ctx, id, key, at): finished intervals (kind 1) and requests for bytes (kind 0).

    What is kept between batches is one row: the first of the last context seen, with whether it
    still waits for a second context of its k-gram.
    """
    last: tuple | None = None  # kind 0 row (h, salt, ctx, id, key, at, lead, size) of the running context's first
    waiting = False
    for batch in batches:
        kind, *columns = (np.asarray(c) for c in batch.columns)
        if (done := kind == 1).any():
            yield _rows(1, *(x[done] for x in columns))
        todo = ~done
        if not todo.any():
            continue
        columns = [x[todo] for x in columns]
        shift = 0
        if last is not None:
            columns = [np.concatenate([[v], x]) for v, x in zip(last, columns, strict=True)]
            shift = 1
        h, salt, ctx, ident, key, at, lead, size = columns
        first = _first_of(h, salt, ctx)
        group = _first_of(h, salt)
        start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        rest = ~first & (size > 0) & ~((ident == ident[start]) & (key == key[start]) & (at + lead == at[start] + lead[start]))
        if rest.any():
            number, ids, keys = _documents(ident[rest], key[rest])
            d, s, e = merge_intervals(number, at[rest], at[rest] + size[rest])
            yield _rows(1, ids[d] * np.int64(-7046029254386353131), 0, 0, ids[d], keys[d], s, 0, e - s)
        number = np.cumsum(group) - 1
        several = (np.bincount(number, weights=first)[number] > 1) | (salt > 0)
        if shift and not waiting:  # its group had several contexts before
            several |= number == 0
        ask = first & several
        if shift and not waiting:
            ask[0] = False
        begin = np.flatnonzero(first)[-1]
        waiting = not bool(several[-1])
        ask_now = ask & (size > 0)
        if ask_now.any():
            yield _rows(0, *(x[ask_now] for x in columns))
        last = tuple(x[begin] for x in columns)


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, first eight codes of each suffix packed into a number).

    A code 0 ends a text; ends are ordered by place, so all suffixes differ. Prefix doubling from
    eight codes on; the packed codes are 0 after an end.
    """
    n = len(codes)
    pad = np.concatenate([codes, np.zeros(8, codes.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for i in range(8):
        c = pad[i : i + n]
        alive &= c != 0
        key = key << np.uint64(8) | np.where(alive, c, np.uint64(0))
    head = key
    order = np.argsort(key)
    k, ended = key[order], ~alive[order]
    new = _first_of(k)
    # suffixes that end within eight codes have equal keys only with such; their place decides
    if ended.any():
        place = np.flatnonzero(ended)
        group = np.cumsum(new)[place]
        order[place] = order[place][np.lexsort((order[place], group))]
        new |= ended
    # a suffix's rank is the first row of its group; groups of one are done
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 8
    while len(rows := np.flatnonzero(~(new & np.append(new[1:], True)))):
        p = order[rows]
        after = np.where(p + width < n, rank[np.minimum(p + width, n - 1)] + 1, 0)
        key = rank[p] << 32 | after
        by = np.argsort(key)
        p, first = p[by], _first_of(key[by])
        order[rows], new[rows] = p, first
        rank[p] = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        width *= 2
    return order, head


class RunIndex:
    """Run-length BWT of a text with samples at the runs' ends; the suffix order itself is not kept.

    ``runs`` and ``run_bytes`` are the transform: where each run begins and its byte. For each run
    ``head`` is the text position of its first row and ``before`` that of the row before it, the last
    of another run; ``shared`` is what the two have in common. A position whose row follows a row with
    the same preceding byte has the match of the position before it, one further on and one shorter,
    so streaming over the samples gives every position's match and its length.
    """

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        order, packed = suffix_order(codes)
        bwt = codes[order - 1]  # position 0 is preceded by the closing 0
        # the ends differ from each other, so rows after an end are runs of their own
        self.runs = np.flatnonzero(_first_of(bwt) | (bwt == 0))
        self.run_bytes = bwt[self.runs]
        head, before = order[self.runs], order[self.runs - 1]
        shared = common_prefix(packed, head, before)
        shared[self.runs == 0] = 0
        by_place = np.argsort(head)
        self.head, self.before, self.shared = head[by_place], before[by_place], shared[by_place]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position, the position before it in suffix order and how much the two share."""
        at = np.arange(self.size)
        sample = np.zeros(self.size, np.int64)
        sample[self.head[1:]] = 1
        run = np.cumsum(sample)  # position 0 has a sample: it follows an end
        on = at - self.head[run]
        return self.before[run] + on, np.maximum(self.shared[run] - on, 0)

    def statistics(self) -> np.ndarray:
        """For each text position, how much it shares with its predecessor in suffix order."""
        return self.matches()[1]


def common_prefix(packed: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, up to the end of a text."""
    n, out = len(packed), np.zeros(len(x), np.int64)
    live, step = np.arange(len(x)), 0
    low = np.uint64(0xFF)
    while len(live):
        a, b = x[live] + step, y[live] + step
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        u, v = packed[a], packed[b]
        on = (u == v) & (u & low != 0)
        part = np.flatnonzero(~on)
        u, d = u[part], u[part] ^ v[part]
        same = np.ones(len(part), bool)
        count = np.zeros(len(part), np.int64)
        for i in range(8):
            shift = np.uint64(56 - 8 * i)
            same &= (d >> shift & low == 0) & (u >> shift & low != 0)
            count += same
        out[live[part]] += step + count
        live = live[on]
        step += 8
    return out


def repeated(texts: list[bytes], ident: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (id, start, end) of the texts' bytes that repeat an earlier start; text i begins at ``at[i]`` of document ``ident[i]``."""
    if not texts:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    # bytes become ranks among those that occur, from 1 on, so that 0 can end a text
    present = np.zeros(256, bool)
    present[buf] = True
    if present.all():
        raise ValueError("UTF-8 never uses all byte values")
    code = np.cumsum(present).astype(np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = np.zeros(int((sizes + 1).sum()), np.uint8)
    inner = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(buf))
    codes[inner] = code[buf]
    matched, shares = RunIndex(codes).matches()
    deep = np.flatnonzero(shares >= length)
    if not len(deep):
        return (np.zeros(0, np.int64),) * 3
    # chains of matches: each position's root is the one that matches nothing before it
    pos = np.union1d(deep, matched[deep])
    root = np.arange(len(pos))
    root[np.searchsorted(pos, deep)] = np.searchsorted(pos, matched[deep])
    while not np.array_equal(up := root[root], root):
        root = up
    owner = np.searchsorted(begin, pos, side="right") - 1
    d, w = ident[owner], pos - begin[owner] + at[owner]
    order = np.lexsort((w, d, root))
    g, d, w = root[order], d[order], w[order]
    lead = np.maximum.accumulate(np.where(_first_of(g), np.arange(len(g)), 0))
    later = (d != d[lead]) | (w != w[lead])
    return merge_intervals(d[later], w[later], w[later] + length)


def _places(lead: np.ndarray, size: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each part of the places: the core's start before the k-gram and its end after that; first and last place in each context."""
    low, high = np.maximum(0, length - (size - lead)), np.minimum(length - gram, lead)
    for part in np.array_split(np.arange(length - gram + 1), CORES):
        a, b = int(part[0]), int(part[-1])
        yield a, length - b, np.maximum(low, a), np.minimum(high, b)


def _cores(raw: np.ndarray, off: np.ndarray, lead: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each part of the places: rows that have strings there, hash of their core, start and end of these strings in the row."""
    size = np.diff(off)
    found: list[list[np.ndarray]] = [[] for _ in range(CORES)]
    for r, s in row_chunks(off):
        prefix = prefix_hash(raw[off[r] : off[s]])
        for out, (before, after, low, high) in zip(found, _places(lead[r:s], size[r:s], length, gram), strict=True):
            row = np.flatnonzero(low <= high)
            pos = off[r + row] - off[r] + lead[r + row]
            at = lead[r + row]
            out.append(np.stack([r + row, span_hash(prefix, pos - before, pos + after).view(np.int64), at - high[row], at + length - low[row]]))
    for out in found:
        if out:
            row, core, start, end = np.concatenate(out, axis=1)
            yield row, core, start, end


def _shared_part(raw: np.ndarray, off: np.ndarray, lead: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in each row of all strings whose core another row has; an end of 0 if there are none."""
    start, end = np.full(len(lead), np.iinfo(np.int64).max), np.zeros(len(lead), np.int64)
    for row, core, s, e in _cores(raw, off, lead, length, gram):
        order = np.argsort(core)
        new = _first_of(core[order])
        keep = order[~(new & np.append(new[1:], True))]
        np.minimum.at(start, row[keep], s[keep])
        np.maximum.at(end, row[keep], e[keep])
    return start, end


def _pairs(raw: np.ndarray, begin: np.ndarray, lead: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, before and after the k-gram's begin, of what contexts ``one`` and ``two`` share around it byte by byte; 0 and 0 below ``length``."""
    before, after = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    reach = length - gram
    for a in range(0, len(one), 1 << 12):  # a part at a time bounds the memory
        i, j = one[a : a + (1 << 12), None], two[a : a + (1 << 12), None]
        step = np.arange(-reach, length)
        inside = (step >= -np.minimum(lead[i], lead[j])) & (step < np.minimum(size[i] - lead[i], size[j] - lead[j]))
        last = len(raw) - 1
        x, y = ((begin[k] + lead[k] + step).clip(0, last) for k in (i, j))
        other = ~inside | (raw[x] != raw[y])
        left, right = other[:, :reach][:, ::-1], other[:, reach:]
        low = np.where(left.any(axis=1), left.argmax(axis=1), reach)
        high = np.where(right.any(axis=1), right.argmax(axis=1), length)
        long = (low + high >= length) & (high >= gram)
        before[a : a + (1 << 12)], after[a : a + (1 << 12)] = low * long, high * long
    return before, after


class _Block:
    """Texts that are held until they fill a block of the index."""

    def __init__(self, length: int):
        self.length, self.rows, self.size = length, [], 0

    def add(self, group, ids, keys, at, raw, start, end) -> Iterator[pa.RecordBatch]:
        """Takes whole groups, rows of a group one after another; gives the intervals of blocks that are full."""
        last = np.append(_first_of(group)[1:], True) if len(group) else ()
        for closes, i, k, a, s, e in zip(last, ids.tolist(), keys.tolist(), at.tolist(), start.tolist(), end.tolist(), strict=True):
            self.rows.append((i, k, a, raw[s:e].tobytes()))
            self.size += e - s + 1
            if closes and self.size >= BLOCK_BYTES:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            ids, keys, at, texts = zip(*self.rows, strict=True)
            self.rows, self.size = [], 0
            number, ids, keys = _documents(np.array(ids, np.int64), np.array(keys, np.int64))
            d, s, e = repeated(list(texts), number, np.array(at, np.int64), self.length)
            yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(keys[d]), pa.array(s), pa.array(e)], ["id", "key", "start", "end"])


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _index_blocks(length: int, gram: int):
    """Intervals of rows (h, id, key, at, lead, data) that are sorted by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = _Block(length), []

        def part(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            h, ids, keys, at, lead = (np.asarray(rows.column(i)) for i in range(5))
            raw, off = byte_views(rows.column(5))
            start, end = _shared_part(raw, off, lead.astype(np.int64), length, gram)
            use = np.flatnonzero(end)
            # two contexts alone have one stretch in common
            first = _first_of(h[use])
            two = np.flatnonzero(first[:-1] & ~first[1:] & np.append(first[2:], True)) if len(use) > 1 else use[:0]
            one, two = use[two], use[two + 1]
            if len(one):
                swap = (ids[one] > ids[two]) | (ids[one] == ids[two]) & ((keys[one] > keys[two]) | (keys[one] == keys[two]) & (at[one] + lead[one] > at[two] + lead[two]))
                low, high = _pairs(raw, off[:-1], lead.astype(np.int64), np.diff(off), one, two, length, gram)
                alike = high > 0
                later = np.where(swap, one, two)[alike]
                place = at[later] + lead[later]
                yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.array(keys[later]), pa.array(place - low[alike]), pa.array(place + high[alike])], ["id", "key", "start", "end"])
                alone = np.zeros(len(h), bool)
                alone[one] = alone[two] = True
                use = use[~alone[use]]
            start, end = start[use], end[use]
            yield from block.add(h[use], ids[use], keys[use], at[use] + start, raw, off[use] + start, off[use] + end)

        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.asarray(batch.column(0))
            begin = int(np.searchsorted(h, h[-1]))  # the last k-gram may go on
            if begin or (held and held[-1].column(0)[-1].as_py() != h[0]):
                held.append(batch.slice(0, begin))
                yield from part(_joined(held))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from part(_joined(held))
        yield from block.close()

    return run


def _by_core(length: int, gram: int):
    """(core, id, key, at, bytes) of the strings of rows (h, id, key, at, lead, data), once for each part of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at, lead = (np.asarray(batch.column(i)) for i in range(1, 5))
            raw, off = byte_views(batch.column(5))
            for part, (row, core, s, e) in enumerate(_cores(raw, off, lead.astype(np.int64), length, gram)):
                core = mix(core.view(np.uint64) + np.uint64(part)).view(np.int64)
                for a in range(0, len(row), 1 << 14):
                    r = row[a : a + (1 << 14)]
                    start = s[a : a + (1 << 14)]
                    data = pa.array([raw[x:y].tobytes() for x, y in zip((off[r] + start).tolist(), (off[r] + e[a : a + (1 << 14)]).tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(core[a : a + (1 << 14)]), pa.array(ids[r]), pa.array(keys[r]), pa.array(at[r] + start), data], _CORE.replace(",", "").split(" ")[::2])

    return run


def _index_cores(length: int, most: int):
    """Rows of _CORE sorted by all columns but with bytes second: intervals (bytes null), and rows of cores with more than ``most`` different parts.

    Between batches, the different parts of one core are kept, or the last if there are too many.
    """

    def spans(ids, keys, start, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(start), pa.array(end), pa.nulls(len(ids), pa.binary())], ["id", "key", "start", "end", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, over = _Block(length), None, False  # over: what is kept was sent on
        for batch in batches:
            if not batch.num_rows:
                continue
            old = 0 if kept is None else kept.num_rows
            rows = batch if kept is None else _joined([kept, batch])
            core, ids, keys, at = (np.asarray(rows.column(i)) for i in range(4))
            raw, off = byte_views(rows.column(4))
            first = _first_of(core)
            first[1:] |= ~np.asarray(pc.equal(rows.column(4).slice(1), rows.column(4).slice(0, len(core) - 1)))
            lead = np.maximum.accumulate(np.where(first, np.arange(len(core)), 0))
            rest = np.flatnonzero(~first & ((ids != ids[lead]) | (keys != keys[lead]) | (at != at[lead])))
            if len(rest):
                yield spans(ids[rest], keys[rest], at[rest], at[rest] + np.diff(off)[rest])
            rows_of = np.flatnonzero(first)
            number = np.cumsum(_first_of(core[rows_of])) - 1
            count = np.bincount(number)
            send = count > most
            if over:
                send[0] = True
            out = rows_of[send[number] & ((rows_of >= old) | (not over))]
            if len(out):
                sent = rows.take(pa.array(out))
                yield pa.RecordBatch.from_arrays([*sent.columns[1:3], sent.column(3), pc.add(sent.column(3), pc.binary_length(sent.column(4)).cast(pa.int64())), sent.column(4)], ["id", "key", "start", "end", "data"])
            open_ = number == number[-1]
            use = rows_of[(count > 1)[number] & ~send[number] & ~open_]
            for found in block.add(core[use], ids[use], keys[use], at[use], raw, off[use], off[use + 1]):
                yield spans(*(np.asarray(c) for c in found.columns))
            over = bool(send[-1])
            keep = rows_of[open_]
            kept = rows.take(pa.array(keep[-1:] if over else keep))
        if kept is not None and not over and kept.num_rows > 1:
            raw, off = byte_views(kept.column(4))
            core, ids, keys, at = (np.asarray(kept.column(i)) for i in range(4))
            for found in block.add(core, ids, keys, at, raw, off[:-1], off[1:]):
                yield spans(*(np.asarray(c) for c in found.columns))
        for found in block.close():
            yield spans(*(np.asarray(c) for c in found.columns))

    return run


def _strings(length: int):
    """Every string of ``length`` bytes of rows (id, key, at, data), as two hashes (a 95-bit name), with its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_views(batch.column(3))
            ident, key, at = (np.asarray(batch.column(i)) for i in range(3))
            for a, b in row_chunks(off, 1 << 18):
                buf, bounds = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                p = np.arange(max(0, len(buf) - length + 1))
                row = np.searchsorted(bounds, p, side="right") - 1
                ok = p + length <= bounds[row + 1]
                p, row = p[ok], row[ok]
                one, two = span_hash(prefix_hash(buf), p, p + length), span_prime(prefix_prime(buf), p, p + length)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two), pa.array(ident[a + row]), pa.array(key[a + row]), pa.array(at[a + row] + p - bounds[row])], ["x", "y", "id", "key", "at"])

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, key, at, lead, bytes, big) of the requested contexts of each document."""
    for batch in batches:
        raw, off = byte_views(batch.column(2))
        want = batch.column(3)
        f = want.flatten()
        big, h, at, lead, size = (np.asarray(f.field(n)) for n in ("big", "h", "at", "lead", "size"))
        row = np.repeat(np.arange(batch.num_rows), np.asarray(want.value_lengths()))
        for a in range(0, len(row), 1 << 14):
            part = slice(a, a + (1 << 14))
            begin = off[row[part]] + at[part]
            data = pa.array([raw[s:e].tobytes() for s, e in zip(begin, begin + size[part], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[part]), *(pa.array(np.asarray(batch.column(i))[row[part]]) for i in (0, 1)), pa.array(at[part]), pa.array(lead[part]), data, pa.array(big[part])], ["h", "id", "key", "at", "lead", "data", "big"])


def duplicate_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, key, start, end): byte intervals to cut, maybe overlapping, by document. ``docs``: (id long, key long, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = docs.mapInArrow(released(_scan(length, gram)), _OPEN).repartition(n, "h", "salt").sortWithinPartitions("kind", "h", "salt", "ctx", "id", "key", "at").mapInArrow(released(_meet), _OPEN)
    met = checkpoint(met)
    cut = met.filter("kind = 1").select("id", "key", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    asks = met.filter("kind = 0").select("h", "id", "key", "at", F.col("len").alias("lead"), "size")
    crowd = asks.groupBy("h").count().filter(F.col("count") > BLOCK_CONTEXTS).select("h", F.lit(True).alias("big"))
    asks = asks.join(crowd, "h", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    # as many as the document is long: no more than its text
    wanted = asks.groupBy("id", "key").agg(F.collect_list(F.struct("h", "at", "lead", "size", "big")).alias("want"))
    got = docs.join(wanted, ["id", "key"]).select("id", "key", "text", "want").mapInArrow(released(_fetch), "h long, id long, key long, at long, lead int, data binary, big boolean")
    columns = ["h", "id", "key", "at", "lead", "data"]
    small = got.filter("not big").select(*columns).repartition(n, "h").sortWithinPartitions("h").mapInArrow(released(_index_blocks(length, gram)), _SPANS)
    if crowd.isEmpty():
        return cut.union(small)
    cores = got.filter("big").select(*columns).mapInArrow(released(_by_core(length, gram)), _CORE).repartition(n, "core").sortWithinPartitions("core", "data", "id", "key", "at")
    cores = cores.mapInArrow(released(_index_cores(length, BLOCK_CONTEXTS)), _SPANS + ", data binary")
    # in one job, so that texts are shuffled once for both
    both = checkpoint(cores.union(small.withColumn("data", F.lit(None).cast("binary"))))
    found = cut.union(both.filter("data is null").drop("data"))
    crowd = both.filter("data is not null").select("id", "key", F.col("start").alias("at"), "data")
    if crowd.isEmpty():
        return found
    names = crowd.mapInArrow(released(_strings(length)), "x long, y long, id long, key long, at long")
    firsts = names.groupBy("x", "y").agg(F.min(F.struct("id", "key", "at")).alias("first"))
    later = F.struct("id", "key", "at") != F.col("first")
    large = names.join(firsts, ["x", "y"]).filter(later).select("id", "key", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return found.union(large)


def _cut(text_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, out = [], [], [], []
            for value, spans in zip(batch.column(0), batch.column(1), strict=True):
                data = (value.as_py() or "").encode()
                kept, last, gone, runs = [], 0, 0, 0
                if spans.is_valid:
                    v = spans.values
                    s, e = np.asarray(v.field("start")), np.asarray(v.field("end"))
                    _, s, e = merge_intervals(np.zeros(len(s), np.int64), s, e)
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        kept.append(data[last:a])
                        gone += b - a
                        last = b
                    runs = len(s)
                kept.append(data[last:])
                rest = b"".join(kept)
                n_bytes.append(len(data))
                n_removed.append(gone)
                n_spans.append(runs)
                out.append(rest.decode("utf-8", "ignore") if text_out else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(out, pa.string()), *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "text" if text_out else "kept_sha256", *batch.schema.names[3:]])

    return run


def dedup(docs: DataFrame, text_out: bool = False, length: int = LENGTH, gram: int = GRAM, keep: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the hash of what is kept.

    With ``text_out`` the kept text itself; bytes of a character that was cut in part are dropped.
    The columns to ``keep`` follow.
    """
    base = _named(docs.select("doc_id", "text", *keep))
    spans = duplicate_spans(base.select("id", "key", "text"), length, gram).groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = base.join(spans, ["id", "key"], "left").select("text", "spans", F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"), *keep)
    name = "text" if text_out else "kept_sha256"
    own = T._parse_datatype_string(f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} string").fields
    return joined.mapInArrow(released(_cut(text_out)), T.StructType(own + [joined.schema[c] for c in keep]))


def _named(docs: DataFrame) -> DataFrame:
    """The rows with ``id`` for doc_id (null: the smallest), and ``key``: 0, or a hash of the text if the id doesn't name it alone."""
    shared = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("shared_id"))
    if shared.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:  # else the texts are shuffled
        shared = F.broadcast(shared)
    own = F.col("doc_id").isNotNull() & F.col("shared_id").isNull()
    named = docs.join(shared, F.col("doc_id") == F.col("shared_id"), "left")
    return named.withColumns({"id": F.coalesce("doc_id", F.lit(_NULL_ID).cast("long")), "key": F.when(own, F.lit(0).cast("long")).otherwise(F.xxhash64(F.coalesce("text", F.lit(""))))}).drop("doc_id", "shared_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM b WHERE len(h) >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS f FROM r)),
sp AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM sp),
j AS (SELECT b.doc_id, count(*) AS n, sum(e - s) AS gone, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM b JOIN k ON b.doc_id = k.doc_id GROUP BY b.doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN j ON b.doc_id = j.doc_id
"""
