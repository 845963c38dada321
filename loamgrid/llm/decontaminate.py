"""Benchmark decontamination by winnowing.

Words are hashed, each run of ``K`` words gives a k-gram hash, and of every ``window - K + 1``
consecutive k-grams the smallest is kept on both sides. Two texts that share a window of words
share the k-grams in it, so they keep the same one: joining the kept hashes finds every shared
window. Each hit is extended to the windows around it, which are looked up by hash and then compared
word by word. Items shorter than the window are one window of their own length and are looked up by
that whole n-gram. Equal windows of different items are one class with a list of its items, so a
preamble that all items share is found once and not once an item.

An index of the items is broadcast if its counted size (bytes of texts and ids, and rows) is below a
bound; beyond it, the kept hashes of both sides are joined by a shuffle (inner joins, whose hot keys
adaptive execution splits) and each (document, item) pair found is extended.

Edge cases: null and empty texts have no words and are never contaminated; an item without words
matches nothing; repeated item ids count once; a null item id is written as an empty id; repeated
document rows, and rows of a null or shared id, each give a row of their own; of hashes that tie in a
window all are kept; texts and words of any length are read whole; an empty benchmark leaves every
document clean; an empty document table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm._core import byte_views, prefix_hash, released, row_chunks, share, span_hash, table, winnow

WINDOW, K = 13, 5
#: Items' words that may be broadcast (8 bytes a word and about as much again for its k-grams).
MAX_BROADCAST_WORDS = 2_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_CLASS = np.zeros(256, np.uint8)
_CLASS[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CLASS[0x41:0x5B] = 1


class Words:
    """Words of rows of text: hashes, each row's first word (one more for the end), and the letters."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.hashes, self.bounds, self.first, self.size, self.letters = _words(raw, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows, and each row's first word (one more for the end)."""
    return _words(raw, offsets)[:2]


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    flag = np.zeros(len(raw) + 1, np.int8)
    flag[:-1] = _CLASS[raw]
    inside = flag[:-1].astype(bool)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    start[edges] = inside[edges]  # a word ends with its row
    first = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edges - 1] = inside[edges - 1]
    end = np.flatnonzero(stop) + 1
    lower = _LOWER[raw]
    h = span_hash(prefix_hash(lower), first, end) if len(first) else np.zeros(0, np.uint64)
    return h, np.searchsorted(first, offsets), first, end - first, lower


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words of a from each place i on are those of b from j on, letter by letter."""
    if not len(i):
        return np.zeros(0, bool)
    width = len(b.hashes) + 1
    pair, back = np.unique((i[:, None] + np.arange(n)) * width + j[:, None] + np.arange(n), return_inverse=True)
    x, y = pair // width, pair % width
    ok = a.size[x] == b.size[y]
    x, y, live = x[ok], y[ok], np.flatnonzero(ok)
    size = a.size[x]
    begin = np.cumsum(size) - size
    for s in range(0, len(x), 1 << 16):  # a part at a time bounds the memory
        e = min(len(x), s + (1 << 16))
        step = np.arange(size[s:e].sum()) - np.repeat(begin[s:e] - begin[s], size[s:e])
        equal = a.letters[np.repeat(a.first[x[s:e]], size[s:e]) + step] == b.letters[np.repeat(b.first[y[s:e]], size[s:e]) + step]
        ok[live[s:e]] = np.logical_and.reduceat(equal, begin[s:e] - begin[s])
    return ok[back.reshape(-1, n)].all(axis=1)


def grams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they lie in one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(m)
    row = np.searchsorted(bounds, at, side="right")
    return span_hash(prefix_hash(words), at, at + n), bounds[np.minimum(row, len(bounds) - 1)] >= at + n


def kept(words: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the k-grams that winnowing keeps in rows of at least ``window`` words."""
    h, whole = grams(words, bounds, k)
    if not len(h):
        return h, np.zeros(0, np.int64)
    # k-grams over a row's end sort last and are dropped afterwards
    h = np.where(whole, np.minimum(h, np.uint64(2**64 - 2)), np.uint64(2**64 - 1))
    at = np.flatnonzero(winnow(h, window - k + 1) & whole)
    return h[at], at


class Index:
    """Windows of a set of items, ready for lookup of documents' words.

    ``classes`` of a window's length: the hash and a place of each different window, sorted by hash,
    and the items that hold it (``owners`` from ``owned[c]`` to ``owned[c + 1]``).
    """

    def __init__(self, texts: pa.Array, names: list[str], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.words = Words(*byte_views(texts))
        words, bounds = self.words.hashes, self.words.bounds
        sizes = np.diff(bounds)
        ids = {n: i for i, n in enumerate(sorted(set(names)))}
        self.names = list(ids)
        owner = np.array([ids[n] for n in names], np.int64)
        item = np.repeat(owner, sizes)
        self.kept = np.unique(kept(words, bounds, window, k)[0])
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.owners, self.owned = np.zeros(0, np.int64), np.zeros(1, np.int64)
        for n in sorted({window, *sizes[(sizes > 0) & (sizes < window)].tolist()}):
            h, whole = grams(words, bounds, n)
            at = np.flatnonzero(whole)
            if n < window:  # the items that are just as long
                at = bounds[:-1][sizes == n]
            self._add(n, h[at], at, item[at])

    def _add(self, n: int, h: np.ndarray, at: np.ndarray, item: np.ndarray) -> None:
        hashes, places, number = [], [], np.full(len(h), -1)
        left = np.argsort(h, kind="stable")
        made = 0
        while len(left):  # once, unless different windows have one hash
            first = np.concatenate([[True], h[left[1:]] != h[left[:-1]]])
            group = np.cumsum(first) - 1
            lead = left[first]
            same = same_words(self.words, at[left], self.words, at[lead[group]], n)
            hashes.append(h[lead])
            places.append(at[lead])
            number[left[same]] = made + group[same]
            made += len(lead)
            left = left[~same]
        h, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (places, np.int64)))
        order = np.argsort(h, kind="stable")
        base = len(self.owned) - 1
        self.classes[n] = h[order], at[order], base
        place = np.empty(made, np.int64)
        place[order] = np.arange(made)
        pair = np.unique(place[number] * max(1, len(self.names)) + item) if len(number) else number
        c = pair // max(1, len(self.names))
        self.owned = np.concatenate([self.owned, len(self.owners) + np.searchsorted(c, np.arange(made), side="right")])
        self.owners = np.concatenate([self.owners, pair % max(1, len(self.names))])

    def find(self, docs: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word + 1, class) of every occurrence of an item's window."""
        out, words, bounds = [(np.zeros(0, np.int64),) * 3], docs.hashes, docs.bounds
        for n, (h, place, base) in self.classes.items():
            if not len(h) or len(words) < n:
                continue
            g, whole = grams(words, bounds, n)
            if n == self.window:
                k, at = kept(words, bounds, n, self.k)
                at = at[_known(k, self.kept)]
                at = np.unique((at[:, None] - np.arange(n - self.k + 1)).ravel())
                at = at[(at >= 0) & (at < len(g))]
            else:
                at = np.arange(len(g))
            at = at[whole[at]]
            i, j = _matches(g[at], h)
            s = at[i]
            same = same_words(docs, s, self.words, place[j], n)
            out.append((s[same], s[same] + n, base + j[same]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def items(self, classes: np.ndarray) -> list[str]:
        """Names of the items that hold a window of the classes, sorted."""
        found = np.unique(np.concatenate([self.owners[self.owned[c] : self.owned[c + 1]] for c in classes.tolist()]))
        return [self.names[i] for i in found.tolist()]


def _known(h: np.ndarray, index: np.ndarray) -> np.ndarray:
    return index[np.minimum(np.searchsorted(index, h), len(index) - 1)] == h if len(index) else np.zeros(len(h), bool)


def _matches(h: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position in h, position in the sorted index) of equal values."""
    if not len(h) or not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.searchsorted(index, h, side="left")
    hit = np.flatnonzero(index[np.minimum(lo, len(index) - 1)] == h)
    lo = lo[hit]
    count = np.searchsorted(index, h[hit], side="right") - lo
    i = np.repeat(hit, count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return i, j


def _sha(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _verdict(ids, n_words, n_hit, n_items, sha) -> pa.RecordBatch:
    bad = (n_hit > 0) & (20 * n_hit >= n_words)
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _scan(batches: Iterator[pa.RecordBatch], index: Index, keep: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    empty = _sha([])
    known: dict[bytes, tuple[int, str]] = {}  # what the last sets of classes gave
    for batch in batches:
        more = batch.select(keep) if keep else None
        raw, off = byte_views(batch.column(1))
        for a, b in row_chunks(off):
            docs = Words(raw, off[a : b + 1])
            bounds = docs.bounds
            s, e, c = index.find(docs)
            hit = np.zeros(len(docs.hashes) + 1, np.int64)
            np.add.at(hit, s, 1)
            np.add.at(hit, e, -1)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])[bounds])
            n_items, sha = np.zeros(b - a, np.int64), [empty] * (b - a)
            width = len(index.owned)
            pair = np.unique((np.searchsorted(bounds, s, side="right") - 1) * width + c)
            row, c = pair // width, pair % width
            first = np.flatnonzero(np.diff(row, prepend=-1))
            for r, own in zip(row[first].tolist(), np.split(c, first[1:]), strict=True) if len(row) else ():
                if (key := own.tobytes()) not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    names = index.items(own)
                    known[key] = len(names), _sha(names)
                n_items[r], sha[r] = known[key]
            out = _verdict(batch.column(0).slice(a, b - a), np.diff(bounds), n_hit, n_items, sha)
            if whole:
                full = np.searchsorted(bounds, s[e - s == index.window], side="right") - 1
                out = out.append_column("whole", pa.array(np.bincount(full, minlength=b - a) > 0))
            yield out if more is None else pa.RecordBatch.from_arrays(out.columns + more.slice(a, b - a).columns, out.schema.names + keep)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, max_broadcast_words: int = MAX_BROADCAST_WORDS, keep: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """Per document: words, words inside an item's window, items found, the verdict, and the columns to ``keep``.

    With ``whole`` a column of that name tells whether a window of full length occurs: items shorter
    than the window, that any text may hold, don't count there.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(F.col("text").isNotNull())
    more = [c for c in keep if c != "text"]
    docs = docs.select("doc_id", "text", *more)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id") + 8), F.lit(0))).first()[0]
    if size <= 2 * max_broadcast_words:  # a word and its end take two bytes at least
        t = items.toArrow()
        index = share(docs.sparkSession, Index(t.column("text"), t.column("item_id").to_pylist(), window, k))
        own = T._parse_datatype_string(SCHEMA + ", whole boolean" * whole).fields
        schema = T.StructType(own + [docs.schema[c] for c in keep])
        return docs.mapInArrow(released(lambda batches: _scan(batches, index(), list(keep), whole)), schema)
    found = _joined(docs.select("doc_id", "text"), items, window, k)
    if not whole:
        found = found.drop("whole")
    if not keep:
        return found.drop("doc_key")
    # rows of one id and text have one verdict
    key = _row_key("doc_id", "text")
    own = [c for c in found.columns if c not in ("doc_id", "doc_key")]
    verdict = found.groupBy("doc_key").agg(*[F.first(c).alias(c) for c in own])
    return docs.withColumn("doc_key", key).join(verdict, "doc_key").select("doc_id", *own, *keep)


def _row_key(name: str, text: str) -> Column:
    """128 bits for an id with its text: at 64 bits, rows beyond 10**9 begin to meet by chance."""
    return F.md5(F.concat(F.coalesce(F.col(name).cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))


def _joined(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The same by shuffles only; no side is held whole by a task."""
    docs = docs.withColumn("doc_key", _row_key("doc_id", "text"))
    items = items.withColumn("item_key", _row_key("item_id", "text"))

    def bounds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_views(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[n < window]).astype(np.int32)) if len(n := np.diff(word_hashes(raw, off)[1])) else pa.array([], pa.int32())], ["n"])

    short = [r[0] for r in items.select("text").mapInArrow(released(bounds_of), "n int").distinct().collect() if r[0]]  # at most window - 1 rows

    def prints(of_items: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = byte_views(batch.column(1))
                ids = batch.column(0)
                for a, b in row_chunks(off):
                    words, bounds = word_hashes(raw, off[a : b + 1])
                    sizes = np.diff(bounds)
                    h, at = kept(words, bounds, window, k)
                    out = [(h, at)]
                    for n in short:
                        g, whole = grams(words, bounds, n)
                        p = bounds[:-1][sizes == n] if of_items else np.flatnonzero(whole)
                        out.append((g[p] ^ np.uint64(n), p))
                    h, at = (np.concatenate(x) for x in zip(*out, strict=True))
                    pair = np.unique(np.stack([h.view(np.int64), a + np.searchsorted(bounds, at, side="right") - 1]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), ids.take(pa.array(pair[1]))], ["h", "key"])

        return run

    left = docs.select("doc_key", "text").mapInArrow(released(prints(False)), "h long, key string").withColumnRenamed("key", "doc_key")
    right = items.select("item_key", "text").mapInArrow(released(prints(True)), "h long, key string").withColumnRenamed("key", "item_key").distinct()
    pairs = left.join(right, "h").select("doc_key", "item_key").distinct()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, spans, full = [], [], [], []
            for key, text, name, item in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = Words(*byte_views(pa.array([text.as_py()], pa.string())))
                s, e, _ = Index(pa.array([item.as_py()], pa.string()), [name.as_py()], window, k).find(words)
                if len(s):
                    hit = np.zeros(len(words.hashes) + 1, np.int64)
                    np.add.at(hit, s, 1)
                    np.add.at(hit, e, -1)
                    keys.append(key.as_py())
                    names.append(name.as_py())
                    spans.append(np.flatnonzero(np.cumsum(hit)[:-1] > 0).astype(np.int32))
                    full.append(bool((e - s == window).any()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(spans, pa.list_(pa.int32())), pa.array(full, pa.bool_())], ["doc_key", "item_id", "hits", "whole"])

    once = docs.select("doc_key", "text").dropDuplicates(["doc_key"])
    found = pairs.join(once, "doc_key").join(items.select("item_key", "item_id", F.col("text").alias("item")), "item_key").select("doc_key", "text", "item_id", "item").mapInArrow(released(extend), "doc_key string, item_id string, hits array<int>, whole boolean")
    per_doc = found.groupBy("doc_key").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), F.max("whole").alias("whole"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_views(batch.column(2))
            for a, b in row_chunks(off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(word_hashes(raw, off[a : b + 1])[1]), pa.int64())], ["doc_id", "doc_key", "n_words"])

    counted = docs.select("doc_id", "doc_key", "text").mapInArrow(released(count), "doc_id long, doc_key string, n_words long")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(per_doc, "doc_key", "left").select("doc_key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("whole", F.lit(False)).alias("whole"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
