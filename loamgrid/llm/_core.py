"""Shared plumbing of the training-data operators: buffers, hashing, checkpoints, worker state."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass handles at once; keeps temporaries near the CPU caches.
CHUNK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder that all executors share (``spark.checkpoint.dir``).

    The session's folder is used; one is set only where the session has none, as in local tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = f"/tmp/loamgrid-checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(where)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, to be worked on in short batches."""
    return short_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def worker_state(name: str) -> types.ModuleType:
    """A namespace that lives as long as the worker runs tasks of one operator, so caches outlast a task."""
    return sys.modules.setdefault(f"_loamgrid_state_{name}", types.ModuleType(f"_loamgrid_state_{name}"))


def _trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task as one of an operator whose worker keeps no caches of operators before, nor freed memory.

    Workers serve many operators in turn; what one has cached must not weigh on the next.
    """
    own = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sys.modules.setdefault("_loamgrid_operator", types.ModuleType("_loamgrid_operator"))
        if getattr(now, "name", None) != own:
            now.name = own
            for key in [k for k in sys.modules if k.startswith("_loamgrid_state_")]:
                del sys.modules[key]
            gc.collect()
            _trim()
        try:
            yield from task(batches)
        finally:
            _trim()

    return run


def short_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches hold 2 MB: whole texts are long, and batches count for both ends' memory.

    A setting of the session that says less, or was made by the user, stays.
    """
    if spark.conf.get(_BATCH_BYTES) == str(64 << 20):  # as Spark sets it
        spark.conf.set(_BATCH_BYTES, 2 << 20)
    return spark


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast an object of any class of this package; the result gives it back in a task.

    It is pickled with its class, so workers need no copy of the package, and unpickled once a worker.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    name = f"shared_{uuid.uuid4().hex}"

    def get() -> object:
        state = worker_state("shared")
        if getattr(state, "name", None) != name:
            state.value = None
            state.value, state.name = pickle.loads(sent.value), name
        return state.value

    return get


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of (value + 1) * BASE**i, one longer than the values."""
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal contents give equal values wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


PRIME, _PRIME_BASE = np.int64(2**31 - 1), 1_103_515_245


def prefix_prime(values: np.ndarray) -> np.ndarray:
    """As prefix_hash, in the field of a prime: what collides in one of the two doesn't in the other."""
    up, _ = _prime_powers(len(values))
    out = np.empty(len(values) + 1, np.int64)
    out[0] = 0
    np.cumsum((values.astype(np.int64) + 1) * up[: len(values)] % PRIME, out=out[1:])
    return out


def span_prime(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) below 2**31 - 1; the values must be below 2**31."""
    _, down = _prime_powers(len(prefix))
    return (prefix[end] - prefix[start]) % PRIME * down[start] % PRIME


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("prime up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for name, base in (("prime up", _PRIME_BASE), ("prime down", pow(_PRIME_BASE, -1, int(PRIME)))):
            p = np.ones(size, np.int64)
            width, step = 1, base % int(PRIME)
            while width < size:  # p[width:2 * width] = p[:width] * base**width
                part = min(width, size - width)
                p[width : width + part] = p[:part] * step % PRIME
                width, step = 2 * width, step * step % int(PRIME)
            _POWERS[name] = p
    return _POWERS["prime up"], _POWERS["prime down"]


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """Minimum (or other idempotent fold) of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    m, s = values, 1
    while s * 2 <= width:
        m = op(m[:-s], m[s:])
        s *= 2
    return op(m[:n], m[width - s : width - s + n])


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Mask of the values that are the minimum of some window of ``width``; ties keep all minima.

    The choice depends on a window's contents alone, so two equal windows select equal places.
    Fewer than ``width`` values are one window.
    """
    if not len(h):
        return np.zeros(0, bool)
    width = min(width, len(h))
    low = sliding(h, width)
    pad = np.zeros(width - 1, h.dtype)
    return sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h


def merge_intervals(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of touching or overlapping half-open intervals within each key."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    rank = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + rank * span) - rank * span
    new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return key[first], start[first], np.maximum.reduceat(end, first)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the graph of the given edges."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    x, y = flat[:n], flat[n:]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    parts: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        a = np.concatenate([np.asarray(p.column(0)) for p in parts])
        b = np.concatenate([np.asarray(p.column(1)) for p in parts])
        node, root = forest(a, b)
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])

    rows = 0
    for batch in batches:
        parts.append(batch)
        rows += batch.num_rows
        if rows >= flush:
            parts = [out()]
            rows = parts[0].num_rows
            if rows >= flush // 2:
                yield parts.pop()
                rows = 0
    if parts:
        yield out()


def components(edges: DataFrame, one_task: int = 2_000_000) -> DataFrame:
    """Connected components of the edges (a long, b long): rows (node, component), component < node.

    Every task first contracts the edges it holds to a spanning forest, so a dense group of copies
    leaves at most one edge per node. While more than ``one_task`` edges remain, rounds of
    min-label exchange with pointer jumping run distributed, each cut by a checkpoint; what
    remains below that checked bound is finished by one task. Nodes without edges don't appear;
    an empty input gives an empty result.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contract(batches, 1_000_000)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contract(batches, 1 << 60)

    schema = "a long, b long"
    e = checkpoint(edges.select("a", "b").mapInArrow(released(local), schema))
    while e.count() > one_task:
        # large star then small star (Kiveris et al.): both keep connectivity and shorten trees
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low2.select("a", F.col("m").alias("b")))
        after = checkpoint(small.distinct().mapInArrow(released(local), schema).distinct())
        if after.exceptAll(e.distinct()).isEmpty() and e.distinct().count() == after.count():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        e = after
    return e.coalesce(1).mapInArrow(released(final), schema).select(F.col("a").alias("node"), F.col("b").alias("component"))
