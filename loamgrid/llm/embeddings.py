"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t differ by a squared distance of at most 2 - 2t. The space is rotated
to its principal axes (an orthonormal map, which changes no distance) and split into blocks. Each
block gets a share of that budget in proportion to its part of the variance. Two near vectors
cannot exceed the share in every block, so joining each block under its own share finds all pairs.

A block is joined over a grid on its two leading coordinates, with cells as wide as the block's
radius: a vector meets its own cell and the four neighbours that lie ahead, so each pair of cells
meets once. A crowded cell is cut into chunks that are met by all of the cell's visitors in turn,
so no task holds more than a chunk. Within a task the block's distances pick candidates, whose
cosine is then taken in full, in double precision; a pair is counted by the first block that finds
it. Tasks return link counts and spanning forests, never lists of pairs. Equal vectors are one
class, counted and not compared.

Edge cases: null vectors, and those that are zero, or hold null, NaN or infinite components, or
have another number of components than most, link with nothing (the last only with their like:
they are compared in a grid of their own, by dimension); an empty table gives an empty result; ids may
repeat, each row counts as a vector; a null id is never the least of a component that has others,
and such a row is not kept; a cosine of just the threshold is a link; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm._core import checkpoint, components, forest, released, share, table

THRESHOLD, BLOCKS, CHUNK = 0.9, 4, 8192
_SLACK = 1e-6


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-precision matrix of the packed float or double vectors, and its rows' norms."""
    raw = b"".join(v.as_py() for v in column)
    kind = "<f4" if len(raw) == 4 * dim * len(column) else "<f8"
    x = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, data): components as they are stored; dim 0 for vectors that link with nothing.

    Floats travel as floats and are made doubles where they are compared, which is exact.
    """
    for batch in batches:
        dims, data = [], []
        kind = "<f4" if pa.types.is_float32(batch.column(1).type.value_type) else "<f8"
        column = batch.column(1)
        for v in column:
            values = v.values if v.is_valid else None
            if values is None or not len(values) or values.null_count:
                dims.append(0)
                data.append(b"")
                continue
            x = np.asarray(values, dtype="<f8")
            norm = float(x @ x) if np.isfinite(x).all() else 0.0
            if norm == 0.0 or not np.isfinite(norm):
                # squares may over- or underflow although the components are fine
                top = float(np.abs(x).max()) if np.isfinite(x).all() else 0.0
                if top == 0.0:
                    dims.append(0)
                    data.append(b"")
                    continue
                x = x / top
            dims.append(len(x))
            data.append((x + 0.0).astype(kind).tobytes())  # + 0.0: no negative zeros
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "dim", "data"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension the sum of outer products of the unit vectors: one row per task and dimension."""
    sums: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for batch in batches:
        dims = np.asarray(batch.column(0))
        for d in np.unique(dims):
            x, norm = _units(batch.column(1).filter(pa.array(dims == d)), int(d))
            x = x / norm[:, None]
            sums[d] = sums.get(d, 0) + x.T @ x
            count[d] = count.get(d, 0) + len(x)
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([count[d]], pa.int64()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], ["dim", "n", "s"])


class Grid:
    """Rotation, blocks, budgets and radii of vectors of one dimension."""

    def __init__(self, second_moment: np.ndarray, threshold: float, blocks: int):
        dim = len(second_moment)
        value, axis = np.linalg.eigh(second_moment)
        value, axis = np.maximum(value[::-1], 0), axis[:, ::-1]
        blocks = max(1, min(blocks, dim))
        # axes are dealt out in turn, so each block has its share of strong and weak ones
        deal = [np.arange(b, dim, blocks) for b in range(blocks)]
        self.axes = [np.ascontiguousarray(axis[:, d]) for d in deal]
        part = np.array([value[d].sum() for d in deal])
        part = np.where(part.sum() > 0, part / max(part.sum(), 1e-300), 1 / blocks)
        part = (part + 1e-3) / (part + 1e-3).sum()  # a block without variance still gets a cell width
        self.budget = (2 - 2 * threshold) * part + _SLACK
        self.width = np.sqrt(self.budget) * (1 + 1e-9) + 1e-9

    def cells(self, unit: np.ndarray, b: int) -> np.ndarray:
        """The cell of each vector in block b, as two numbers."""
        y = unit @ self.axes[b][:, :2]
        c = np.floor(y / self.width[b]).astype(np.int64)
        return np.c_[c, np.zeros(len(c), np.int64)][:, :2] if c.shape[1] < 2 else c


_AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def _cell_key(dim: int, b: int, c: np.ndarray) -> np.ndarray:
    return ((np.int64(dim) * 64 + b) << 40) + ((c[:, 0] + (1 << 19)) << 20) + c[:, 1] + (1 << 19)


def _place(grids: dict[int, Grid], chunks: dict[int, int] | None):
    """Rows for the cells. Without ``chunks``: (cell, n) counts of residents. With: (cell, chunk, role, id, dim, data, n).

    Role 0 are a chunk's residents, 1 all residents of its cell, 2 visitors from the cells behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for d in np.unique(dims):
                mask = pa.array(dims == d)
                ids, data, size = np.asarray(batch.column(0).filter(mask)), batch.column(2).filter(mask), np.asarray(batch.column(3).filter(mask))
                x, norm = _units(data, int(d))
                unit = x / norm[:, None]
                grid = grids[int(d)]
                for b in range(len(grid.axes)):
                    c = grid.cells(unit, b)
                    own = _cell_key(int(d), b, c)
                    if chunks is None:
                        for k, n in zip(*np.unique(own, return_counts=True), strict=True):
                            counts[int(k)] = counts.get(int(k), 0) + int(n)
                        continue
                    cell, chunk, role, row = [], [], [], []
                    n_own = np.array([chunks.get(int(k), 1) for k in own])
                    mine = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n_own
                    for key, kind in [(own, 0), (own, 1)] + [(_cell_key(int(d), b, c + np.array(s)), 2) for s in _AHEAD]:
                        if kind == 0:
                            cell.append(key)
                            chunk.append(mine)
                            role.append(np.zeros(len(key), np.int32))
                            row.append(np.arange(len(key)))
                            continue
                        n = np.array([chunks.get(int(k), 0) for k in key])
                        r = np.repeat(np.arange(len(key)), n)
                        ch = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                        if kind == 1:  # a chunk's own residents needn't come twice
                            keep = ch != mine[r]
                            r, ch = r[keep], ch[keep]
                        cell.append(key[r])
                        chunk.append(ch)
                        role.append(np.full(len(r), kind, np.int32))
                        row.append(r)
                    row = np.concatenate(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.concatenate(chunk).astype(np.int32)), pa.array(np.concatenate(role)), pa.array(ids[row]), pa.array(np.full(len(row), d, np.int32)), data.take(pa.array(row)), pa.array(size[row])], ["cell", "chunk", "role", "id", "dim", "data", "n"])
        if chunks is None and counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["cell", "n"])

    return run


def _join(grids: dict[int, Grid], threshold: float):
    """Rows sorted by (cell, chunk, role): link counts (kind 0: id, links) and forest edges (kind 1: a, b)."""

    def near(grid: Grid, b: int, x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Linked (row of x, row of y) that block b is the first to find; x and y are unit rows."""
        out_i, out_j = [], []
        p, q = x @ grid.axes[b], y @ grid.axes[b]
        pp = np.einsum("ij,ij->i", p, p)
        step = max(1, 4_000_000 // max(1, len(x)))
        for a in range(0, len(y), step):
            r = q[a : a + step]
            # |p - r|^2 <= budget, with some slack for single precision
            d = p.astype(np.float32) @ r.T.astype(np.float32)
            d *= -2
            d += pp.astype(np.float32)[:, None]
            d += np.einsum("ij,ij->i", r, r).astype(np.float32)[None, :]
            i, j = np.nonzero(d <= grid.budget[b] + 1e-5)
            j = j + a
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 200_000):
                u, v = i[s : s + 200_000], j[s : s + 200_000]
                ok = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
                u, v = u[ok], v[ok]
                first = np.ones(len(u), bool)
                for e in range(b):
                    diff = (x[u] - y[v]) @ grid.axes[e]
                    first &= ~(np.einsum("ij,ij->i", diff, diff) <= grid.budget[e])
                diff = (x[u] - y[v]) @ grid.axes[b]
                first &= np.einsum("ij,ij->i", diff, diff) <= grid.budget[b]
                out_i.append(u[first])
                out_j.append(v[first])
        if not out_i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_i), np.concatenate(out_j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int] | None = None
        home_x: list[np.ndarray] = []
        home_id: list[np.ndarray] = []
        home_n: list[np.ndarray] = []
        ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def emit(a: np.ndarray, c: np.ndarray, n_a: np.ndarray, n_c: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(a):
                return
            ids, at = np.unique(np.concatenate([a, c]), return_inverse=True)
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, at, np.concatenate([n_c, n_a]))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(n)], ["kind", "a", "b"])
            node, root = forest(a, c)
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(keep.sum()), np.int32)), pa.array(node[keep]), pa.array(root[keep])], ["kind", "a", "b"])

        def settle(grid: Grid, b: int) -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if ready is None and home_x:
                x, ids, size = ready = np.concatenate(home_x), np.concatenate(home_id), np.concatenate(home_n)
                i, j = near(grid, b, x, x, True)
                yield from emit(ids[i], ids[j], size[i], size[j])

        grid, b = None, 0
        for batch in batches:
            cell, chunk, role, ids, dims = (np.asarray(batch.column(k)) for k in range(5))
            size = np.asarray(batch.column(6))
            change = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1])]) if len(cell) else []
            for s, e in zip(change, [*change[1:], len(cell)], strict=True):
                if here != (cell[s], chunk[s]):
                    if here is not None:
                        yield from settle(grid, b)
                    here, home_x, home_id, home_n, ready = (cell[s], chunk[s]), [], [], [], None
                    grid, b = grids[int(dims[s])], int(cell[s] >> 40) % 64
                x, norm = _units(batch.column(5).slice(s, e - s), int(dims[s]))
                x = x / norm[:, None]
                if role[s] == 0:
                    home_x.append(x)
                    home_id.append(ids[s:e])
                    home_n.append(size[s:e])
                    continue
                yield from settle(grid, b)
                if ready is None:
                    continue
                i, j = near(grid, b, ready[0], x, False)
                a, c = ready[1][i], ids[s:e][j]
                if role[s] == 1:  # chunks of one cell meet both ways round
                    once = a < c
                    a, c, i, j = a[once], c[once], i[once], j[once]
                yield from emit(a, c, ready[2][i], size[s:e][j])
        if here is not None:
            yield from settle(grid, b)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding)."""
    packed = vectors.select("vec_id", "embedding").mapInArrow(released(_pack), "vec_id long, dim int, data binary")
    rows = checkpoint(packed)
    good = rows.filter("dim > 0")
    classes = good.groupBy("dim", "data").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = checkpoint(classes.withColumn("id", F.monotonically_increasing_id()))
    moments = classes.select("dim", "data").mapInArrow(released(_moments), "dim int, n long, s array<double>")
    summed = moments.select("dim", "n", F.posexplode("s").alias("at", "v")).groupBy("dim", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    mean = F.struct("at", (F.col("v") / F.col("n")).alias("mean"))
    means = summed.groupBy("dim").agg(F.transform(F.sort_array(F.collect_list(mean)), lambda x: x["mean"]).alias("means")).toArrow()  # a row per dimension, of its square numbers
    grids = {d: Grid(np.asarray(v.values).reshape(d, d), threshold, blocks) for d, v in zip(means.column("dim").to_pylist(), means.column("means"), strict=True)}
    shared = share(vectors.sparkSession, grids)  # dimension squared numbers each
    keyed = classes.select("id", "dim", "data", "n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _place(shared(), None)(batches)

    cells = keyed.mapInArrow(released(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # at most blocks * (2 / width + 2)^2 cells, whatever the number of vectors
    chunks = {r.cell: -(-r.n // chunk) for r in cells.collect()}
    plan = share(vectors.sparkSession, (grids, chunks))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _place(*plan())(batches)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _join(shared(), threshold)(batches)

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.mapInArrow(released(place), "cell long, chunk int, role int, id long, dim int, data binary, n long")
    found = checkpoint(placed.repartition(max(n, 48), "cell", "chunk").sortWithinPartitions("cell", "chunk", "role").mapInArrow(released(join), "kind int, a long, b long"))
    part = components(found.filter("kind = 1").select("a", "b"))
    direct = found.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others"))
    full = classes.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(direct, "id", "left")
    root = full.groupBy("component").agg(F.min("first").alias("component_id"))
    per = full.join(root, "component").select("dim", "data", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(per, ["dim", "data"], "left")
    alone = F.col("dim") == 0
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS q,
  coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 1) AS bad FROM embeddings),
g AS (SELECT vec_id, e, sqrt(q) AS n FROM v WHERE bad = 0 AND q > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= CAST(0.9 AS DOUBLE)),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = e.vec_id
"""
