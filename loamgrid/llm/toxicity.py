"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (3 to 5 characters, lower case, hashed to 2**20 buckets) of a
text. Of the labelled texts, each bucket's log ratio of its share in toxic and in other documents
is taken; the buckets with the strongest ratios are kept, scaled by them, and weighted by a
logistic regression. Scoring looks every n-gram of every whole text up in the kept buckets.

Labels come from a sample of at most about ``max_rows`` labelled documents, chosen by a hash of
the id; the sample is small enough to broadcast, so no text is shuffled.

Edge cases: null and empty texts have no features and get the base rate as score; documents without
a label are scored alike; several labels of one document count as toxic if one is; without labels
of both kinds every score is the base rate (0 if there is none); null ids are scored and have no
label; rows that share an id share its labels and are scored by their own texts; of buckets that tie
for the last place the lower number is kept; a score of 0.5 is predicted 1; texts of any length are
read whole; repeated rows get equal results; an empty table gives an empty result; extra columns are
ignored.

Sizes of the model, whatever the corpus: 2**20 buckets, of which ``max_features`` are kept; a bucket
seen in one labelled text alone is none of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm._core import checkpoint, crc_mod, prefix_hash, released, share, span_hash, table

ORDERS, BITS, MAX_FEATURES, MAX_ROWS = (3, 4, 5), 20, 4096, 12_000
_SPREAD, _CHARS = 1 << 32, 1 << 19


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, row bounds) of runs of rows, in lower case."""
    a, size, part = 0, 0, []
    for i, t in enumerate([*texts, None]):
        if i == len(texts) or size >= _CHARS:
            if part:
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in part])])
                yield a, np.frombuffer("".join(part).encode("utf-32-le"), np.uint32), bounds
            a, size, part = i, 0, []
        if i < len(texts):
            part.append((t or "").lower())
            size += len(part[-1])


def _buckets(points: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct (row << BITS | bucket) of all n-grams; with ``wanted`` only of the buckets marked there."""
    if not len(points):
        return np.zeros(0, np.int64)
    prefix, found = prefix_hash(points), []
    for n in ORDERS:
        if len(points) < n:
            continue
        start = np.arange(len(points) - n + 1)
        b = (span_hash(prefix, start, start + n) >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            start = np.flatnonzero(wanted[b])
            b = b[start]
        row = np.searchsorted(bounds, start, side="right") - 1
        ok = start + n <= bounds[row + 1]
        found.append(row[ok] << BITS | b[ok])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents with it by label): summed over a task before anything is sent."""
    count = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        y = np.asarray(batch.column(0))
        for a, points, bounds in _chunks(batch.column(1).to_pylist()):
            f = _buckets(points, bounds)
            label = y[a + (f >> BITS)]
            for k in (0, 1):
                count[k] += np.bincount(f[label == k] & (1 << BITS) - 1, minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(count.any(axis=0))
    for i in range(0, len(at), 65536):
        p = at[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(count[0, p]), pa.array(count[1, p])], ["bucket", "neg", "pos"])


class Model:
    """Kept buckets, their weights, and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def table(self) -> np.ndarray:
        t = np.zeros(1 << BITS)
        t[self.buckets] = self.weights
        return t


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression on a sparse matrix, by accelerated gradient."""
    n = len(y)

    def right(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * w[cols], minlength=n)

    def left(g: np.ndarray) -> np.ndarray:
        return np.bincount(cols, values * g[rows], minlength=width) / n

    top, u = 1.0, np.full(width, 1 / np.sqrt(max(1, width)))
    for _ in range(12):  # the greatest curvature sets the step
        u = left(right(u))
        top = float(np.linalg.norm(u)) or 1.0
        u /= top
    rate = 1.0 / (0.25 * (1.2 * top + 1) + penalty)
    w, b = np.zeros(width), 0.0
    v, c = w.copy(), b
    for k in range(steps):
        g = 1 / (1 + np.exp(-np.clip(right(v) + c, -30, 30))) - y
        w2 = v - rate * (left(g) + penalty * v)
        b2 = c - rate * g.mean()
        m = k / (k + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on the labelled rows (doc_id, ``label``) of ``docs``."""
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD)) < int(_SPREAD * min(1.0, max_rows / max(1, total))))
    sample = checkpoint(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text", F.xxhash64("text").alias("key")))  # at most about max_rows ids
    t = sample.mapInArrow(released(_tally), "bucket int, neg int, pos int").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).filter("neg + pos > 1").toArrow()  # at most 2**20 rows
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    n_neg, n_pos = n.get(0, 0), n.get(1, 0)
    rate = n_pos / max(1, n_pos + n_neg)
    bias = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    bucket, neg, pos = (np.asarray(t.column(c)) for c in ("bucket", "neg", "pos"))
    if not n_neg or not n_pos or not len(bucket):
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    p, q = (pos + 1) / (n_pos + 2), (neg + 1) / (n_neg + 2)
    ratio = np.log(p / q)
    # strength: the gain in log likelihood from knowing the bucket's rates by label
    both = (pos + neg + 1) / (n_pos + n_neg + 2)
    gain = n_pos * (p * np.log(p / both) + (1 - p) * np.log((1 - p) / (1 - both))) + n_neg * (q * np.log(q / both) + (1 - q) * np.log((1 - q) / (1 - both)))
    top = np.lexsort((bucket, -gain))[:max_features]
    kept, scale = bucket[top].astype(np.int64), ratio[top]
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[shared.value] = True
        for batch in batches:
            out = [[] for _ in range(batch.num_rows)]
            for a, points, bounds in _chunks(batch.column(1).to_pylist()):
                f = _buckets(points, bounds, wanted)
                cut = np.searchsorted(f >> BITS, np.arange(len(bounds)))
                for r in range(len(bounds) - 1):
                    out[a + r] = (f[cut[r] : cut[r + 1]] & (1 << BITS) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int32()))], ["y", "key", "f"])

    got = sample.mapInArrow(released(features), "y int, key long, f array<int>").toArrow()  # the sample's kept features only
    got = got.sort_by([("key", "ascending"), ("y", "ascending")])  # sums don't depend on how the table is cut
    y = np.asarray(got.column("y")).astype(float)
    lists = got.column("f").combine_chunks()
    size = np.asarray(lists.value_lengths())
    cols = place[np.asarray(lists.flatten())]
    norm = np.sqrt(np.maximum(np.bincount(np.repeat(np.arange(len(y)), size), scale[cols] ** 2, minlength=len(y)), 1)).mean()
    w, b = fit_logistic(np.repeat(np.arange(len(y)), size), cols, scale[cols] / norm, y, len(kept))
    weights = w * scale / norm
    return Model(kept, weights, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from the text alone."""
    shared = share(docs.sparkSession, model)  # at most max_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        weight = model.table()
        wanted = weight != 0
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for a, points, bounds in _chunks(batch.column(1).to_pylist()):
                f = _buckets(points, bounds, wanted)
                z[a : a + len(bounds) - 1] += np.bincount(f >> BITS, weight[f & (1 << BITS) - 1], minlength=len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out rows (crc32 of the id mod 5 is 0) teach nothing."""
    held = crc_mod("doc_id", 5) == 0
    model = train(docs, labels.filter(~held), max_rows=max_rows)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
