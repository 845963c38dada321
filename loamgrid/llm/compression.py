"""LM scoring by compression: zstandard sizes under an in-domain and a general dictionary.

A text that an in-domain dictionary compresses better than a general one is like the domain. The
score is the normalised difference (general - in-domain) / general of the two compressed sizes,
both in bits.

The dictionaries are built from counts over the whole corpus, by the COVER idea: every gram of
``GRAM`` bytes of every document is counted (hashed to buckets), for all documents and for those of
the domain; then segments of ``SEGMENT`` bytes that cover many grams whose counts are high for the
respective dictionary are gathered from all documents. The best of the whole corpus are chosen: each
task offers as many as could be chosen in all, so none that belongs to the best is missed and the
result doesn't depend on the partitions.

What is gathered grows with the corpus: dictionaries, buckets and chosen segments all grow as the
square root of its bytes (``sizes``): 64 KB a dictionary up to 0.1 GB of text, 1.1 MB at 30 GB, 64 MB
at 100 TB. They do not grow in proportion, since every task holds both dictionaries; the counts that
are shuffled on the way do.

Edge cases: null and empty texts have size and score 0; without documents of the domain the
in-domain dictionary is empty; texts of any length are compressed whole; segments that tie go in the
order of their bytes; null ids are scored but never of the domain, rows that share an id are of the
domain together; repeated rows get equal results; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm._core import byte_views, checkpoint, prefix_hash, released, row_chunks, share, span_hash, table

GRAM, BITS, SEGMENT, DICT_BYTES = 8, 17, 64, 65_536
#: Bytes of text up to which a dictionary has DICT_BYTES and grams 2**BITS buckets.
BASE_BYTES = 100_000_000
LEVEL = 3
#: Ids of labelled documents that may be broadcast.
MAX_BROADCAST_IDS = 1_000_000


def sizes(corpus_bytes: int) -> tuple[int, int]:
    """(bytes of a dictionary, bits of a bucket's number) for a corpus."""
    growth = max(1.0, corpus_bytes / BASE_BYTES) ** 0.5
    return int(DICT_BYTES * growth), BITS + int(np.ceil(np.log2(growth)))


def _grams(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, position) of all grams within rows."""
    buf, bounds = raw[off[0] : off[-1]], off - off[0]
    at = np.arange(max(0, len(buf) - GRAM + 1))
    bucket = (span_hash(prefix_hash(buf), at, at + GRAM) >> np.uint64(64 - bits)).astype(np.int64)
    row = np.searchsorted(bounds, at, side="right") - 1
    ok = at + GRAM <= bounds[row + 1]
    return bucket[ok], row[ok], at[ok]


def _count(bits: int):
    """(bucket, total, domain): gram counts of each task, summed before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            raw, off = byte_views(batch.column(0))
            inside = np.asarray(batch.column(1))
            for a, b in row_chunks(off):
                bucket, row, _ = _grams(raw, off[a : b + 1], bits)
                for kind, some in enumerate((bucket, bucket[inside[a + row] > 0])):
                    if 16 * len(some) < 1 << bits:
                        np.add.at(total[kind], some, 1)
                    else:
                        total[kind] += np.bincount(some, minlength=1 << bits)
        at = np.flatnonzero(total[0])
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], ["bucket", "total", "domain"])

    return run


class _Best:
    """The ``keep`` segments of greatest gain, ties in the order of their bytes; equal ones count once."""

    def __init__(self, keep: int):
        self.keep, self.floor, self.held = keep, 0.0, {}

    def offer(self, gain: np.ndarray, cut) -> None:
        """Gains of segments and a function that gives the bytes of one."""
        for i in np.flatnonzero((gain > 0) & (gain >= self.floor)).tolist():
            self.held[cut(i)] = gain.item(i)
        if len(self.held) > 2 * self.keep:
            self.trim()

    def trim(self) -> None:
        self.held = dict(sorted(self.held.items(), key=lambda x: (-x[1], x[0]))[: self.keep])
        if len(self.held) == self.keep:
            self.floor = min(self.held.values())


def _offer(counts, bits: int, keep: int):
    """(kind, gain, segment): a task's best segments for the general (0) and in-domain (1) dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.append(w, 0.0) for w in counts()]  # the last bucket stands for no gram
        best = [_Best(keep), _Best(keep)]
        for batch in batches:
            raw, off = byte_views(batch.column(0))
            inside = np.asarray(batch.column(1))
            for a, b in row_chunks(off):
                buf, bounds = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                bucket, row, at = _grams(raw, off[a : b + 1], bits)
                if not len(at):
                    continue
                # a segment is a stretch of a fixed grid within its document; its gain the sum over distinct grams
                part, column = np.divmod(at - bounds[row], SEGMENT)
                fresh = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(part) != 0)])
                grams = np.full((int(fresh.sum()), SEGMENT), 1 << bits, np.int32)
                grams[np.cumsum(fresh) - 1, column] = bucket
                grams.sort(axis=1)
                again = grams[:, 1:] == grams[:, :-1]
                begin, owner = at[fresh], row[fresh]
                end = np.minimum(begin + SEGMENT, bounds[owner + 1])
                for kind, some in enumerate((slice(None), np.flatnonzero(inside[a + owner] > 0))):
                    worth = both[kind][grams[some]]
                    worth[:, 1:][again[some]] = 0
                    s, e = begin[some], end[some]
                    best[kind].offer(worth.sum(axis=1), lambda i, buf=buf, s=s, e=e: buf[s[i] : e[i]].tobytes())
        for kind in (0, 1):
            best[kind].trim()
            rows = list(best[kind].held.items())
            for a in range(0, len(rows), 1 << 14):
                text, gain = zip(*rows[a : a + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(text), pa.int32()), pa.array(gain, pa.float64()), pa.array(text, pa.binary())], ["kind", "gain", "segment"])

    return run


def _assemble(segments: list[bytes], counts: np.ndarray, size: int, bits: int) -> bytes:
    """A raw-content dictionary: segments in order of gain, each counted only for grams not covered yet; the best last."""
    out, used, left = [], 0, np.array(counts, float)
    for text in segments:
        if used >= size:
            break
        buf = np.frombuffer(text, np.uint8)
        if len(buf) < GRAM:
            continue
        bucket = np.unique(_grams(buf, np.array([0, len(buf)]), bits)[0])
        if left[bucket].sum() <= 0.5 * counts[bucket].sum():
            continue
        left[bucket] = 0
        out.append(text)
        used += len(text)
    return b"".join(reversed(out))


def dictionaries(docs: DataFrame, domain: Column, size: int | None = None) -> tuple[bytes, bytes]:
    """(general, in-domain) dictionaries of the corpus; ``domain`` marks the documents of the domain.

    ``size`` is that of a dictionary; without it, it follows the corpus.
    """
    rows = docs.select("text", F.coalesce(domain, F.lit(False)).cast("int").alias("inside"))
    grown, bits = sizes(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    size = size or grown
    t = rows.mapInArrow(released(_count(bits)), "bucket long, total long, domain long").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("domain").alias("domain")).toArrow()  # at most 2**bits rows
    counts = np.zeros((2, 1 << bits))
    at = np.asarray(t.column("bucket"))
    counts[0, at], counts[1, at] = np.asarray(t.column("total")), np.asarray(t.column("domain"))
    # a gram of the domain counts by how much more often it occurs there than expected
    share_ = counts[1].sum() / max(1.0, counts[0].sum())
    weight = np.stack([np.log1p(counts[0]), np.maximum(np.log1p(counts[1]) - np.log1p(counts[0] * share_), 0) * np.log1p(counts[1])])
    sent = share(docs.sparkSession, weight.astype(np.float32))
    # of the segments in order of gain about every fourth adds what those before it don't have
    keep = 4 * size // SEGMENT
    best = checkpoint(rows.mapInArrow(released(_offer(sent, bits, keep)), "kind int, gain double, segment binary"))  # the texts are read once
    out = []
    for kind in (0, 1):
        got = best.filter(F.col("kind") == kind).groupBy("segment").agg(F.max("gain").alias("gain")).orderBy(F.desc("gain"), "segment").limit(keep).select("segment").toArrow()
        out.append(_assemble(got.column(0).to_pylist(), weight[kind], size, bits))
    return out[0], out[1]


def score(docs: DataFrame, general: bytes, inside: bytes, level: int = LEVEL) -> DataFrame:
    """(doc_id, n_bytes, bits_general, bits_domain, score) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tools = []
        for content in (general, inside):
            if len(content) >= 8:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                if len(content) > 1 << 20:  # the level's own window wouldn't reach all of it
                    d.precompute_compress(compression_params=zstandard.ZstdCompressionParameters.from_level(level, window_log=min(27, len(content).bit_length() + 1)))
                else:
                    d.precompute_compress(level=level)
                tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            else:
                tools.append(zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False))
        for batch in batches:
            size, bits = [], ([], [])
            for value in batch.column(1):
                data = (value.as_py() or "").encode()
                size.append(len(data))
                for out, tool in zip(bits, tools, strict=True):
                    out.append(8 * len(tool.compress(data)) if data else 0)
            g, d = np.array(bits[0], np.int64), np.array(bits[1], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(g), pa.array(d), pa.array((g - d) / np.maximum(g, 1))], ["doc_id", "n_bytes", "bits_general", "bits_domain", "score"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_bytes long, bits_general long, bits_domain long, score double")


def evaluate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with the documents labelled as good quality for the domain and all documents as general."""
    good = labels.filter("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    if good.count() <= MAX_BROADCAST_IDS:  # else the texts are shuffled
        good = F.broadcast(good)
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left")
    general, inside = dictionaries(marked, F.col("good"))
    return score(docs, general, inside)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
