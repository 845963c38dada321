"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut in two halves of 32. Of two fingerprints that differ in at most
3 bits, one half differs in at most 1 (pigeonhole). A half is read as a 23-bit word and 9 more
bits; the single error lies in either:

* in the word: the perfect binary Golay code [23, 12, 7] puts every word within 3 bits of just
  one codeword. A word within 1 bit of x decodes to the codeword of x or of a neighbour of x: one
  to six codeword indices. One side brings the index its word decodes to, the other side all
  indices of its neighbourhood, and the 9 bits are equal;
* in the 9 bits: the words are equal and are the key.

Joining the keys finds every pair; each is verified by its bit difference. Equal fingerprints are
collapsed first, so copies are never expanded into pairs, and links are counted by class.

Edge cases: null and empty texts have no words and fingerprint zero, which links like any other; a
bit that is set in just half the hashes (a tie) is 0; ids may repeat (each row counts as a
document) or be null (smaller ids come first, so component_id is null only if all of the component's
are); texts of any length are read whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm._core import checkpoint, components, released, table, worker_state

MAX_BITS = 3
_SPLIT = bytes(32 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as an unsigned number."""
    import xxhash

    words = (text or "").encode().translate(_SPLIT).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(words, words[1:], words[2:], strict=False)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(h))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for r, value in enumerate(batch.column(1)):
            t = value.as_py()
            if not t:
                continue
            # bytes of a separator are below 0x21, so splitting at them and dropping empties is exact
            words = list(filter(None, t.encode().translate(_SPLIT).split(b" ")))
            n = len(words)
            if not n:
                continue
            if n < 3:
                h = np.array([digest(b" ".join(words), 42)], np.uint64)
            else:
                h = np.fromiter((digest(b"%b %b %b" % s, 42) for s in zip(words, words[1:], words[2:], strict=False)), np.uint64, n - 2)
            counts = np.zeros(64, np.int64)
            for a in range(0, len(h), 1 << 14):
                counts += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[r] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome the error pattern of weight up to 3, and the syndrome of each bit."""
    state = worker_state("golay")
    if not hasattr(state, "tables"):
        state.tables = _tables()
    return state.tables


def _tables() -> tuple[np.ndarray, np.ndarray]:
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= generator << (i - 11)
        return v
    unit = np.array([remainder(1 << i) for i in range(23)], np.int64)
    error = np.full(2048, -1, np.int64)
    error[0] = 0
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return error, unit


def decode(word: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within 3 bits of each 23-bit word."""
    error, unit = _decoder()
    syndrome = np.zeros(word.shape, np.int64)
    for i in range(23):
        syndrome ^= np.where(word >> i & 1, unit[i], 0)
    return (word ^ error[syndrome]) >> 11


def keys(fp: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key): the fuzzy keys; ``wide`` gives all indices around, else the own one."""
    at, out = [], []
    fp = fp.view(np.uint64)
    for half in range(2):
        x = (fp >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        word, rest = x & (1 << 23) - 1, x >> 23
        tag = half << 40
        at.append(np.arange(len(fp)))
        out.append(word | tag | 1 << 39)
        own = decode(word)
        cols = [own, *(decode(word ^ (1 << i)) for i in range(23))] if wide else [own]
        grid = np.sort(np.stack(cols, axis=1), axis=1)
        fresh = np.ones(grid.shape, bool)
        fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
        row, col = np.nonzero(fresh)
        at.append(row)
        out.append(grid[row, col] << 9 | rest[row] | tag)
    return np.concatenate(at), np.concatenate(out)


def _keyed(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for a in range(0, len(fp), 8192):
                part = np.ascontiguousarray(fp[a : a + 8192])
                at, key = keys(part, wide)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], ["key", "fp"])

    return run


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, fp): SimHash of each whole text as a signed long; long columns to ``keep`` follow."""
    return docs.select("doc_id", "text", *keep).mapInArrow(released(_prints), ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of distinct fingerprints that differ in 1 to ``max_bits`` (3 at most) bits, both ways round once."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find pairs of at most 3 differing bits")
    narrow = prints.select("fp").mapInArrow(released(_keyed(False)), "key long, fp long").withColumnRenamed("fp", "a")
    wide = prints.select("fp").mapInArrow(released(_keyed(True)), "key long, fp long").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return narrow.join(wide, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, n_near, component_id), one row per row of ``docs``."""
    rows, per = _components(fingerprints(docs), max_bits)
    return rows.join(per, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def survivors(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One whole row of each group of near-duplicates: that of the smallest id, nulls last, ties by the row itself.

    Groups are told apart by their fingerprints, so ids may repeat or be null.
    """
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    # a text by its id and hash: whole texts are sent once, when the rows are known
    rows, per = _components(fingerprints(docs, "text_key"), max_bits)
    best = rows.join(per, "fp").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("some_id"), "text_key")).alias("best")).select("best.*")
    named = docs.withColumns({"no_id": F.col("doc_id").isNull(), "some_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    # join and aggregate go by the same columns, so texts are sent once
    kept = named.join(best, ["no_id", "some_id", "text_key"], "left_semi").groupBy("no_id", "some_id", "text_key").agg(F.min(F.struct(*[c for c in docs.columns if c != "text_key"])).alias("row"))
    return kept.select("row.*")


def _components(prints: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``prints``, and (fp, n_near, component_id, component) of each fingerprint."""
    rows = checkpoint(prints)  # hashing whole texts is the costly part; it is done once
    classes = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    pairs = checkpoint(links(classes, max_bits))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    part = components(pairs).withColumnRenamed("node", "fp")
    full = classes.join(degree, "fp", "left").join(part, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    root = full.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows, full.join(root, "component").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
