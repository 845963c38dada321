"""Inverted index: postings, term and corpus statistics, cross references, persistence."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.sources.shared import checkpoint


def counted(entries: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """(entry_id, term, n): the tokens of each row with their numbers; ``only``: these alone, all others as the empty term."""
    count, asked = X.token_counter(), None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            ids = pa.array(keys, pa.int64()).take(pa.array(rows, pa.int32()))
            return pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(ns, pa.int64())], names=["entry_id", "term", "n"])

        for batch in batches:
            keys, rows, terms, ns = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = count(text)
                if asked is not None:
                    own = {t: n for t, n in found.items() if t in asked}
                    rest = sum(found.values()) - sum(own.values())
                    found = own | ({"": rest} if rest else {})
                rows += [len(keys)] * len(found)
                keys.append(key)
                terms += found
                ns += found.values()
                if len(terms) > 200_000:
                    yield out()
                    keys, rows, terms, ns = [], [], [], []
            if terms:
                yield out()

    texts = entries.filter("entry_id is not null and body is not null").select(F.col("entry_id").cast("long"), F.col("body").cast("binary"))
    return texts.mapInArrow(run, "entry_id long, term string, n long")


def postings(entries: DataFrame) -> DataFrame:
    """(entry_id, term, tf), tf at most 65535; an entry's rows stand in one part, so that lengths and scores move nothing more."""
    rows = counted(entries).repartition("entry_id")
    return rows.groupBy("entry_id", "term").agg(F.least(F.sum("n"), F.lit(65535)).cast("int").alias("tf"))


def lengths(posts: DataFrame) -> DataFrame:
    """(entry_id, dl): tokens of each entry that has any."""
    return posts.groupBy("entry_id").agg(F.sum("tf").alias("dl"))


def corpus_stats(entries: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: n, total, avgdl (cut to hundredths, 100 for an empty corpus)."""
    n = entries.agg(F.count("*").alias("n"))
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    avg = F.when(F.col("n") == 0, F.lit(100.0)).otherwise(F.floor(F.col("total") / F.greatest(F.col("n"), F.lit(1)) * 100.0) / 100.0)
    return n.crossJoin(total).withColumn("avgdl", avg)  # one row by one row


def idf(df, n):
    """Inverse document frequency, cut to thousandths."""
    return F.floor(F.log((n - df + 0.5) / (df + 0.5) + 1.0) * 1000.0) / 1000.0


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    d = posts.groupBy("term").agg(F.count("*").alias("df"))
    return d.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("df").cast("double"), F.col("n").cast("double")).alias("idf"))


#: Words of topics' names that may be broadcast.
MAX_BROADCAST_NAMES = 1_000_000


def small(df: DataFrame, bound: int = MAX_BROADCAST_NAMES) -> DataFrame:
    """Broadcast hint for a table that is counted to be small; larger ones are left to be shuffled."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def xref_edges(entries: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """(src, dst, mentions): entries of src that hold every token of another topic's name.

    Names are few beside postings: where a count says so they are broadcast, and only postings of
    their words are moved, as one set an entry. Without stored postings the texts are read, for those
    words alone. A name meets only the sets with its rarest word, so common ones form no pairs.
    """
    topics = entries.select("topic").distinct()
    names = topics.select(F.col("topic").alias("dst"), F.array_distinct(X.tokens("topic")).alias("words"))
    names = checkpoint(names.filter(F.size("words") > 0))
    words = names.select(F.explode("words").alias("term")).distinct()
    few = [r.term for r in words.limit(MAX_BROADCAST_NAMES + 1).collect()] if posts is None else None
    if posts is None:
        posts = counted(entries, few).filter("term <> ''") if len(few) <= MAX_BROADCAST_NAMES else counted(entries).join(words, "term", "left_semi")
    else:
        posts = posts.join(small(words), "term", "left_semi")
    held = checkpoint(posts.groupBy("entry_id").agg(F.collect_set("term").alias("held")))
    # a name is looked for in the entries that hold its rarest word
    df = held.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    at = names.select("dst", "words", F.explode("words").alias("term")).join(df, "term", "left")
    rarest = at.groupBy("dst").agg(F.first("words").alias("words"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).filter("r.df > 0")
    keys = checkpoint(rarest.select(F.col("r.term").alias("term"), "dst", F.array_except("words", F.array("r.term")).alias("others")))
    found = held.select("entry_id", "held", F.explode("held").alias("term")).join(small(keys), "term").filter(F.forall("others", lambda t: F.array_contains("held", t))).select("entry_id", "dst")
    return found.join(entries.select("entry_id", F.col("topic").alias("src")), "entry_id").filter("src <> dst").groupBy("src", "dst").agg(F.least(F.count("*"), F.lit(65535)).alias("mentions"))


#: Bytes of text whose postings are sorted by one task.
BUCKET_BYTES = 8 << 20


def save(entries: DataFrame, into: str, buckets: int | None = None) -> None:
    """Write the index as Parquet tables, postings clustered by term so that a query reads few row groups.

    Buckets are as many as the texts ask for, 64 at least, so that none grows with the corpus.
    """
    if buckets is None:
        buckets = max(64, (entries.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // BUCKET_BYTES)
    p = postings(entries)
    p.repartitionByRange(buckets, "term").sortWithinPartitions("term", "entry_id").write.mode("overwrite").parquet(f"{into}/postings")
    p = entries.sparkSession.read.parquet(f"{into}/postings")
    stats = corpus_stats(entries, p)
    stats.write.mode("overwrite").parquet(f"{into}/index_stats")
    term_stats(p, stats).write.mode("overwrite").parquet(f"{into}/term_stats")
    entries.drop("body").join(lengths(p), "entry_id", "left").write.mode("overwrite").parquet(f"{into}/entry_meta")
    entries.groupBy("topic").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{into}/topics")
    xref_edges(entries, p).write.mode("overwrite").parquet(f"{into}/xrefs")


def load(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{where}/{t}") for t in ("postings", "index_stats", "term_stats", "entry_meta", "topics", "xrefs")}
