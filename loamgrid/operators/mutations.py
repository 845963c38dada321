"""Writes as rows to append: every edit is new entries plus tombstones, decided by one plan.

Functions return (kind, topic, body, ts_min, target) rows for the log. ``entries`` are live entries
(entry_id, topic, body, ts_min); a target is an entry_id (the offset in the log).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import similarity
from loamgrid.sources.shared import checkpoint

_COLS = ("kind", "topic", "body", "ts_min", "target")


def _new(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("entry").alias("kind"), "topic", "body", "ts_min", F.lit(None).cast("long").alias("target"))


def _gone(rows: DataFrame) -> DataFrame:
    none = F.lit(None)
    return rows.select(F.lit("delete").alias("kind"), none.cast("string").alias("topic"), none.cast("string").alias("body"), none.cast("int").alias("ts_min"), F.col("entry_id").cast("long").alias("target"))


def store(new: DataFrame, auto: bool = True) -> DataFrame:
    """Entries of (topic, text, tags, source, confidence, links, ts_min); tags are found if none are given."""
    tags = X.normalize_tags("tags")
    tags = F.coalesce(F.nullif(tags, F.lit("")), X.auto_tags("text")) if auto else F.nullif(tags, F.lit(""))
    return _new(new.withColumn("body", X.build_body(F.col("text"), tags, F.col("source"), F.col("confidence"), F.col("links"))))


def duplicates(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Stored entries that new texts (new_id, topic, body) repeat: a warning, they are stored all the same."""
    return similarity.store_check(entries, new)


def batch(new: DataFrame) -> DataFrame:
    """Entries of a batch (entry_id in order, topic, body, ts_min) without those that resemble an earlier one."""
    skip = similarity.batch_dedup(new).filter("not kept").select("entry_id")
    return _new(new.join(skip, "entry_id", "left_anti"))


def pick(entries: DataFrame, topic: str, index: int | None = None, match: str | None = None, tag: str | None = None, every: bool = False) -> DataFrame:
    """The entry of a topic that an edit means: by index, by text, by tag, or the last; or all of these."""
    e = entries.filter(F.col("topic") == topic)
    if match is not None:
        e = e.filter(F.contains(F.lower("body"), F.lit(match.lower())))
    if tag is not None:
        e = e.filter(F.array_contains(X.metadata("body")["tags"], tag))
    if index is not None:
        e = e.withColumn("_i", F.row_number().over(Window.partitionBy("topic").orderBy("entry_id")) - 1).filter(F.col("_i") == index).drop("_i")
    if every or index is not None:
        return e
    first = match is not None
    return e.orderBy(F.col("entry_id") if first else F.desc("entry_id")).limit(1)


def _replace(chosen: DataFrame, body: Column) -> DataFrame:
    return _new(chosen.withColumn("body", body)).unionByName(_gone(chosen))


def append(chosen: DataFrame, text: str) -> DataFrame:
    """The entry with more text; it keeps its time."""
    return _replace(chosen, F.concat("body", F.lit("\n" + text)))


def revise(chosen: DataFrame, text: str, date: str) -> DataFrame:
    """A new body with the date of its change; the old one's metadata lines go with it."""
    return _replace(chosen, F.lit(f"[modified: {date}]\n{text}"))


def delete(chosen: DataFrame) -> DataFrame:
    return _gone(chosen)


def retag(chosen: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    """The entry with tags added and removed; without tags the line goes."""
    from loamgrid.operators.topics import edit_tags

    tags = edit_tags(X.metadata("body")["tags"], add, remove)
    rest = F.array_join(F.filter(X.lines("body"), lambda s: ~s.startswith("[tags:")), "\n")
    return _replace(chosen, F.when(F.size(tags) == 0, rest).otherwise(F.concat(F.lit("[tags: "), F.array_join(tags, ", "), F.lit("]\n"), rest)))


def rename(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Move a topic's entries under another name, sanitised; merging is the same with a name in use."""
    e = entries.filter(F.col("topic") == old)
    return _new(e.withColumn("topic", X.sanitize_topic(F.lit(new)))).unionByName(_gone(e))


def apply(entries: DataFrame, edits: DataFrame, next_id: int) -> DataFrame:
    """Live entries after edits; new ones are numbered from ``next_id`` on, in order of topic, time and body."""
    gone = edits.filter("kind = 'delete'").select(F.col("target").alias("entry_id"))
    new = numbered(edits.filter("kind = 'entry'").select("topic", "body", "ts_min"), ["topic", "ts_min", "body"], next_id)
    return entries.join(gone, "entry_id", "left_anti").select("entry_id", "topic", "body", "ts_min").unionByName(new.select("entry_id", "topic", "body", "ts_min"))


def numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Rows with ``entry_id`` from ``start`` on in the given order; each task numbers its range, after those before it."""
    ranges = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per task
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.join(F.broadcast(before), "_part").withColumn("entry_id", (F.col("_before") + at + F.lit(start - 1)).cast("long")).drop("_part", "_n", "_before")
