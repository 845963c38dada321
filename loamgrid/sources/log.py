"""The append-only binary log as a Spark data source, batch and streaming, with a writer.

Layout: 4 bytes magic, version (u32, little endian), then records. An entry is type 1, topic length
(u8), body length (u32), minutes (i32), 2 bytes of padding, topic, body; a tombstone is type 2,
3 bytes reserved, the offset of its target (u32). A torn or unknown record ends the scan.
Rows: kind, log_offset, topic, body, ts_min, target. Files are read one per task, so a corpus is
kept as many segment files; within one, the framing allows no split.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

MAGIC, VERSION = b"LGKB", 1
SCHEMA = "file string, kind string, log_offset long, topic string, body string, ts_min int, target long"
_ENTRY, _TOMB = "<BIi2x", "<3xI"
_ENTRY_SIZE, _TOMB_SIZE = struct.calcsize(_ENTRY), struct.calcsize(_TOMB)


def header() -> bytes:
    return MAGIC + struct.pack("<I", VERSION)


def pack_entry(topic: str, body: str, ts_min: int) -> bytes:
    t, b = topic.encode(), body.encode()
    if len(t) > 255:
        raise ValueError("a topic has at most 255 bytes")
    return b"\x01" + struct.pack(_ENTRY, len(t), len(b), ts_min) + t + b


def pack_delete(target: int) -> bytes:
    return b"\x02" + struct.pack(_TOMB, target)


def parse(data: bytes, start: int = 8) -> Iterator[tuple]:
    """(kind, offset, topic, body, minutes, target, end) of the whole records from ``start`` on."""
    at = start
    while at < len(data):
        kind = data[at]
        if kind == 1 and at + 1 + _ENTRY_SIZE <= len(data):
            n_topic, n_body, ts = struct.unpack_from(_ENTRY, data, at + 1)
            body = at + 1 + _ENTRY_SIZE + n_topic
            if body + n_body > len(data):
                return
            yield "entry", at, data[body - n_topic : body].decode("utf-8", "replace"), data[body : body + n_body].decode("utf-8", "replace"), ts, None, body + n_body
            at = body + n_body
        elif kind == 2 and at + 1 + _TOMB_SIZE <= len(data):
            yield "delete", at, None, None, None, struct.unpack_from(_TOMB, data, at + 1)[0], at + 1 + _TOMB_SIZE
            at += 1 + _TOMB_SIZE
        else:
            return


def _files(path: str) -> list[str]:
    return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_"))) if os.path.isdir(path) else [path]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    if data and data[:4] != MAGIC[: len(data[:4])]:
        raise ValueError(f"{path} is no log")
    return data


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            for *row, _ in parse(_content(partition.value)):
                yield (os.path.basename(partition.value), *row)


class _Stream(SimpleDataSourceStreamReader):
    """Tail of the log: an offset is the place read up to in each file."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for f in _files(self.path):
            for *row, stop in parse(_content(f), int(start.get(f, 8))):
                rows.append((os.path.basename(f), *row))
                end[f] = stop
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for f in _files(self.path):
            for *row, stop in parse(_content(f), int(start.get(f, 8))):
                if stop <= int(end.get(f, 8)):
                    yield (os.path.basename(f), *row)

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    """Each task writes a segment under a hidden name; the commit makes them visible."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from uuid import uuid4

        os.makedirs(self.path, exist_ok=True)
        name = f"{uuid4().hex}.log"
        with open(os.path.join(self.path, f".{name}"), "wb") as f:
            f.write(header())
            for r in rows:
                f.write(pack_delete(r["target"]) if r["kind"] == "delete" else pack_entry(r["topic"] or "", r["body"] or "", r["ts_min"] or 0))
            f.flush()
            os.fsync(f.fileno())
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for f in _files(self.path):
                os.remove(f)
        for m in messages:
            os.replace(os.path.join(self.path, f".{m.name}"), os.path.join(self.path, m.name))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(p := os.path.join(self.path, f".{m.name}")):
                os.remove(p)


class KnowledgeLog(DataSource):
    """``format("knowledge_log")``: option path is a log file or a folder of them that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "knowledge_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(KnowledgeLog)


def live(records: DataFrame) -> DataFrame:
    """Entries that no tombstone names, wherever it stands in the file."""
    gone = records.filter("kind = 'delete'").select("file", F.col("target").alias("log_offset"))
    return records.filter("kind = 'entry'").drop("kind", "target").join(gone, ["file", "log_offset"], "left_anti")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the live entries to a new log."""
    live(spark.read.format("knowledge_log").load(path)).selectExpr("file", "'entry' AS kind", "log_offset", "topic", "body", "ts_min", "CAST(NULL AS LONG) AS target").write.format("knowledge_log").mode("append").save(into)


EXPORT = "map<string,array<struct<ts:int,body:string>>>"


def to_json(entries: DataFrame) -> DataFrame:
    """(topic, entries): a JSON array of {ts, body} per topic, oldest first."""
    rows = F.sort_array(F.collect_list(F.struct("ts_min", "entry_id", "body")))
    return entries.groupBy("topic").agg(F.to_json(F.transform(rows, lambda r: F.struct(r["ts_min"].alias("ts"), r["body"].alias("body")))).alias("entries"))


def from_json(text: DataFrame, column: str = "json") -> DataFrame:
    """(topic, ts_min, body) of export objects; empty bodies are skipped, a missing time is 0."""
    e = text.select(F.explode(F.from_json(column, EXPORT)).alias("topic", "rows")).select("topic", F.explode("rows").alias("r"))
    return e.select("topic", F.coalesce("r.ts", F.lit(0)).alias("ts_min"), F.col("r.body").alias("body")).filter(F.coalesce(F.col("body"), F.lit("")) != "")


SKIPPED = ("target", "build", "Pods", "DerivedData", "references", "node_modules")


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, line, text) of the source files below a folder, hidden and generated folders left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{rs,swift,metal,h,c,m}").load(root)
    rel = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.substring(rel, len(root.rstrip("/")) + 2, 1 << 30)
    kept = ~rel.rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED) + ")/") & (F.size(F.split(rel, "/")) <= 13)
    return f.filter(kept).select(rel.alias("path"), F.col("content").cast("string").alias("content")).select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
