"""Small mutable documents and sinks: task checkpoints, insight blocks, model files' directories."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHECKPOINT = "task string, done array<string>, next array<string>, hypotheses array<string>, blocked string, files array<string>, timestamp long"


def save_checkpoint(spark: SparkSession, where: str, task: str, timestamp: int, done: str = "", next_: str = "", hypotheses: str = "", blocked: str = "", files: str = "") -> None:
    """Replace the task's state; lists are semicolon-separated, files comma-separated."""

    def parts(text: str, sep: str) -> list[str]:
        return [p.strip() for p in text.split(sep) if p.strip()]

    row = (task, parts(done, ";"), parts(next_, ";"), parts(hypotheses, ";"), blocked, parts(files, ","), timestamp)
    spark.createDataFrame([row], CHECKPOINT).write.mode("overwrite").parquet(where)


def load_checkpoint(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(CHECKPOINT).parquet(where)


def insight_blocks(answers: DataFrame, mode: str, ts: int) -> DataFrame:
    """(value): one ``--- mode [ts=..] ---`` block per answer, for a text sink."""
    return answers.select(F.concat(F.lit(f"--- {mode} [ts={ts}] ---\n"), F.col("answer"), F.lit("\n")).alias("value"))


def insight_sink(where: str, mode: str):
    """For ``foreachBatch``: appends each batch's answers as blocks, named by batch so a retry replaces it."""

    def write(batch: DataFrame, epoch: int) -> None:
        insight_blocks(batch, mode, epoch).write.mode("overwrite").text(f"{where}/batch={epoch}")

    return write


_FORMATS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}


def parse_gguf(f) -> Iterator[tuple]:
    """(section, name, type, value, shape, offset) of the metadata and tensor directory of an open file."""

    def take(fmt: str):
        return struct.unpack(fmt, f.read(struct.calcsize(fmt)))[0]

    def text() -> str:
        return f.read(take("<Q")).decode("utf-8", "replace")

    def value(kind: int):
        if kind == 8:
            return text()
        if kind == 9:
            inner, n = take("<I"), take("<Q")
            return [value(inner) for _ in range(n)]
        return take(_FORMATS[kind])

    if f.read(4) != b"GGUF" or take("<I") not in (2, 3):
        raise ValueError("no model file of version 2 or 3")
    n_tensors, n_meta = take("<Q"), take("<Q")
    for _ in range(n_meta):
        key, kind = text(), take("<I")
        yield "metadata", key, str(kind), str(value(kind)), None, None
    for _ in range(n_tensors):
        name = text()
        shape = [take("<Q") for _ in range(take("<I"))]
        yield "tensor", name, str(take("<I")), None, shape, take("<Q")


class _ModelReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for row in parse_gguf(f):
                yield (partition.value, *row)


class ModelFile(DataSource):
    """``format("gguf")``: the directory of model files (option path; shards comma-separated), a task per file."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return "file string, section string, name string, type string, value string, shape array<long>, offset long"

    def reader(self, schema) -> DataSourceReader:
        return _ModelReader(self.options["path"])


def by_type(directory: DataFrame) -> DataFrame:
    """(type, tensors, elements) of a model's directory."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return directory.filter("section = 'tensor'").groupBy("type").agg(F.count("*").alias("tensors"), F.sum(size).alias("elements"))


def nucleus(logits: DataFrame, p: float = 0.9, most: int = 256) -> DataFrame:
    """(id, token, prob): the likeliest tokens of each row (id, logits) whose probabilities reach p, at most ``most``."""
    from pyspark.sql import Window

    e = logits.select("id", F.posexplode("logits").alias("token", "logit"))
    w = Window.partitionBy("id").orderBy(F.desc("logit"), "token")
    top = e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    every = Window.partitionBy("id")
    z = F.exp(F.col("logit") - F.max("logit").over(every))
    prob = top.withColumn("z", z).withColumn("prob", F.col("z") / F.sum("z").over(every))
    before = F.coalesce(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return prob.withColumn("before", before).filter(F.col("before") < p).select("id", "token", "prob")
