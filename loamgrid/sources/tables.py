"""The knowledge model derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Day of every relative date; never the wall clock.
AS_OF = 19753
EPOCH_MIN = 28401120


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer parts than the session has cores, as one small file has.

    A table with as many parts as cores is left as it is, so no large table is shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, topic, body, ts_min, source, confidence, tags) of every document."""
    docs, labels = spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    tags = F.array_compact(F.array(F.col("lang"), F.when(F.col("quality") == 1, "gotcha"), F.when(F.col("toxic") == 1, "constraint")))
    return d.select(
        F.col("doc_id").alias("entry_id"),
        F.concat("lang", F.lit("/"), "source").alias("topic"),
        F.col("text").alias("body"),
        (F.lit(EPOCH_MIN) + (F.col("doc_id") * 37) % 43200).cast("int").alias("ts_min"),
        F.concat(F.lit("src/"), "source", F.lit(".rs:"), (F.col("doc_id") % 97).cast("string")).alias("source"),
        F.when(F.col("toxic") == 1, 0.3).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("confidence"),
        tags.alias("tags"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
    )


def day(ts_min: Column) -> Column:
    """Day since the epoch of minutes since the epoch."""
    return F.floor(ts_min / 1440).cast("int")


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, text): Rust-like source lines made of the parts, 50 files."""
    p, k = spread(read(spark, sf_dir, "part")), F.col("p_partkey")
    kind, name = F.col("p_size") % 8, lambda n: F.concat(F.lit("work_"), n.cast("string"))
    text = (
        F.when(kind == 0, F.concat(F.lit("pub fn "), name(k % 200), F.lit("(x: u32) -> u32 {")))
        .when(kind == 1, F.concat(F.lit("    let y = "), name(k * 7 % 200), F.lit("(1);")))
        .when(kind == 2, F.concat(F.lit("use lib"), (k % 9).cast("string"), F.lit("::Value;")))
        .when(kind == 3, F.concat(F.lit("// calls "), name(k % 200)))
        .when(kind == 4, F.concat(F.lit("    unsafe { mmap("), name(k % 100), F.lit(") }")))
        .when(kind == 5, F.concat(F.lit("struct Kind"), (k % 40).cast("string"), F.lit(" {")))
        .when(kind == 6, F.concat(F.lit("    static L: Mutex<Kind"), (k % 40).cast("string"), F.lit("> = new();")))
        .otherwise(F.lit("}"))
    )
    return p.select(F.concat(F.lit("src/mod"), (k % 50).cast("string"), F.lit(".rs")).alias("path"), F.floor(k / 50).cast("int").alias("line"), text.alias("text"))


def build_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, command, output) of commands and what they said."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    command = F.when(k % 3 == 0, "cargo build --release").when(k % 3 == 1, "xcodebuild -scheme app build").otherwise("ls build")
    n = (k % 7).cast("string")
    output = (
        F.when(k % 5 == 0, F.concat(F.lit("ok\n a.rs:"), n, F.lit(": error: bad type \n a.rs:"), n, F.lit(": error: bad type\nerror[E"), n, F.lit("]: lifetime")))
        .when(k % 5 == 1, F.lit("Compiling\n** BUILD FAILED **\naborting due to errors"))
        .when(k % 5 == 2, F.concat(F.lit("decode took 12."), n, F.lit("ms\nFinished in 3.5s\nspeed 88 tok/s")))
        .otherwise("fine")
    )
    return e.select(k.alias("id"), command.alias("command"), output.alias("output"))


def file_mtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, mtime): last event per pseudo source file."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("src/src"), (F.col("user_id") % 20).cast("string"), F.lit(".rs")).alias("path")).agg(F.max("ts").alias("mtime"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, key, tool, ok): editor calls; ok is the outcome of builds only."""
    e = read(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type").isin("purchase", "error"), "Bash").when(F.col("event_type") == "signup", "store").otherwise("Other")
    ok = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return e.select("event_id", "ts", F.col("user_id").alias("key"), tool.alias("tool"), ok.alias("ok"))
