"""Topic analytics: lists, roll-ups, recency, tags, staleness, focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.sources.tables import AS_OF, day


def topic_list(entries: DataFrame) -> DataFrame:
    return entries.groupBy("topic").agg(F.count("*").alias("n"), F.max("ts_min").alias("last"))


def rollup(entries: DataFrame) -> DataFrame:
    """(prefix, n, last, topics): every proper prefix of the topics, counted from one row per topic."""
    t = topic_list(entries).withColumn("parts", F.split("topic", "/")).filter(F.size("parts") > 1)
    p = t.select("n", "last", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    return p.select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("prefix"), "n", "last").groupBy("prefix").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.count("*").alias("topics"))


def recency(entries: DataFrame) -> DataFrame:
    return entries.groupBy("topic").agg(F.max(day(F.col("ts_min"))).alias("last_day"))


def stale_topics(entries: DataFrame, days: int, as_of: int = AS_OF) -> DataFrame:
    return recency(entries).select("topic", (F.lit(as_of) - F.col("last_day")).alias("age")).filter(F.col("age") > days)


def recent(entries: DataFrame, days: int = 7, hours: int | None = None, as_of: int = AS_OF) -> DataFrame:
    """Entries since the cutoff; hours count as whole days, one at least."""
    first = as_of - (max(hours // 24, 1) if hours is not None else days)
    return entries.filter(day(F.col("ts_min")) >= first)


def tag_freq(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(entries: DataFrame, k: int = 32) -> DataFrame:
    return tag_freq(entries).orderBy(F.desc("n"), "tag").limit(k)


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("entries"), F.min("ts_min").alias("first"), F.max("ts_min").alias("last"))


def entry_index(entries: DataFrame) -> DataFrame:
    """Position of each entry in its topic, from 0 in log order."""
    return entries.withColumn("idx", F.row_number().over(Window.partitionBy("topic").orderBy("entry_id")) - 1)


def matching(entries: DataFrame, text: str) -> DataFrame:
    return entries.filter(F.contains(F.lower("body"), F.lit(text.lower())))


def stale_sources(entries: DataFrame, mtimes: DataFrame) -> DataFrame:
    """Entries whose source file changed after they were written."""
    e = entries.withColumn("path", F.regexp_extract("source", "^([^:]*)", 1)).withColumn("ts", F.timestamp_seconds(F.col("ts_min").cast("long") * 60))
    return e.join(mtimes, "path").filter(F.col("mtime") > F.col("ts"))


def by_source(entries: DataFrame, filename: str) -> DataFrame:
    return entries.filter(F.contains("source", F.lit(filename)))


def newest(entries: DataFrame, k: int = 15) -> DataFrame:
    return recency(entries).orderBy(F.desc("last_day"), "topic").limit(k)


def rename(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Topics by a rename map (topic, renamed); others stay."""
    return entries.join(names, "topic", "left").withColumn("topic", F.coalesce("renamed", "topic")).drop("renamed")


def edit_tags(tags: Column, add: list[str], remove: list[str]) -> Column:
    a, r = (F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>") for xs in (add, remove))
    return F.array_sort(F.array_except(F.array_union(tags, a), r))


def focus(injected: DataFrame, entries: DataFrame, least: int = 3) -> DataFrame:
    """(session, topic, n): topics with ``least`` injected entries or more, of (session, entry_id)."""
    return injected.distinct().join(entries.select("entry_id", "topic"), "entry_id").groupBy("session", "topic").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def first_layer(layers: DataFrame, limits: dict[int, int]) -> DataFrame:
    """(session, entry_id, layer) once each: the first layer that has the entry, up to the layer's limit, best first."""
    once = F.row_number().over(Window.partitionBy("session", "entry_id").orderBy("layer", F.desc("score")))
    rank = F.row_number().over(Window.partitionBy("session", "layer").orderBy(F.desc("score"), "entry_id"))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return layers.withColumn("_o", once).filter("_o = 1").drop("_o").withColumn("rank", rank).filter(F.col("rank") <= most[F.col("layer")])


def removed_symbols(old: Column, new: Column, stem: Column) -> Column:
    """Up to three tokens of four bytes or more that an edit took out, except the file's stem."""
    def words(c: Column) -> Column:
        return F.filter(X.tokens(c), lambda t: F.octet_length(t) >= 4)

    gone = F.array_except(words(old), F.concat(words(new), F.array(F.lower(stem))))
    return F.when(F.octet_length(old) >= 8, F.slice(F.array_sort(gone), 1, 3)).otherwise(F.array().cast("array<string>"))


def budgeted(rows: DataFrame, cost: Column, budget: int, by: list, order: list) -> DataFrame:
    """Rows in order while what came before them costs less than the budget; the one that crosses stays."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).filter(F.col("spent") < budget)


def drift_sample(entries: DataFrame) -> DataFrame:
    """(topic, n, sample): entries per topic and the first body's content, 200 bytes."""
    g = entries.groupBy("topic").agg(F.count("*").alias("n"), F.min_by("body", "entry_id").alias("body"))
    return g.select("topic", "n", X.truncate_bytes(X.first_content("body"), 200).alias("sample"))


def stale_candidates(entries: DataFrame, topics: int = 5) -> DataFrame:
    """Entries of the largest topics, oldest first within each."""
    big = topic_list(entries).orderBy(F.desc("n"), "topic").limit(topics).select("topic")
    kept = entries.join(F.broadcast(big), "topic", "left_semi")  # a handful of topics
    return kept.withColumn("age_rank", F.row_number().over(Window.partitionBy("topic").orderBy("ts_min", "entry_id")))
