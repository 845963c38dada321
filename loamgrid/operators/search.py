"""Ranked search: one plan from queries to hits, for a single query or a batch.

Queries are a table (query_id, term), so a batch is one job. ``scored`` reads a stored index, whose
postings are clustered by term: a few terms are pushed down to the scan, many meet the postings in a
join. ``scan`` needs no index. Tables of the queries' terms are broadcast after one count of the
queries. Filters act on the entries before scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import index as I
from loamgrid.sources.shared import checkpoint
from loamgrid.sources.tables import AS_OF, day

K1, B = 1.2, 0.75
MAX_BROADCAST_TERMS = 1_000_000
#: Terms that are pushed down to the scan of stored postings.
MAX_PUSHED_TERMS = 500
#: Hits that a task holds of a stored index.
HITS_OF_A_TASK = 1_000_000


def query_terms(spark: SparkSession, queries: dict[int, str] | list[str]) -> DataFrame:
    """(query_id, term, n_terms) of queries given as text."""
    items = queries.items() if isinstance(queries, dict) else enumerate(queries)
    q = spark.createDataFrame([(int(i), t) for i, t in items], "query_id long, text string")
    return terms_of(q)


def terms_of(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, term, n_terms) of a table (query_id, text); ``limit`` keeps the first terms of each query."""
    t = X.terms("text")
    t = F.slice(t, 1, limit) if limit else t
    return queries.select("query_id", t.alias("terms")).select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def hint_of(queries: DataFrame, bound: int = MAX_BROADCAST_TERMS) -> Callable[[DataFrame], DataFrame]:
    """What to do with tables of at most a row per row of ``queries``: broadcast them, if these are few."""
    return F.broadcast if queries.limit(bound + 1).count() <= bound else lambda df: df


def filters(entries: DataFrame, topic: str | None = None, tag: str | None = None, source: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Entries of a topic and below, with a tag, with a source path that holds a text, in a range of days."""
    e = entries
    if topic is not None:
        e = e.filter(X.topic_matches("topic", topic))
    if tag is not None:
        e = e.filter(F.array_contains("tags", tag))
    if source is not None:
        e = e.filter(F.contains(F.lower("source"), F.lit(source.lower())))
    if after is not None:
        e = e.filter(day(F.col("ts_min")) >= after)
    if before is not None:
        e = e.filter(day(F.col("ts_min")) <= before)
    return e


def relative_days(days: int | None = None, hours: int | None = None, as_of: int = AS_OF) -> int:
    """First day of a relative range; hours override days and count whole days."""
    return as_of - (hours // 24 if hours is not None else days or 0)


def shortcut(word: str, as_of: int = AS_OF) -> int:
    """First day that today, yesterday, week or month stand for."""
    return as_of - {"today": 0, "yesterday": 1, "week": 7, "month": 30}[word]


def bm25(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    norm = F.lit(1 - B) + F.lit(B) * dl.cast("double") / F.greatest(avgdl, F.lit(1.0))
    return weight * tf * (K1 + 1) / (tf + F.lit(K1) * norm)


def _score(rows: DataFrame, weight: DataFrame | None, entries: DataFrame, as_of: int) -> DataFrame:
    """Sum of BM25 times confidence and recency over (entry_id, term, tf, dl) and weights (query_id, n_terms, term, idf, avgdl).

    An entry's rows meet in one task before queries multiply them, so no hit is moved. Without ``weight``
    the rows have its columns already.
    """
    meta = entries.select("entry_id", "topic", "tags", (F.floor(F.col("confidence") * 255.0) / 255.0).alias("conf"), F.greatest(F.lit(as_of) - day(F.col("ts_min")), F.lit(0)).alias("age"))
    s = bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf")) * F.col("conf") / (1.0 + F.col("age") / 30.0)
    rows = rows.join(meta, "entry_id")
    rows = rows if weight is None else rows.join(weight, "term")
    return rows.groupBy("query_id", "entry_id").agg(F.sum(s).alias("score"), F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"), F.first("topic").alias("topic"), F.first("tags").alias("tags"))


def scored(entries: DataFrame, queries: DataFrame, posts: DataFrame, stats: DataFrame, as_of: int = AS_OF, lengths: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, entry_id, topic, tags, hits, n_terms, score) from postings and their corpus statistics.

    ``lengths`` (entry_id, dl) and ``terms`` (term, df, idf) of a stored index spare their computation.
    """
    hint = hint_of(queries)
    asked = queries.select("term").distinct()
    few = [r.term for r in asked.limit(MAX_PUSHED_TERMS + 1).collect()]
    own = posts.filter(F.col("term").isin(few)) if len(few) <= MAX_PUSHED_TERMS else posts.join(hint(asked), "term", "left_semi")
    if terms is None:
        df = own.groupBy("term").agg(F.count("*").alias("df"))
        terms = df.crossJoin(F.broadcast(stats.select("n"))).select("term", I.idf(F.col("df").cast("double"), F.col("n").cast("double")).alias("idf"))  # stats: one row
    elif len(few) <= MAX_PUSHED_TERMS:
        terms = terms.filter(F.col("term").isin(few))
    else:
        terms = terms.join(hint(asked), "term", "left_semi")
    weight = queries.join(terms.select("term", "idf"), "term").crossJoin(F.broadcast(stats.select("avgdl")))
    if lengths is not None:  # a stored index: one exchange of what is asked for, in parts that bound the hits of a task
        hits = queries.join(terms.select("term", "df"), "term").agg(F.sum("df")).first()[0] or 0
        least = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = own.repartition(max(least, hits // HITS_OF_A_TASK), "entry_id")
    return _score(own.join(I.lengths(posts) if lengths is None else lengths, "entry_id"), hint(weight), entries, as_of)


def stored(index: dict[str, DataFrame], entries: DataFrame, queries: DataFrame, as_of: int = AS_OF) -> DataFrame:
    """``scored`` with all tables of a stored index (``index.load``); ``entries`` are its filtered ``entry_meta``."""
    return scored(entries, queries, index["postings"], index["index_stats"], as_of, index["entry_meta"].select("entry_id", F.coalesce("dl", F.lit(0)).alias("dl")), index["term_stats"])


def stored_all(index: dict[str, DataFrame], entries: DataFrame, queries: DataFrame, as_of: int = AS_OF) -> DataFrame:
    """The hits of ``stored`` that have all terms of their query (``choose`` with "and"), without forming the others.

    Candidates of a query are the entries with its rarest term, if the index has all its terms; then
    those that have the second rarest; the rest is looked up for what is left.
    """
    known = queries.join(index["term_stats"], "term").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term")))
    q = checkpoint(known.withColumn("found", F.count("*").over(Window.partitionBy("query_id"))).filter("found = n_terms").drop("found"))
    hint = hint_of(q)
    posts = index["postings"].join(hint(q.select("term").distinct()), "term", "left_semi")
    some = posts.join(hint(q.filter("at = 1").select("query_id", "n_terms", "term")), "term").select("query_id", "n_terms", "entry_id")
    pairs = some.filter("n_terms > 1").join(hint(q.filter("at = 2").select("query_id", "term")), "query_id").join(posts.select("entry_id", "term"), ["entry_id", "term"])
    some = pairs.select("query_id", "entry_id").unionByName(some.filter("n_terms = 1").select("query_id", "entry_id"))
    rows = some.join(hint(q.select("query_id", "n_terms", "term", "idf")), "query_id").join(posts, ["entry_id", "term"])
    lengths = index["entry_meta"].select("entry_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    rows = rows.join(lengths, "entry_id").crossJoin(F.broadcast(index["index_stats"].select("avgdl")))  # one row
    return _score(rows, None, entries, as_of).filter("hits = n_terms")


def scan(corpus: DataFrame, entries: DataFrame, queries: DataFrame, as_of: int = AS_OF) -> DataFrame:
    """The same without an index, by one pass over the texts of ``corpus``.

    Only the queries' terms are told apart; all other tokens of an entry are one row, so what is
    shuffled is a few rows an entry. Statistics, lengths and hits come from that one exchange.
    """
    hint = hint_of(queries)
    asked = queries.select("term").distinct()
    few = [r.term for r in asked.limit(MAX_PUSHED_TERMS + 1).collect()]
    # other tokens are the empty term: a key that is never null lets no filter be pushed into one user of the exchange alone
    if len(few) <= MAX_PUSHED_TERMS:
        counts = I.counted(corpus, few)
    else:
        term = F.coalesce(F.when(F.col("asked"), F.col("term")), F.lit(""))
        counts = I.counted(corpus).join(hint(asked).withColumn("asked", F.lit(True)), "term", "left").select("entry_id", term.alias("term"), "n")
    counts = counts.groupBy("entry_id", "term").agg(F.sum("n").alias("tf"))
    df = counts.groupBy("term").agg(F.sum(F.least("tf", F.lit(1))).alias("df"), F.sum("tf").alias("all"))
    one = corpus.agg(F.count("*").alias("n"))
    total = df.agg(F.sum("all").alias("total")).crossJoin(one).select("n", (F.floor(F.col("total") / F.greatest("n", F.lit(1)) * 100.0) / 100.0).alias("avgdl"))
    idf = df.crossJoin(F.broadcast(total)).select("term", I.idf(F.col("df").cast("double"), F.col("n").cast("double")).alias("idf"), "avgdl")
    rows = counts.withColumn("dl", F.sum("tf").over(Window.partitionBy("entry_id"))).withColumn("tf", F.least("tf", F.lit(65535)))
    return _score(rows, hint(queries.join(hint(idf), "term")), entries, as_of)  # idf: a row per asked term, and one


def scored_subset(entries: DataFrame, queries: DataFrame, posts: DataFrame) -> DataFrame:
    """The other scorer: statistics of the filtered entries alone, exact logarithms, no confidence or recency."""
    own = posts.join(entries.select("entry_id"), "entry_id", "left_semi")
    n = entries.agg(F.count("*").alias("n"))
    length = I.lengths(own)
    avg = length.agg(F.sum("dl").alias("total")).crossJoin(n).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
    hint = hint_of(queries)
    hits = own.join(hint(queries), "term")
    df = hits.select("term", "entry_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    w = df.crossJoin(F.broadcast(avg)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"), "avgdl")
    s = bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    return hits.join(hint(w), "term").join(length, "entry_id").groupBy("query_id", "entry_id").agg(F.sum(s).alias("score"), F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"))


def choose(hits: DataFrame, mode: str = "auto", limit: int | None = None) -> DataFrame:
    """AND keeps hits with all terms, OR any; auto takes AND if a query has such a hit, else OR, in one plan.

    With the ``limit`` of the list that is wanted, auto first takes as many of the hits of either kind,
    tasks by themselves, so no task holds all hits of a query.
    """
    every = F.col("hits") == F.col("n_terms")
    if mode == "auto" and limit is not None:
        w = Window.partitionBy("query_id", every).orderBy(F.desc("score"), "entry_id")
        hits = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")
    if mode == "or":
        return hits
    if mode == "and":
        return hits.filter(every)
    best = F.max(every.cast("int")).over(Window.partitionBy("query_id"))
    return hits.withColumn("_all", best).filter((F.col("_all") == 0) | every).drop("_all")


def top(hits: DataFrame, limit: int = 20) -> DataFrame:
    """Best hits of each query, ties by entry_id; a window whose limit Spark pushes below the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def batch_best(hits: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of several queries as one list: each entry with its best score, the best of them, ties by entry_id."""
    return hits.groupBy("entry_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "entry_id").limit(limit)


def rerank(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Half as much again if a term is part of the topic; 0.3 more for each term found in the tags."""
    q = queries.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    h = hits.join(hint_of(queries)(q), "query_id")
    in_topic = F.exists("terms", lambda t: F.contains(F.lower("topic"), t))
    line = F.lower(F.array_join("tags", " "))
    n_tags = F.size(F.filter("terms", lambda t: F.contains(line, t)))
    return h.withColumn("score", F.col("score") * F.when(in_topic, 1.5).otherwise(1.0) * (1.0 + 0.3 * n_tags)).drop("terms")


def diverse(hits: DataFrame, k: int = 20, cap: int = 3, override: float = 1.5) -> DataFrame:
    """Top k with at most ``cap`` per topic unless a score exceeds ``override`` times the k-th best.

    What exceeds it is among the best k, the rest among the best of their topics; both lists are cut
    by the tasks before anything is moved.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    t = Window.partitionBy("query_id", "topic").orderBy(F.desc("score"), "entry_id")
    best = hits.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    above = best.withColumn("kth", F.coalesce(F.max(F.when(F.col("pos") == k, F.col("score"))).over(Window.partitionBy("query_id")), F.lit(0.0))).filter(F.col("score") > override * F.col("kth")).drop("pos", "kth")
    in_topic = hits.withColumn("in_topic", F.row_number().over(t)).filter(F.col("in_topic") <= cap).drop("in_topic")
    return top(above.unionByName(in_topic).dropDuplicates(["query_id", "entry_id"]), k)


def diverse_exact(hits: DataFrame, k: int = 20, cap: int = 3, override: float = 1.5) -> DataFrame:
    """The diversity rule as a fold in entry_id order with a heap of k, streamed task-wise per query.

    Rows of a query arrive sorted; state is the heap and the topics' slots, so a query of any size
    takes constant memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        query, heap, slots = None, [], {}

        def out() -> pd.DataFrame:
            rows = sorted(heap, key=lambda h: (-h[0], -h[1]))
            return pd.DataFrame([(query, -i, t, s) for s, i, t in rows], columns=["query_id", "entry_id", "topic", "score"])

        for batch in batches:
            for q, i, t, s in batch.itertuples(index=False):
                if q != query:
                    if query is not None:
                        yield out()
                    query, heap, slots = q, [], {}
                if len(heap) >= k:
                    if s <= heap[0][0] or (slots.get(t, 0) >= cap and s <= override * heap[0][0]):
                        continue
                    slots[heapq.heappop(heap)[2]] -= 1
                heapq.heappush(heap, (s, -i, t))
                slots[t] = slots.get(t, 0) + 1
                for gone in [x for x, n in slots.items() if n <= 0]:
                    del slots[gone]
        if query is not None:
            yield out()

    ordered = hits.select("query_id", "entry_id", "topic", "score").repartition("query_id").sortWithinPartitions("query_id", "entry_id")
    return ordered.mapInPandas(run, "query_id long, entry_id long, topic string, score double")


def grouped(hits: DataFrame, per_topic: int = 5) -> DataFrame:
    """Hits by topic, topics by their best score, a few per topic."""
    w = Window.partitionBy("query_id", "topic")
    r = F.row_number().over(w.orderBy(F.desc("score"), "entry_id"))
    return hits.withColumn("topic_best", F.max("score").over(w)).withColumn("in_topic", r).filter(F.col("in_topic") <= per_topic)


def by_topic(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "topic").agg(F.count("*").alias("n"))


def totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("topic").alias("topics"))


def hydrate(hits: DataFrame, entries: DataFrame, rows: int) -> DataFrame:
    """Bodies for the hits that are left, at most ``rows``; if these are few, no other body is moved."""
    return entries.select("entry_id", "body", "ts_min", "source").join(F.broadcast(hits) if rows <= MAX_BROADCAST_TERMS else hits, "entry_id")


def remove_similar(hits: DataFrame, entries: DataFrame, limit: float = 0.7, rows: int = 20) -> DataFrame:
    """Drop hits of a result list that resemble a better one: a fold over each query's list in score order.

    ``rows`` is what the lists hold at most, all queries together.
    """
    h = hydrate(hits, entries, rows).select("query_id", "entry_id", "score", X.long_terms("body").alias("terms"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "entry_id", "terms")))
    lists = h.groupBy("query_id").agg(rows.alias("rows"))  # result lists are bounded by their limit

    def near(a: Column, b: Column) -> Column:
        return (F.size(a["terms"]) >= 4) & (F.size(b["terms"]) >= 4) & (X.jaccard(a["terms"], b["terms"]) > limit)

    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda acc, r: F.when(F.exists(acc, lambda x: near(x, r)), acc).otherwise(F.concat(acc, F.array(r))))
    return lists.select("query_id", F.explode(kept).alias("r")).select("query_id", "r.entry_id", (-F.col("r.neg")).alias("score"))


def search(spark: SparkSession, entries: DataFrame, query: str, mode: str = "auto", limit: int = 20, index: dict[str, DataFrame] | None = None, detail: str = "medium", **where) -> DataFrame:
    """The search tool: query text with optional ``tag:``, ``topic:`` and ``source:`` words; one lazy plan.

    With the tables of a stored ``index`` no text but the result's is read.
    """
    rest, found = X.parse_query(query)
    queries = query_terms(spark, [rest])
    where = found | where
    if index is None:
        hits = scan(entries, filters(entries, **where), queries)
    else:
        hits = stored(index, filters(index["entry_meta"], **where), queries)
    if detail in ("count", "topics", "grouped"):
        hits = choose(hits, mode)
        return totals(hits) if detail == "count" else by_topic(hits) if detail == "topics" else grouped(rerank(hits, queries))
    best = top(rerank(top(choose(hits, mode, limit), limit), queries).drop("rank"), limit)
    if detail == "brief":
        return best
    full = hydrate(best, entries, limit)
    date = F.date_format(F.timestamp_seconds(F.col("ts_min").cast("long") * 60), "yyyy-MM-dd HH:mm")
    return full.select("rank", "entry_id", "topic", "score", date.alias("date"), *([F.col("body")] if detail == "full" else [X.snippet(F.col("topic"), date, F.col("body")).alias("snippet")])).orderBy("rank")
