"""Briefings: relevance, cross-topic dedup, supersession, temporal chains, categories, tiers."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import index as I
from loamgrid.sources.tables import AS_OF, day

CATEGORIES = [
    ("ARCHITECTURE", ["overview", "module-map", "architecture"]),
    ("DATA FLOW", ["data-flow", "pipeline"]),
    ("INVARIANTS", ["constraint", "invariant"]),
    ("GOTCHAS", ["gotcha"]),
    ("DECISIONS", ["decision"]),
    ("HOW-TO", ["workflow", "how-to"]),
    ("PERFORMANCE", ["zero-alloc", "performance"]),
    ("GAPS", ["missing", "gap"]),
]


def relevance(entries: DataFrame, posts: DataFrame | None, query: str, since_hours: int | None = None, as_of: int = AS_OF) -> DataFrame:
    """Entries of the query's topic (or topics of its glob) and others with one of its terms, with their relevance.

    Without stored postings the texts are read for the query's terms alone.
    """
    glob = "*" in query
    distance = F.when(F.col("topic").like(X.glob_to_like(query)), F.lit(10.0)) if glob else F.greatest(F.lit(10) - X.hierarchy_distance("topic", query), F.when(X.topic_matches("topic", query), 5)).cast("double")
    one = entries.sparkSession.range(1).select(F.explode(X.terms(F.lit(query))).alias("term"))
    if posts is None:
        counted = I.counted(entries, [r.term for r in one.collect()]).filter("term <> ''")
        posts = counted.groupBy("entry_id", "term").agg(F.least(F.sum("n"), F.lit(65535)).cast("int").alias("tf"))
    words = posts.join(F.broadcast(one), "term").groupBy("entry_id").agg(F.sum("tf").alias("tf"))  # terms of one query
    e = entries.join(words, "entry_id", "left").withColumn("base", distance).withColumn("days_old", F.greatest(F.lit(as_of) - day(F.col("ts_min")), F.lit(0)))
    if since_hours is not None:
        e = e.filter(F.col("days_old") <= (0 if since_hours <= 12 else (since_hours - 1) // 24))
    e = e.filter(F.col("base").isNotNull() | F.col("tf").isNotNull())
    lasting = F.exists("tags", lambda t: t.isin("invariant", "architecture"))
    fresh = F.when(lasting, 1.0).otherwise(1.0 + 1.0 / (1.0 + F.col("days_old") / 7.0))
    return e.withColumn("relevance", (F.coalesce("base", F.lit(0.0)) + F.coalesce("tf", F.lit(0))) * fresh * F.col("confidence"))


def dedup(rows: DataFrame) -> DataFrame:
    """Entries with the same first content in several topics: the best stays and names the others' topics."""
    key = F.lower(X.first_content("body"))
    r = rows.withColumn("key", F.when(F.octet_length(key) >= 10, key))
    w = Window.partitionBy("key")
    best = F.max(F.struct("relevance", "entry_id", "topic")).over(w)
    r = r.withColumn("best", F.when(F.col("key").isNotNull(), best)).withColumn("gone", F.coalesce((F.col("entry_id") != F.col("best.entry_id")) & (F.col("topic") != F.col("best.topic")), F.lit(False)))
    others = r.filter("gone").groupBy("key").agg(F.sort_array(F.collect_list("topic")).alias("also_in"))
    kept = r.filter("not gone").join(others, "key", "left")
    also = F.when(F.col("entry_id") == F.col("best.entry_id"), F.col("also_in"))
    return kept.withColumn("also_in", F.coalesce(also, F.array().cast("array<string>"))).drop("key", "best", "gone")


def supersede(rows: DataFrame, similar: float = 0.6, gap: int = 2) -> DataFrame:
    """(entry_id, by): older entries that a similar entry of their topic replaces, by the greedy order of entry_id.

    A topic is folded by one task, which holds the words of its entries' first lines: the order of the
    rule runs through the whole topic. Lines of fewer than three words take no part.
    """
    w = X.first_content("body")
    words = F.array_distinct(F.filter(F.split(F.lower(w), r"(?U)\s+"), lambda t: t != ""))
    base = rows.select("topic", "entry_id", "days_old", words.alias("words")).filter(F.size("words") >= 3)

    limit = round(similar * 100)

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("entry_id")
        ids, age = g.entry_id.tolist(), g.days_old.tolist()
        # equal lines are one class; classes meet by the rare words that a similar pair must share
        number: dict[frozenset, int] = {}
        of = [number.setdefault(frozenset(x), len(number)) for x in g.words]
        sets = list(number)
        df: dict[str, int] = {}
        for s in sets:
            for t in s:
                df[t] = df.get(t, 0) + 1
        near: list[list[int]] = [[k] for k in range(len(sets))]
        where: dict[str, list[int]] = {}
        for k, s in enumerate(sets):
            first = sorted(s, key=lambda t: (df[t], t))[: len(s) + (-limit * len(s)) // 100 + 1]
            for j in {j for t in first for j in where.get(t, ())}:
                n, m = len(s), len(sets[j])
                if min(n, m) * 100 < limit * max(n, m):
                    continue
                c = len(s & sets[j])
                if c * 100 // (n + m - c) >= limit:
                    near[k].append(j)
                    near[j].append(k)
            for t in first:
                where.setdefault(t, []).append(k)
        # what is left of each class by age, in the order of the rule
        left: list[dict[int, list[int]]] = [{} for _ in sets]
        for i, k in enumerate(of):
            left[k].setdefault(age[i], []).append(i)
        gone: dict[int, int] = {}
        for i, k in enumerate(of):
            if i in gone:
                continue
            last = -1
            for j in near[k]:
                for days, rows in left[j].items():
                    at = bisect_right(rows, i)
                    if days - age[i] >= gap:
                        gone.update(dict.fromkeys(rows[at:], i))
                        del rows[at:]
                    elif age[i] - days >= max(gap, 1) and at < len(rows):
                        last = max(last, rows[-1])
            if last >= 0:
                gone[i] = last
        return pd.DataFrame([(ids[a], ids[b]) for a, b in gone.items()], columns=["entry_id", "by"])

    return base.groupBy("topic").applyInPandas(fold, "entry_id long, by long")


def chains(rows: DataFrame) -> DataFrame:
    """Entries of a topic that share a dominant term become the newest of them, with the steps that led there."""
    first = X.first_content("body")
    r = rows.withColumn("term", X.dominant_term(first))
    date = F.date_format(F.timestamp_seconds(F.col("ts_min").cast("long") * 60), "MM-dd HH:mm")
    words = F.slice(F.filter(F.split(F.replace(first, F.col("term"), F.lit("")), r"(?U)\s+"), lambda t: t != ""), 1, 5)
    step = F.when(F.size(words) == 0, date).otherwise(F.concat(F.array_join(words, " "), F.lit(" ("), date, F.lit(")")))
    r = r.withColumn("step", step)
    w = Window.partitionBy("topic", "term").orderBy(F.desc("days_old"), "entry_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("entry_id").over(w)
    n = F.count("*").over(Window.partitionBy("topic", "term"))
    r = r.withColumn("n", F.when(F.col("term").isNotNull(), n).otherwise(F.lit(1))).withColumn("last", last)
    steps = r.filter("n > 1").groupBy("topic", "term").agg(F.sort_array(F.collect_list(F.struct((-F.col("days_old")).alias("o"), "entry_id", "step"))).alias("s"))
    out = r.filter((F.col("n") == 1) | (F.col("entry_id") == F.col("last"))).join(steps, ["topic", "term"], "left")
    chain = F.when(F.col("n") > 1, F.concat("term", F.lit(": "), F.array_join(F.transform("s", lambda x: x["step"]), " → ")))
    return out.withColumn("chain", chain).withColumn("relevance", F.col("relevance") + F.when(F.col("n") > 1, F.col("n")).otherwise(0)).drop("s", "step", "last", "n", "term")


def category(tags: Column, body: Column) -> Column:
    """The first category whose tag or word the entry has."""
    line = F.lower(X.first_content(body))
    out = None
    for name, words in CATEGORIES:
        hit = F.arrays_overlap(tags, F.array(*[F.lit(x) for x in words]))
        for x in words:
            hit = hit | F.contains(line, F.lit(x))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("UNTAGGED")


def compress(rows: DataFrame) -> DataFrame:
    """Dedup, halve what is superseded, chain, in order of relevance."""
    r = dedup(rows)
    r = r.join(supersede(r), "entry_id", "left").withColumn("relevance", F.when(F.col("by").isNotNull(), F.col("relevance") * 0.5).otherwise(F.col("relevance")))
    return chains(r)


def briefing(entries: DataFrame, query: str, tier: str = "scan", since_hours: int | None = None, as_of: int = AS_OF) -> DataFrame:
    """The brief tool: summary (counts), scan (three a category) or full (five whole, ten in short)."""
    r = compress(relevance(entries, None, query, since_hours, as_of)).withColumn("category", category(F.col("tags"), F.col("body")))
    if tier == "summary":
        return r.groupBy("category").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("relevance"), "entry_id"))
    text = F.when(rank <= 5, F.col("body")).otherwise(X.first_content("body")) if tier == "full" else X.first_content("body")
    return r.select("category", rank.alias("rank"), "entry_id", "topic", "relevance", "days_old", "also_in", "chain", text.alias("text")).filter(F.col("rank") <= (15 if tier == "full" else 3))


def topic_info(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.min("days_old").alias("newest"))
