"""Registered queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import brief as B
from loamgrid.operators import code as C
from loamgrid.operators import context as N
from loamgrid.operators import index as I
from loamgrid.operators import mutations as W
from loamgrid.operators import prompts as P
from loamgrid.operators import search as S
from loamgrid.operators import similarity as M
from loamgrid.operators import topics as T
from loamgrid.sources import log as L
from loamgrid.sources.shared import folder, local_folder
from loamgrid.sources.tables import AS_OF, build_calls, code_lines, day, entries, file_mtimes, read, tool_events
from loamgrid.streaming import sessions as Z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def tokens_sql(x: str) -> str:
    seg = rf"list_filter(regexp_extract_all({x}, '([A-Za-z0-9]+|[^\x00-\x7F][A-Za-z0-9\x{{80}}-\x{{10FFFF}}]*)'), lambda s: strlen(lower(s)) >= 2)"
    parts = r"string_split(trim(regexp_replace(s, '(\p{Lu})', ' \1', 'g')), ' ')"
    camel = f"list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: strlen(p) >= 2 AND p <> lower(s))"
    return f"flatten(list_transform({seg}, lambda s: list_concat(CASE WHEN regexp_matches(substr(s, 2), '[A-Z]') THEN {camel} ELSE [] END, [lower(s)])))"


def terms_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    t = f"list_filter({tokens_sql(x)}, lambda w: w NOT IN ({stop}))"
    return f"list_filter({t}, lambda w, i: list_position({t}, w) = i)"


def long_terms_sql(x: str) -> str:
    return f"list_distinct(list_filter({tokens_sql(x)}, lambda w: strlen(w) >= 3))"


KB = """kb AS (SELECT d.doc_id AS entry_id, lang || '/' || source AS topic, text AS body, CAST(28401120 + (d.doc_id * 37) % 43200 AS INTEGER) AS ts_min,
 'src/' || source || '.rs:' || CAST(d.doc_id % 97 AS VARCHAR) AS source,
 CASE WHEN toxic = 1 THEN CAST(0.3 AS DOUBLE) WHEN quality = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence,
 list_filter([lang, CASE WHEN quality = 1 THEN 'gotcha' END, CASE WHEN toxic = 1 THEN 'constraint' END], lambda x: x IS NOT NULL) AS tags,
 coalesce(toxic, 0) = 1 AS deleted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
POST = f"occ AS (SELECT entry_id, unnest({tokens_sql('body')}) AS term FROM kb), post AS (SELECT entry_id, term, CAST(least(count(*), 65535) AS INTEGER) AS tf FROM occ GROUP BY ALL), len AS (SELECT entry_id, sum(tf) AS dl FROM post GROUP BY ALL)"
STATS = "stats AS (SELECT (SELECT count(*) FROM kb) AS n, (SELECT sum(tf) FROM post) AS total), avgs AS (SELECT n, total, floor(CAST(total AS DOUBLE) / n * CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) AS avgdl FROM stats)"
IDF = "floor(ln((CAST(n AS DOUBLE) - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1) * CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE)"


def _double(*values: float) -> list[str]:
    return [f"CAST({v} AS DOUBLE)" for v in values]


def bm25_sql(idf: str) -> str:
    k1p, k1, a, b, one = _double(2.2, 1.2, 0.25, 0.75, 1.0)
    return f"{idf} * tf * {k1p} / (tf + {k1} * ({a} + {b} * dl / greatest(avgdl, {one})))"


def hits_sql(queries: str, where: str = "true") -> str:
    """CTEs up to ``hit``: (query_id, entry_id, topic, tags, hits, n_terms, score) of queries (query_id, term, n_terms)."""
    half, z, one = _double(255.0, 30.0, 1.0)
    return f"""{KB}, {POST}, {STATS}, q AS ({queries}),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, {IDF} AS idf, avgdl FROM df, avgs),
hit AS (SELECT query_id, entry_id, any_value(topic) AS topic, any_value(tags) AS tags, any_value(n_terms) AS n_terms, count(*) AS hits,
 sum({bm25_sql('idf')} * (floor(confidence * {half}) / {half}) / ({one} + greatest({AS_OF} - ts_min // 1440, 0) / {z})) AS score
 FROM post JOIN q USING (term) JOIN idf USING (term) JOIN kb USING (entry_id) JOIN len USING (entry_id) WHERE {where} GROUP BY query_id, entry_id)"""


def terms_cte(text: str) -> str:
    return f"SELECT 0 AS query_id, unnest(t) AS term, len(t) AS n_terms FROM (SELECT {terms_sql(repr(text))} AS t)"


WORDS, RARE = "thin hand erst ndble", "thin zzyzx erst"
TOP = "SELECT entry_id, round(score, 6) AS score FROM {} ORDER BY round(score, 6) DESC, entry_id LIMIT 20"


_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str, anew: bool = False) -> dict[str, DataFrame]:
    """The index of the entries, written to the shared folder by the session's first search."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if anew or key not in _INDEXES:
        where = f"{folder(spark)}/index-{uuid.uuid4().hex}"
        I.save(entries(spark, sf_dir), where)
        _INDEXES[key] = where
    try:
        return I.load(spark, _INDEXES[key])
    except AnalysisException:  # the folder was emptied since
        if anew:
            raise
        return stored_index(spark, sf_dir, anew=True)


def _raw(spark: SparkSession, sf_dir: str, words: str = WORDS, **where) -> DataFrame:
    index = stored_index(spark, sf_dir)
    return S.stored(index, S.filters(index["entry_meta"], **where), S.query_terms(spark, [words]))


def _hits(spark: SparkSession, sf_dir: str, words: str = WORDS, **where) -> DataFrame:
    return _rounded(_raw(spark, sf_dir, words, **where))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _top(hits: DataFrame) -> DataFrame:
    return S.top(_rounded(hits)).select("entry_id", "score")


# --- log and index ---


@query(f"WITH {KB} SELECT entry_id, topic, ts_min, confidence, strlen(body) AS n_bytes FROM kb WHERE NOT deleted")
def live_entries(spark, d):
    e = entries(spark, d)
    gone = read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("entry_id"))
    return e.join(gone, "entry_id", "left_anti").select("entry_id", "topic", "ts_min", "confidence", F.octet_length("body").cast("long").alias("n_bytes"))


@query(f"WITH {KB}, {POST} SELECT * FROM post")
def tokens_tf(spark, d):
    return I.postings(entries(spark, d))


@query(f"WITH {KB}, {POST}, {STATS}, df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL) SELECT term, df, {IDF} AS idf FROM df, avgs")
def doc_freq_idf(spark, d):
    e = entries(spark, d)
    p = I.postings(e)
    return I.term_stats(p, I.corpus_stats(e, p))


@query(f"WITH {KB}, {POST}, {STATS} SELECT n, CAST(total AS BIGINT) AS total, avgdl FROM avgs")
def corpus_stats(spark, d):
    e = entries(spark, d)
    return I.corpus_stats(e, I.postings(e))


_CAMEL = "array_to_string(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), '')"


@query(f"SELECT p_partkey, unnest({tokens_sql('s')}) AS token FROM (SELECT p_partkey, {_CAMEL} AS s FROM part)")
def camel_tokens(spark, d):
    s = F.replace(F.initcap(F.concat("p_name", F.lit(" "), "p_type")), F.lit(" "), F.lit(""))
    return read(spark, d, "part").select("p_partkey", F.explode(X.tokens(s)).alias("token"))


@query(f"SELECT item_id, array_to_string({terms_sql('text')}, ' ') AS terms FROM benchmark")
def query_terms(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(X.terms("text"), " ").alias("terms"))




@query(
    f"""WITH {KB}, e AS (SELECT entry_id, regexp_extract(lower(body), '([a-z]+)', 1) || '/' || split_part(topic, '/', 1) AS topic, body FROM kb), occ AS (SELECT DISTINCT entry_id, unnest({tokens_sql('body')}) AS term FROM kb),
nm AS (SELECT dst, unnest(list_distinct({tokens_sql('dst')})) AS term FROM (SELECT DISTINCT topic AS dst FROM e)), need AS (SELECT dst, count(*) AS need FROM nm GROUP BY ALL),
f AS (SELECT dst, entry_id FROM occ JOIN nm USING (term) JOIN need USING (dst) GROUP BY dst, entry_id, need HAVING count(*) = need)
SELECT topic AS src, dst, CAST(least(count(*), 65535) AS BIGINT) AS mentions FROM f JOIN e USING (entry_id) WHERE topic <> dst GROUP BY ALL"""
)
def xref_edges(spark, d):
    e = entries(spark, d)
    first = F.regexp_extract(F.lower("body"), "([a-z]+)", 1)
    return I.xref_edges(e.withColumn("topic", F.concat(first, F.lit("/"), F.substring_index("topic", "/", 1))))


# --- search ---


@query(f"WITH {hits_sql(terms_cte(WORDS))} {TOP.format('hit')}")
def bm25_or(spark, d):
    return _top(S.choose(_hits(spark, d), "or"))


@query(f"WITH {hits_sql(terms_cte(WORDS))} {TOP.format('hit')}")
def bm25_scan(spark, d):
    e = entries(spark, d)
    return _top(S.scan(e, e, S.query_terms(spark, [WORDS])))


@query(f"WITH {hits_sql(terms_cte(WORDS))} {TOP.format('hit')}")
def bm25_postings(spark, d):
    e = entries(spark, d)
    p = I.postings(e)
    return _top(S.scored(e, S.query_terms(spark, [WORDS]), p, I.corpus_stats(e, p)))


@query(f"WITH {KB}, {POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM post GROUP BY ALL")
def index_save(spark, d):
    return stored_index(spark, d, anew=True)["postings"].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {KB}, {POST} SELECT kb.entry_id, topic, confidence, CAST(coalesce(dl, 0) AS BIGINT) AS dl FROM kb LEFT JOIN len ON kb.entry_id = len.entry_id")
def index_meta(spark, d):
    return stored_index(spark, d)["entry_meta"].select("entry_id", "topic", "confidence", F.coalesce("dl", F.lit(0)).alias("dl"))


@query(f"WITH {hits_sql(terms_cte(WORDS))} {TOP.format('hit WHERE hits = n_terms')}")
def bm25_and(spark, d):
    return _top(S.choose(_hits(spark, d), "and"))


_AUTO = "(SELECT *, max(CASE WHEN hits = n_terms THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS a FROM hit) WHERE a = 0 OR hits = n_terms"


@query(f"WITH {hits_sql(terms_cte(RARE))} {TOP.format(_AUTO)}")
def bm25_fallback(spark, d):
    return _top(S.choose(_hits(spark, d, RARE), limit=20))


@query(f"WITH {hits_sql(terms_cte(WORDS), where='''(topic = 'en' OR topic LIKE 'en/%')''')} {TOP.format('hit')}")
def bm25_filtered_topic(spark, d):
    return _top(_hits(spark, d, topic="en"))


@query(f"WITH {hits_sql(terms_cte(WORDS), where='''list_contains(tags, 'gotcha')''')} {TOP.format('hit')}")
def bm25_filtered_tag(spark, d):
    return _top(_hits(spark, d, tag="gotcha"))


@query(f"WITH {hits_sql(terms_cte(WORDS), where=f'ts_min // 1440 BETWEEN {AS_OF - 14} AND {AS_OF - 3}')} {TOP.format('hit')}")
def bm25_filtered_date(spark, d):
    return _top(_hits(spark, d, after=S.relative_days(days=14), before=S.relative_days(hours=72)))


@query(f"WITH {hits_sql(terms_cte(WORDS), where='''contains(lower(source), 'src1')''')} {TOP.format('hit')}")
def bm25_filtered_source(spark, d):
    return _top(_hits(spark, d, source="SRC1"))


_SUBSET = f"""{KB}, {POST}, sub AS (SELECT entry_id FROM kb WHERE topic LIKE 'en/%'), own AS (SELECT * FROM post WHERE entry_id IN (SELECT entry_id FROM sub)), q AS ({terms_cte(WORDS)}),
av AS (SELECT (SELECT count(*) FROM sub) AS n, CAST((SELECT sum(tf) FROM own) AS DOUBLE) / (SELECT count(*) FROM sub) AS avgdl), df AS (SELECT term, count(*) AS df FROM own WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1) AS idf, avgdl FROM df, av),
hit AS (SELECT entry_id, sum({bm25_sql('idf')}) AS score FROM own JOIN q USING (term) JOIN idf USING (term) JOIN len USING (entry_id) GROUP BY ALL)"""


@query(f"WITH {_SUBSET} {TOP.format('hit')}")
def bm25_subset_stats(spark, d):
    e = entries(spark, d)
    return _top(S.scored_subset(S.filters(e, topic="en"), S.query_terms(spark, [WORDS]), I.postings(e)))


_BATCH = f"SELECT item_id AS query_id, unnest(t) AS term, len(t) AS n_terms FROM (SELECT item_id, {terms_sql('text')} AS t FROM benchmark)"
_BATCH_TOP = "t AS (SELECT query_id, entry_id, topic, tags, round(score, 6) AS score FROM (SELECT *, max(CASE WHEN hits = n_terms THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS a FROM hit) WHERE a = 0 OR hits = n_terms QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) <= 20)"


def _batch(spark, d):
    index = stored_index(spark, d)
    q = S.terms_of(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return S.top(S.choose(_rounded(S.stored(index, index["entry_meta"], q)), limit=20))


@query(f"WITH {hits_sql(_BATCH)}, {_BATCH_TOP} SELECT entry_id, max(score) AS score FROM t GROUP BY ALL ORDER BY score DESC, entry_id LIMIT 20")
def search_batch(spark, d):
    return S.batch_best(_batch(spark, d))


@query(f"WITH {hits_sql(_BATCH)}, {_BATCH_TOP} SELECT query_id, entry_id, score FROM t")
def search_queries(spark, d):
    return _batch(spark, d).select("query_id", "entry_id", "score")


_RERANK_WORDS = "thin gotcha src1 en"
_RERANK = f"""r AS (SELECT entry_id, score * CASE WHEN len(list_filter(ts, lambda w: contains(lower(topic), w))) > 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
 * (1 + CAST(0.3 AS DOUBLE) * len(list_filter(ts, lambda w: contains(lower(array_to_string(tags, ' ')), w)))) AS score FROM hit, (SELECT list(term) AS ts FROM q))"""


@query(f"WITH {hits_sql(terms_cte(_RERANK_WORDS))}, {_RERANK} {TOP.format('r')}")
def search_rerank(spark, d):
    return _top(S.rerank(_raw(spark, d, _RERANK_WORDS), S.query_terms(spark, [_RERANK_WORDS])))


_DIVERSE = """s AS (SELECT entry_id, topic, round(score, 6) AS score FROM hit), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, entry_id) AS pos, row_number() OVER (PARTITION BY topic ORDER BY score DESC, entry_id) AS it FROM s),
k AS (SELECT coalesce(max(CASE WHEN pos = 20 THEN score END), 0) AS kth FROM r) SELECT entry_id, score FROM r, k WHERE it <= 3 OR score > CAST(1.5 AS DOUBLE) * kth ORDER BY score DESC, entry_id LIMIT 20"""


@query(f"WITH {hits_sql(terms_cte(WORDS))}, {_DIVERSE}")
def search_diverse_sql(spark, d):
    return S.diverse(_hits(spark, d)).select("entry_id", "score")


@query()
def search_diverse_exact(spark, d):
    return S.diverse_exact(_hits(spark, d))


@query(f"WITH {hits_sql(terms_cte(WORDS))}, s AS (SELECT entry_id, topic, round(score, 6) AS score FROM hit) SELECT topic, entry_id, score, max(score) OVER (PARTITION BY topic) AS topic_best FROM s QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, entry_id) <= 5")
def search_grouped(spark, d):
    return S.grouped(_hits(spark, d)).select("topic", "entry_id", "score", "topic_best")


@query(f"WITH {hits_sql(terms_cte(WORDS))} SELECT topic, count(*) AS n FROM hit GROUP BY ALL")
def search_topics(spark, d):
    return S.by_topic(_hits(spark, d)).select("topic", "n")


@query(f"WITH {hits_sql(terms_cte(WORDS))} SELECT count(*) AS n, count(DISTINCT topic) AS topics FROM hit")
def search_count(spark, d):
    return S.totals(_hits(spark, d)).select("n", "topics")


def _cut_sql(x: str, n: int) -> str:
    """The longest beginning of x that has at most n bytes."""
    return f"(CASE WHEN strlen({x}) <= {n} THEN {x} ELSE substr({x}, 1, list_max(list_filter(range(1, {n + 1}), lambda i: strlen(substr({x}, 1, i)) <= {n}))) END)"


_CONTENT = r"list_filter(list_transform(string_split_regex(regexp_replace(body, '\n$', ''), '\r?\n'), lambda s: [s, trim(s, e' \t\r\n\v\f')]), lambda s: s[2] <> '' AND NOT regexp_matches(s[1], '^\[(tags|source|type|modified|tier|confidence|links|linked from):'))"


def snippets_sql(rows: str) -> str:
    """CTEs up to ``snip``: the rows with ``date`` and ``snippet``."""
    return f"""w0 AS (SELECT *, strftime(make_timestamp(CAST(ts_min AS BIGINT) * 60000000), '%Y-%m-%d %H:%M') AS date FROM {rows}),
w1 AS (SELECT *, '[' || topic || '] ' || date || ' ' || array_to_string(list_transform({_CONTENT}[1:2], lambda s: s[2]), ' ') AS x FROM w0),
w2 AS (SELECT *, {_cut_sql('x', 120)} AS y FROM w1),
snip AS (SELECT * EXCLUDE (x, y), CASE WHEN strlen(x) <= 120 OR NOT contains(y, ' ') THEN y ELSE regexp_extract(y, '(?s)^(.*) ', 1) END AS snippet FROM w2)"""


_NEAR_TOP = f"""s AS (SELECT query_id, entry_id, round(score, 6) AS score FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) <= 20),
b AS (SELECT s.*, {long_terms_sql('body')} AS t FROM s JOIN kb USING (entry_id)),
n AS (SELECT y.query_id, y.entry_id, list(x.entry_id) FILTER (WHERE len(x.t) >= 4 AND len(y.t) >= 4 AND CAST(len(list_intersect(x.t, y.t)) AS DOUBLE) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) > CAST(0.7 AS DOUBLE)) AS near
 FROM b y LEFT JOIN b x ON x.query_id = y.query_id AND (x.score > y.score OR (x.score = y.score AND x.entry_id < y.entry_id)) GROUP BY ALL),
l AS (SELECT query_id, list(struct_pack(kept := [entry_id], near := coalesce(near, [])) ORDER BY score DESC, entry_id) AS l FROM n JOIN s USING (query_id, entry_id) GROUP BY ALL),
k AS (SELECT query_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_intersect(a.kept, x.near)) > 0 THEN a ELSE struct_pack(kept := list_concat(a.kept, x.kept), near := a.near) END).kept) AS entry_id FROM l)"""


@query(f"WITH {hits_sql(terms_cte(WORDS))}, {_NEAR_TOP} SELECT query_id, entry_id, score FROM k JOIN s USING (query_id, entry_id)")
def search_dedup(spark, d):
    best = S.top(_hits(spark, d))
    return S.remove_similar(best, entries(spark, d))


_FOUND = "topic:en tag:gotcha "
_FOUND_SQL = f"""{hits_sql(terms_cte(WORDS), where="(topic = 'en' OR topic LIKE 'en/%') AND list_contains(tags, 'gotcha')")},
h20 AS (SELECT * FROM hit ORDER BY score DESC, entry_id LIMIT 20), {_RERANK.replace('FROM hit,', 'FROM h20,')},
best AS (SELECT CAST(row_number() OVER (ORDER BY r.score DESC, entry_id) AS INTEGER) AS rank, entry_id, topic, round(r.score, 6) AS score, ts_min, body FROM r JOIN kb USING (entry_id))"""


@query(f"WITH {_FOUND_SQL}, {snippets_sql('best')} SELECT rank, entry_id, topic, score, date, snippet FROM snip")
def search_medium(spark, d):
    return S.search(spark, entries(spark, d), _FOUND + WORDS, mode="or", index=stored_index(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_FOUND_SQL} SELECT rank, entry_id, topic, score, strftime(make_timestamp(CAST(ts_min AS BIGINT) * 60000000), '%Y-%m-%d %H:%M') AS date, body FROM best")
def search_full(spark, d):
    return S.search(spark, entries(spark, d), _FOUND + WORDS, mode="or", detail="full", index=stored_index(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_FOUND_SQL} SELECT rank, entry_id, topic, score FROM best")
def search_brief(spark, d):
    return S.search(spark, entries(spark, d), _FOUND + WORDS, mode="or", detail="brief", index=stored_index(spark, d)).select("rank", "entry_id", "topic", F.round("score", 6).alias("score"))


_PROMPTS = f"""p AS (SELECT conv_id * 1000 + turn AS query_id, text, contains(text, '?') OR regexp_matches(text, '^([Hh]ow |[Ww]hat.|[Ww]hy |[Ww]her.)') AS question, {terms_sql('text')} AS ts FROM conversations WHERE role = 'user'),
g AS (SELECT * FROM p WHERE strlen(text) BETWEEN 10 AND 500 AND len(ts) >= CASE WHEN question THEN 2 ELSE 3 END)"""
_PROMPT_Q = "SELECT query_id, unnest(ts[1:6]) AS term, len(ts[1:6]) AS n_terms FROM g"
_PROMPT_TOP = """t AS (SELECT hit.*, question, max(CASE WHEN hits = n_terms THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS a FROM hit JOIN g USING (query_id)),
u AS (SELECT query_id, entry_id, round(score, 6) AS score FROM t WHERE hits = n_terms OR (question AND a = 0))
SELECT query_id, entry_id, score FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) <= 3"""


@query(f"WITH {_PROMPTS}, {hits_sql(_PROMPT_Q)}, {_PROMPT_TOP}")
def prompt_context(spark, d):
    c = read(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return N.for_prompts(entries(spark, d), c, index=stored_index(spark, d)).select("query_id", "entry_id", "score")


_ERRORS = f"SELECT item_id AS query_id, unnest(ts[1:8]) AS term, len(ts[1:8]) AS n_terms FROM (SELECT item_id, text, {terms_sql('text')} AS ts FROM benchmark) WHERE strlen(text) >= 15 AND len(ts) >= 2"


@query(f"WITH {hits_sql(_ERRORS)} SELECT query_id, entry_id, round(score, 6) AS score FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) <= 3")
def error_context(spark, d):
    errors = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return N.for_errors(entries(spark, d), errors, index=stored_index(spark, d)).select("query_id", "entry_id", "score")


@query(f"WITH {_PROMPTS} SELECT query_id, question FROM g")
def prompt_gate(spark, d):
    c = read(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return N.gate(c).select("query_id", "question")


@query()
def ambient_context(spark, d):
    return N.ambient(spark, entries(spark, d), "src/src7.rs", ["thin", "hand"], ["erst"])


# --- topics ---


@query(f"WITH {KB} SELECT topic, count(*) AS n, max(ts_min) AS last FROM kb GROUP BY ALL")
def topic_list(spark, d):
    return T.topic_list(entries(spark, d))


@query(f"WITH {KB}, t AS (SELECT topic, count(*) AS n, max(ts_min) AS last FROM kb GROUP BY ALL) SELECT split_part(topic, '/', 1) AS prefix, CAST(sum(n) AS BIGINT) AS n, max(last) AS last, count(*) AS topics FROM t GROUP BY ALL")
def topic_rollup(spark, d):
    return T.rollup(entries(spark, d))


@query(f"WITH {KB} SELECT topic, CAST(max(ts_min // 1440) AS INTEGER) AS last_day FROM kb GROUP BY ALL")
def topic_recency(spark, d):
    return T.recency(entries(spark, d))


@query(f"WITH {KB} SELECT topic, CAST({AS_OF} - max(ts_min // 1440) AS INTEGER) AS age FROM kb GROUP BY ALL HAVING age > 1")
def topic_prune(spark, d):
    return T.stale_topics(entries(spark, d), 1)


@query(f"WITH {KB} SELECT topic, CAST(max(ts_min // 1440) AS INTEGER) AS last_day FROM kb GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 15")
def topic_newest(spark, d):
    return T.newest(entries(spark, d))


@query(f"WITH {KB} SELECT entry_id, topic FROM kb WHERE ts_min // 1440 >= {AS_OF - 7}")
def topic_recent(spark, d):
    return T.recent(entries(spark, d)).select("entry_id", "topic")


@query(f"WITH {KB} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM kb) GROUP BY ALL ORDER BY n DESC, tag LIMIT 32")
def tag_freq(spark, d):
    return T.top_tags(entries(spark, d))


@query(f"WITH {KB} SELECT count(DISTINCT topic) AS topics, count(*) AS entries, min(ts_min) AS first, max(ts_min) AS last FROM kb")
def kb_stats(spark, d):
    return T.stats(entries(spark, d))


@query(f"WITH {KB} SELECT entry_id, topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY entry_id) - 1 AS INTEGER) AS idx FROM kb")
def entry_index(spark, d):
    return T.entry_index(entries(spark, d)).select("entry_id", "topic", "idx")


@query(f"WITH {KB} SELECT entry_id FROM kb WHERE contains(lower(body), 'thin')")
def match_body(spark, d):
    return T.matching(entries(spark, d), "Thin").select("entry_id")


@query(f"WITH {KB}, m AS (SELECT 'src/src' || CAST(user_id % 20 AS VARCHAR) || '.rs' AS path, max(ts) AS mtime FROM events GROUP BY ALL) SELECT entry_id, path FROM kb JOIN m ON split_part(source, ':', 1) = path WHERE epoch(mtime) > CAST(ts_min AS BIGINT) * 60")
def stale_sources(spark, d):
    return T.stale_sources(entries(spark, d), file_mtimes(spark, d)).select("entry_id", "path")


@query(f"WITH {KB} SELECT entry_id FROM kb WHERE contains(source, 'src7.rs')")
def source_entries(spark, d):
    return T.by_source(entries(spark, d), "src7.rs").select("entry_id")


@query(f"WITH {KB} SELECT entry_id, CASE topic WHEN 'en/src0' THEN 'english/zero' WHEN 'fr/src1' THEN 'en/src2' ELSE topic END AS topic FROM kb")
def rename_map(spark, d):
    names = spark.createDataFrame([("en/src0", "english/zero"), ("fr/src1", "en/src2")], "topic string, renamed string")
    return T.rename(entries(spark, d), F.broadcast(names)).select("entry_id", "topic")  # a fixed map


@query(f"WITH {KB} SELECT entry_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(tags, ['reviewed', 'en'])), lambda x: x <> 'gotcha')), ',') AS tags FROM kb")
def tag_edit(spark, d):
    return entries(spark, d).select("entry_id", F.array_join(T.edit_tags(F.col("tags"), ["reviewed", "en"], ["gotcha"]), ",").alias("tags"))


@query(f"WITH {KB}, i AS (SELECT DISTINCT user_id AS session, event_id % (SELECT count(*) FROM documents) AS entry_id FROM events) SELECT session, topic, count(*) AS n FROM i JOIN kb USING (entry_id) GROUP BY ALL HAVING count(*) >= 3")
def focus_topics(spark, d):
    n = read(spark, d, "documents").count()
    i = read(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % n).alias("entry_id"))
    return T.focus(i, entries(spark, d))


_LAYERS = """l AS (SELECT user_id AS session, event_id % (SELECT count(*) FROM documents) AS entry_id, CAST(event_id % 4 AS INTEGER) AS layer, value AS score FROM events),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY session, entry_id ORDER BY layer, score DESC) = 1)
SELECT session, entry_id, layer FROM (SELECT *, row_number() OVER (PARTITION BY session, layer ORDER BY score DESC, entry_id) AS r FROM o) WHERE r <= CASE layer WHEN 1 THEN 5 ELSE 3 END"""


@query(f"WITH {_LAYERS}")
def ambient_layers(spark, d):
    n = read(spark, d, "documents").count()
    e = read(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % n).alias("entry_id"), (F.col("event_id") % 4).cast("int").alias("layer"), F.col("value").alias("score"))
    return T.first_layer(e, {0: 3, 1: 5, 2: 3, 3: 3}).select("session", "entry_id", "layer")


# --- duplicates ---

_SETS = "sets AS (SELECT topic, entry_id, {} AS terms FROM kb), big AS (SELECT * FROM sets WHERE len(terms) >= {})"
_J = "CAST(len(list_intersect(a.terms, b.terms)) AS DOUBLE) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms)))"
_PAIRS = f"WITH {KB}, {_SETS.format(long_terms_sql('body'), 4)} SELECT a.topic, a.entry_id AS a, b.entry_id AS b, round({_J}, 6) AS similarity FROM big a JOIN big b ON a.topic = b.topic AND a.entry_id < b.entry_id AND {_J} > CAST(0.7 AS DOUBLE)"


@query(_PAIRS)
def near_dup_topic(spark, d):
    return M.similar_pairs(M.token_sets(entries(spark, d), 4), 0.7).withColumn("similarity", F.round("similarity", 6))


_ASYM = f"""WITH {KB}, old AS (SELECT entry_id, topic, list_distinct({tokens_sql('body')}) AS w FROM kb), new AS (SELECT entry_id AS new_id, topic, {long_terms_sql('body')} AS t FROM kb),
p AS (SELECT new_id, entry_id, len(list_intersect(t, w)) AS o, len(t) AS n, len(w) AS m FROM new JOIN old ON new.topic = old.topic WHERE len(t) >= 6 AND len(t) > CAST(0.7 AS DOUBLE) * len(w) AND len(w) > CAST(0.7 AS DOUBLE) * len(t))
SELECT new_id, entry_id, round(CAST(o AS DOUBLE) / (n + m - o), 6) AS similarity FROM p WHERE CAST(o AS DOUBLE) / (n + m - o) > CAST(0.7 AS DOUBLE)"""


@query(_ASYM)
def near_dup_asym(spark, d):
    e = entries(spark, d)
    return M.store_check(e, e.select(F.col("entry_id").alias("new_id"), "topic", "body")).withColumn("similarity", F.round("similarity", 6))


_KEEP = f"""{_PAIRS.replace("{}, 4", "").split(" SELECT a.topic, a.entry_id AS a")[0].replace(">= 4)", ">= 6)")},
p AS (SELECT a.topic, b.entry_id, list(a.entry_id) AS near FROM big a JOIN big b ON a.topic = b.topic AND a.entry_id < b.entry_id AND {_J} > CAST(0.7 AS DOUBLE) GROUP BY ALL),
l AS (SELECT big.topic, list(struct_pack(kept := [big.entry_id], near := coalesce(near, [])) ORDER BY big.entry_id) AS l FROM big LEFT JOIN p ON p.topic = big.topic AND p.entry_id = big.entry_id GROUP BY ALL),
k AS (SELECT topic, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_intersect(a.kept, x.near)) > 0 THEN a ELSE struct_pack(kept := list_concat(a.kept, x.kept), near := a.near) END).kept) AS entry_id FROM l)"""


@query(f"{_KEEP} SELECT big.topic, big.entry_id, k.entry_id IS NOT NULL AS kept FROM big LEFT JOIN k ON k.topic = big.topic AND k.entry_id = big.entry_id")
def batch_dedup(spark, d):
    return M.batch_dedup(entries(spark, d))


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), "embedding")


def _cosines_sql(low: float, high: float, more: str = "") -> str:
    dot = "list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))"
    return f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, {dot} AS c FROM v a JOIN v b ON a.vec_id < b.vec_id {more}) SELECT a, b, round(c, 6) AS cosine FROM p WHERE c >= CAST({low} AS DOUBLE) AND c < CAST({high} AS DOUBLE)"


@query(_cosines_sql(0.4, 2.0))
def cosine_pairs(spark, d):
    return M.cosine_pairs(_vectors(spark, d), 0.4).withColumn("cosine", F.round("cosine", 6))


@query(_cosines_sql(0.35, 0.45, "AND a.label <> b.label"))
def cross_links(spark, d):
    return M.cosine_pairs(_vectors(spark, d), 0.35, 0.45, across=True).withColumn("cosine", F.round("cosine", 6))


@query("SELECT topic, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS value FROM (SELECT label AS topic, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY topic, pos")
def topic_centroids(spark, d):
    return M.centroids(_vectors(spark, d)).withColumn("value", F.round("value", 6))


@query(
    "WITH c AS (SELECT topic, pos, avg(v) AS x FROM (SELECT label AS topic, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY topic, pos), n AS (SELECT topic, sqrt(sum(x * x)) AS n FROM c GROUP BY ALL), "
    "p AS (SELECT a.topic AS a, b.topic AS b, sum(a.x * b.x) AS dot FROM c a JOIN c b ON a.pos = b.pos AND a.topic < b.topic GROUP BY ALL) SELECT a, b, round(dot / (x.n * y.n), 6) AS cosine FROM p JOIN n x ON x.topic = a JOIN n y ON y.topic = b WHERE dot / (x.n * y.n) > CAST(0.1 AS DOUBLE)"
)
def topic_overlap(spark, d):
    return M.centroid_overlap(_vectors(spark, d), 0.1).withColumn("cosine", F.round("cosine", 6))


# --- briefing ---

_FIRST = r"coalesce(list_filter(list_transform(string_split_regex(regexp_replace(body, '\n$', ''), '\r?\n'), lambda s: trim(s, e' \t\r\n\v\f')), lambda s: s <> '' AND NOT regexp_matches(s, '^\[(tags|source|type|modified|tier|confidence|links|linked from):'))[1], '')"
_REL = f"""{KB}, {POST}, r AS (SELECT kb.*, greatest({AS_OF} - ts_min // 1440, 0) AS days_old, CASE WHEN topic = 'en/src1' THEN CAST(10 AS DOUBLE) WHEN topic LIKE 'en/src1/%' THEN CAST(9 AS DOUBLE) END AS base,
 (SELECT sum(tf) FROM post WHERE post.entry_id = kb.entry_id AND list_contains({terms_sql("'en/src1'")}, term)) AS tf FROM kb),
rel AS (SELECT *, (coalesce(base, 0) + coalesce(tf, 0)) * (1 + 1 / (1 + days_old / CAST(7 AS DOUBLE))) * confidence AS relevance FROM r WHERE base IS NOT NULL OR tf IS NOT NULL)"""


def _relevant(spark, d):
    e = entries(spark, d)
    return B.relevance(e, None, "en/src1")


@query(f"WITH {_REL} SELECT entry_id, round(relevance, 6) AS relevance, CAST(days_old AS INTEGER) AS days_old FROM rel")
def brief_relevance(spark, d):
    return _relevant(spark, d).select("entry_id", F.round("relevance", 6).alias("relevance"), "days_old")


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'''list_contains(tags, '{w}') OR contains(lower({_FIRST}), '{w}')''' for w in words)} THEN '{name}'" for name, words in B.CATEGORIES) + " ELSE 'UNTAGGED' END"


@query(f"WITH {KB} SELECT entry_id, {_CATEGORY} AS category FROM kb")
def brief_category(spark, d):
    return entries(spark, d).select("entry_id", B.category(F.col("tags"), F.col("body")).alias("category"))


_DEDUP = f"""WITH {KB}, k AS (SELECT *, CASE WHEN strlen(lower({_FIRST})) >= 10 THEN lower({_FIRST}) END AS key, confidence AS relevance FROM kb),
b AS (SELECT key, arg_max(entry_id, struct_pack(a := relevance, b := entry_id)) AS best, arg_max(topic, struct_pack(a := relevance, b := entry_id)) AS best_topic FROM k WHERE key IS NOT NULL GROUP BY key),
j AS (SELECT k.*, best, best_topic, coalesce(k.entry_id <> best AND k.topic <> best_topic, false) AS gone FROM k LEFT JOIN b ON k.key = b.key),
o AS (SELECT key, list_sort(list(topic)) AS others FROM j WHERE gone GROUP BY key)
SELECT entry_id, CASE WHEN entry_id = best THEN coalesce(array_to_string(others, ','), '') ELSE '' END AS also_in FROM j LEFT JOIN o ON j.key = o.key WHERE NOT gone"""


@query(_DEDUP)
def brief_dedup(spark, d):
    return B.dedup(entries(spark, d).withColumn("relevance", F.col("confidence"))).select("entry_id", F.array_join("also_in", ",").alias("also_in"))


@query()
def brief_chain(spark, d):
    return B.chains(_relevant(spark, d)).select("entry_id", F.round("relevance", 6).alias("relevance"), "chain")


@query()
def brief_supersede_exact(spark, d):
    return B.supersede(entries(spark, d).withColumn("days_old", F.lit(AS_OF) - day(F.col("ts_min"))))


@query()
def brief_scan(spark, d):
    return B.briefing(entries(spark, d), "en/src1")


@query(f"WITH {_REL} SELECT topic, count(*) AS n, CAST(min(days_old) AS INTEGER) AS newest FROM rel GROUP BY ALL")
def brief_topics(spark, d):
    return B.topic_info(_relevant(spark, d))


# --- text ---


@query(f"WITH {KB}, {snippets_sql('kb')} SELECT entry_id, snippet FROM snip")
def snippet(spark, d):
    date = F.date_format(F.timestamp_seconds(F.col("ts_min").cast("long") * 60), "yyyy-MM-dd HH:mm")
    return entries(spark, d).select("entry_id", X.snippet(F.col("topic"), date, F.col("body")).alias("snippet"))


_BODY = "'[tags: ' || lang || ', b' || source || ']' || chr(10) || '[source: ' || source || '.rs]' || chr(10) || '[confidence: 0.' || CAST(doc_id % 9 + 1 AS VARCHAR) || ']' || chr(10) || 'x'"


@query(f"SELECT doc_id, regexp_extract(b, '\\[tags: (.*)\\]', 1) AS tags, regexp_extract(b, '\\[source: (.*)\\]', 1) AS source, CAST(regexp_extract(b, '\\[confidence: (.*)\\]', 1) AS DOUBLE) AS confidence FROM (SELECT doc_id, {_BODY} AS b FROM documents)")
def metadata_parse(spark, d):
    b = F.concat(F.lit("[tags: "), "lang", F.lit(", b"), "source", F.lit("]\n[source: "), "source", F.lit(".rs]\n[confidence: 0."), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("]\nx"))
    return read(spark, d, "documents").select("doc_id", X.metadata(b).alias("m")).select("doc_id", F.array_join("m.tags", ", ").alias("tags"), "m.source", "m.confidence")


def _single(w: str) -> str:
    return f"CASE WHEN strlen({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' AND strlen({w}) >= 5 THEN regexp_replace({w}, 'ies$', 'y') WHEN {w} LIKE '%sses' THEN regexp_replace({w}, 'es$', '') WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') THEN regexp_replace({w}, 's$', '') ELSE {w} END"


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_transform(string_split(replace(p_name, ' ', 's,') || 's,Gaps, ' || p_type, ','), lambda x: trim(x)), lambda w: lower({_single('w')})), lambda x: x <> ''))), ', ') AS tags FROM part")
def normalize_tags(spark, d):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("s,")), F.lit("s,Gaps, "), "p_type")
    return read(spark, d, "part").select("p_partkey", X.normalize_tags(raw).alias("tags"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(regexp_replace(lower(p_brand || '//' || p_name || '/ #' || p_type || '-'), '[^\\p{L}\\p{N}/-]', '-', 'g'), '/'), lambda x: trim(x, '-')), lambda x: x <> ''), '/') AS topic FROM part")
def sanitize_topic(spark, d):
    return read(spark, d, "part").select("p_partkey", X.sanitize_topic(F.concat("p_brand", F.lit("//"), "p_name", F.lit("/ #"), "p_type", F.lit("-"))).alias("topic"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'gotcha' WHEN 1 THEN 'gap' WHEN 2 THEN 'data-flow' END AS tags FROM part")
def auto_tags(spark, d):
    lead = F.when(F.col("p_size") % 4 == 0, "Bug: ").when(F.col("p_size") % 4 == 1, " TODO: ").when(F.col("p_size") % 4 == 2, "\nflow: ").otherwise("")
    return read(spark, d, "part").select("p_partkey", X.auto_tags(F.concat(lead, "p_name")).alias("tags"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark, d):
    e = read(spark, d, "events")
    key = F.get(F.json_object_keys("props"), F.lit(0))
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.element_at(m, key).alias("first_value"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query(f"WITH {KB} SELECT topic, entry_id, ts_min, strlen(body) AS n FROM kb WHERE body <> ''")
def json_export(spark, d):
    e = entries(spark, d)
    back = L.to_json(e).select("topic", F.col("entries").alias("rows"))
    rows = back.select("topic", F.posexplode(F.from_json("rows", "array<struct<ts:int,body:string>>")).alias("at", "r")).select("topic", "at", F.col("r.ts").alias("ts_min"), F.octet_length("r.body").cast("long").alias("n"))
    at = F.row_number().over(Window.partitionBy("topic").orderBy("ts_min", "entry_id")) - 1  # entries of one minute stand in the order of their ids
    return rows.filter("n > 0").join(e.select("topic", "entry_id", at.alias("at")), ["topic", "at"]).select("topic", "entry_id", "ts_min", "n")


# --- code ---

_LINES = "lines AS (SELECT page_id AS path, ln AS line, x AS text FROM (SELECT page_id, unnest(range(1, len(a) + 1)) AS ln, unnest(a) AS x FROM (SELECT page_id, string_split(html, '><') AS a FROM pages)))"


def _page_lines(spark, d):
    a = F.split("html", "><")
    return read(spark, d, "pages").select(F.col("page_id").alias("path"), F.posexplode(a).alias("line", "text")).withColumn("line", F.col("line") + 1)


_PAGE_RULES = [("nav", ["nav", "href"]), ("code", ["script", "style"]), ("text", ["<p", "p>", "article"])]


@query(f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, k AS kind FROM (SELECT path, line, unnest(list_filter([{', '.join('CASE WHEN ' + ' OR '.join(f'''contains(text, '{w}')''' for w in ws) + f''' THEN '{k}' END''' for k, ws in _PAGE_RULES)}], lambda x: x IS NOT NULL)) AS k FROM lines WHERE NOT regexp_matches(trim(text), '^(//|/\\*|\\* )'))")
def line_patterns(spark, d):
    return C.patterns(_page_lines(spark, d), _PAGE_RULES).select("path", "line", "kind")


_IDS = "ids AS (SELECT path, line, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z0-9_]+)'))) AS name FROM lines WHERE NOT regexp_matches(trim(text), '^(//|/\\*|\\* )'))"


@query(f"WITH {_LINES}, {_IDS}, n AS (SELECT name, count(*) AS n FROM ids GROUP BY ALL) SELECT name, n FROM n WHERE strlen(name) >= 4")
def word_usages(spark, d):
    return C.identifiers(_page_lines(spark, d)).groupBy("name").agg(F.count("*").alias("n")).filter(F.octet_length("name") >= 4)


_DEFS = "defs AS (SELECT path AS home, line, regexp_extract(text, '^h1>([A-Za-z0-9_]+)', 1) AS name FROM lines WHERE regexp_matches(text, '^h1>[A-Za-z0-9_]{4,}'))"


def _defs(lines):
    return lines.select(F.regexp_extract("text", "^h1>([A-Za-z0-9_]+)", 1).alias("name"), "path", "line").filter(F.octet_length("name") >= 4)


@query(f"WITH {_LINES}, {_DEFS}, w AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+)')) AS name FROM lines) SELECT least(path, home) AS a, greatest(path, home) AS b, count(*) AS n FROM w JOIN defs USING (name) WHERE path <> home GROUP BY ALL HAVING count(*) >= 2")
def coupling(spark, d):
    lines = _page_lines(spark, d)
    return C.coupling(lines, _defs(lines))


@query(f"WITH {_LINES}, {_IDS}, {_DEFS} SELECT defs.name, home AS def_path, ids.path, CAST(ids.line AS INTEGER) AS line FROM defs JOIN ids USING (name) WHERE home <> ids.path OR defs.line <> ids.line")
def symbol_usages(spark, d):
    lines = _page_lines(spark, d)
    return C.usages(lines, _defs(lines)).select("name", "def_path", "path", "line")


# --- source lines ---

_CODE = """code AS (SELECT 'src/mod' || CAST(p_partkey % 50 AS VARCHAR) || '.rs' AS path, CAST(p_partkey // 50 AS INTEGER) AS line, CASE p_size % 8
 WHEN 0 THEN 'pub fn work_' || CAST(p_partkey % 200 AS VARCHAR) || '(x: u32) -> u32 {' WHEN 1 THEN '    let y = work_' || CAST(p_partkey * 7 % 200 AS VARCHAR) || '(1);'
 WHEN 2 THEN 'use lib' || CAST(p_partkey % 9 AS VARCHAR) || '::Value;' WHEN 3 THEN '// calls work_' || CAST(p_partkey % 200 AS VARCHAR)
 WHEN 4 THEN '    unsafe { mmap(work_' || CAST(p_partkey % 100 AS VARCHAR) || ') }' WHEN 5 THEN 'struct Kind' || CAST(p_partkey % 40 AS VARCHAR) || ' {'
 WHEN 6 THEN '    static L: Mutex<Kind' || CAST(p_partkey % 40 AS VARCHAR) || '> = new();' ELSE '}' END AS text FROM part),
sym AS (SELECT CASE WHEN text LIKE 'pub fn %' THEN regexp_extract(text, 'fn ([a-z_0-9]+)', 1) ELSE regexp_extract(text, 'struct (Kind[0-9]+)', 1) END AS name, CASE WHEN text LIKE 'pub fn %' THEN 'fn' ELSE 'struct' END AS kind, path, line, text AS signature FROM code WHERE regexp_matches(text, '^(pub fn|struct) ')),
use AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+)')) AS name FROM code WHERE text NOT LIKE '//%'),
usage AS (SELECT use.name, sym.path AS def_path, sym.line AS def_line, use.path, use.line FROM use JOIN sym USING (name) WHERE use.path <> sym.path OR use.line <> sym.line),
pat AS (SELECT path, line, unnest(CASE WHEN contains(text, 'unsafe ') THEN ['unsafe', 'mmap'] WHEN contains(text, 'Mutex') THEN ['lock'] ELSE [] END) AS kind, trim(text) AS context FROM code)"""


@query(f"WITH {_CODE} SELECT * FROM sym")
def code_symbols(spark, d):
    return C.symbols(code_lines(spark, d))


@query(f"WITH {_CODE} SELECT path, array_to_string(list_sort(list(DISTINCT regexp_extract(text, 'use ([^:]*)', 1))), ',') AS modules FROM code WHERE text LIKE 'use %' GROUP BY ALL")
def code_imports(spark, d):
    return C.imports(code_lines(spark, d)).select("path", F.array_join("modules", ",").alias("modules"))


@query(f"WITH {_CODE} SELECT name, def_path, def_line, path, line FROM usage")
def code_usages(spark, d):
    lines = code_lines(spark, d)
    return C.usages(lines, C.symbols(lines))


@query(f"WITH {_CODE} SELECT name, path, line, CAST(count(*) OVER (PARTITION BY name, path) AS BIGINT) AS n FROM usage QUALIFY row_number() OVER (PARTITION BY name, path ORDER BY line) = 1")
def code_usages_by_file(spark, d):
    lines = code_lines(spark, d)
    return C.usages_in_files(lines, C.symbols(lines))


@query(f"WITH {_CODE}, u AS (SELECT name, def_line, count(*) AS uses, array_to_string(list_sort(list(DISTINCT path)), ',') AS files FROM usage WHERE def_path = 'src/mod7.rs' GROUP BY ALL) SELECT sym.name, sym.line AS def_line, coalesce(uses, 0) AS uses, coalesce(files, '') AS files FROM sym LEFT JOIN u ON sym.name = u.name AND sym.line = u.def_line WHERE path = 'src/mod7.rs'")
def code_blast_radius(spark, d):
    lines = code_lines(spark, d)
    return C.blast_radius(lines, C.symbols(lines), "src/mod7.rs").select("name", "def_line", "uses", F.array_join("files", ",").alias("files"))


@query(f"WITH {_CODE}, d AS (SELECT * FROM sym WHERE name = 'Kind8'), f AS (SELECT * FROM d ORDER BY path, line LIMIT 1) SELECT 'definition' AS role, path, line FROM d UNION ALL SELECT 'usage', u.path, u.line FROM usage u JOIN f ON u.name = f.name AND u.def_path = f.path AND u.def_line = f.line")
def code_trace(spark, d):
    lines = code_lines(spark, d)
    return C.trace(lines, C.symbols(lines), "Kind8")


@query(f"WITH {_CODE} SELECT kind, path, line, context FROM pat")
def code_patterns(spark, d):
    return C.patterns(code_lines(spark, d))


@query(f"WITH {_CODE} SELECT kind, path, line, count(*) OVER (PARTITION BY kind) AS n, CAST(row_number() OVER (PARTITION BY kind ORDER BY path, line) AS INTEGER) AS rank FROM pat QUALIFY row_number() OVER (PARTITION BY kind ORDER BY path, line) <= 5")
def code_pattern_inventory(spark, d):
    return C.pattern_inventory(C.patterns(code_lines(spark, d))).select("kind", "path", "line", "n", "rank")


@query(f"WITH {_CODE} SELECT path, count(*) AS lines, (SELECT count(*) FROM sym WHERE sym.path = code.path) AS symbols, (SELECT count(*) FROM pat WHERE pat.path = code.path) AS patterns FROM code GROUP BY ALL")
def code_module_map(spark, d):
    lines = code_lines(spark, d)
    return C.module_map(lines, C.symbols(lines), C.patterns(lines))


@query(f"WITH {_CODE} SELECT DISTINCT path FROM code WHERE path LIKE 'src/mod_%3.rs' ORDER BY path LIMIT 3")
def code_listing(spark, d):
    return C.listing(code_lines(spark, d), "mod?*3.rs", 3)


@query(f"""WITH {_CODE}, w AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+)')) AS name FROM code),
c AS (SELECT least(w.path, sym.path) AS a, greatest(w.path, sym.path) AS b, count(*) AS n FROM w JOIN sym USING (name) WHERE w.path <> sym.path GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 15),
m AS (SELECT path, count(*) AS lines, (SELECT count(*) FROM sym WHERE sym.path = code.path) AS symbols FROM code GROUP BY ALL),
i AS (SELECT path, array_to_string(list_sort(list(DISTINCT regexp_extract(text, 'use ([^:]*)', 1))), ', ') AS modules FROM code WHERE text LIKE 'use %' GROUP BY ALL),
p AS (SELECT * FROM pat QUALIFY row_number() OVER (PARTITION BY kind ORDER BY path, line) <= 5)
SELECT 'project' AS topic, 7 AS ts_min, '[tags: ' || k || ']' || chr(10) || '[confidence: 0.8]' || chr(10) || t AS body FROM (
SELECT 'module-map' AS k, string_agg(path || ' ' || lines || ' ' || symbols, chr(10) ORDER BY lines DESC, path) AS t FROM m
UNION ALL SELECT 'symbols', string_agg(kind || ' ' || name || ' ' || path, chr(10) ORDER BY path, line) FROM sym
UNION ALL SELECT 'coupling', string_agg(a || ' ' || b || ' ' || n, chr(10) ORDER BY n DESC, a, b) FROM c
UNION ALL SELECT 'pattern', string_agg(kind || ' ' || path || ' ' || line, chr(10) ORDER BY kind, path, line) FROM p
UNION ALL SELECT 'dependencies', string_agg(path || ': ' || modules, chr(10) ORDER BY path) FROM i)""")
def code_analyze(spark, d):
    return C.analyze(code_lines(spark, d), "project", 7)


_CALLS = """calls AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'cargo build --release' WHEN 1 THEN 'xcodebuild -scheme app build' ELSE 'ls build' END AS command, event_id % 5 AS m, CAST(event_id % 7 AS VARCHAR) AS n FROM events)"""


@query(f"WITH {_CALLS} SELECT id, 'build-errors' AS topic, '[tags: auto, build-error]' || chr(10) || CASE m WHEN 0 THEN 'a.rs:' || n || ': error: bad type' || chr(10) || 'error[E' || n || ']: lifetime' ELSE '** BUILD FAILED **' || chr(10) || 'aborting due to errors' END AS body FROM calls WHERE command <> 'ls build' AND m < 2")
def build_notes(spark, d):
    return C.build_notes(build_calls(spark, d))


@query(f"WITH {_CALLS} SELECT id, unnest(['decode took 12.' || n || 'ms', 'speed 88 tok/s']) AS line FROM calls WHERE m = 2")
def build_benchmarks(spark, d):
    return C.benchmark_lines(build_calls(spark, d)).select("id", "line")


# --- log and edits ---


def _log(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The live entries of a log that the rows (kind, topic, body, ts_min, target) were written to, read back."""
    L.register(spark)
    where = f"{local_folder(spark)}/log-{uuid.uuid4().hex}"
    rows.selectExpr("CAST(NULL AS STRING) AS file", "kind", "CAST(NULL AS LONG) AS log_offset", "topic", "body", "ts_min", "target").write.format("knowledge_log").mode("append").save(where)
    return L.live(spark.read.format("knowledge_log").load(where))


@query(f"WITH {KB} SELECT topic, ts_min, '[tags: ' || lang || ']' || chr(10) || '[confidence: 0.5]' || chr(10) || body AS body FROM (SELECT kb.*, split_part(topic, '/', 1) AS lang FROM kb) WHERE topic LIKE '%/src1'")
def log_store(spark, d):
    e = entries(spark, d).filter("topic like '%/src1'")
    none = F.lit(None).cast("string")
    new = e.select("topic", F.col("body").alias("text"), F.substring_index("topic", "/", 1).alias("tags"), none.alias("source"), F.lit(0.5).alias("confidence"), none.alias("links"), "ts_min")
    return _log(spark, W.store(new)).select("topic", "ts_min", "body")


@query(
    f"""WITH {KB}, e AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY entry_id) AS i, row_number() OVER (PARTITION BY topic ORDER BY entry_id DESC) AS j FROM kb)
SELECT CASE topic WHEN 'en/src0' THEN 'english/zero-one' ELSE topic END AS topic, ts_min,
 CASE WHEN topic = 'en/src1' AND i = 1 THEN body || chr(10) || 'And more.' WHEN topic = 'en/src2' AND j = 1 THEN '[modified: 2024-01-31]' || chr(10) || 'New text.' WHEN topic = 'fr/src1' AND i = 2 THEN '[tags: checked]' || chr(10) || array_to_string(string_split_regex(regexp_replace(body, '\n$', ''), '\r?\n'), chr(10)) ELSE body END AS body
FROM e WHERE NOT (topic = 'fr/src2' AND i = 1)"""
)
def log_edits(spark, d):
    e = entries(spark, d).select("entry_id", "topic", "body", "ts_min")
    edits = [
        W.append(W.pick(e, "en/src1", index=0), "And more."),
        W.revise(W.pick(e, "en/src2"), "New text.", "2024-01-31"),
        W.retag(W.pick(e, "fr/src1", index=1), ["checked"], []),
        W.delete(W.pick(e, "fr/src2", index=0)),
        W.rename(e, "en/src0", "English/Zero One"),
    ]
    now = W.apply(e, reduce(DataFrame.unionByName, edits), 1_000_000_000)
    return _log(spark, now.select(F.lit("entry").alias("kind"), "topic", "body", "ts_min", F.lit(None).cast("long").alias("target"))).select("topic", "ts_min", "body")


@query(f"""{_KEEP} SELECT kb.topic, ts_min, body FROM kb LEFT JOIN big ON kb.entry_id = big.entry_id LEFT JOIN k ON k.entry_id = big.entry_id WHERE big.entry_id IS NULL OR k.entry_id IS NOT NULL""")
def log_batch_store(spark, d):
    return W.batch(entries(spark, d)).select("topic", "ts_min", "body")


# --- sessions ---

_EV = """ev AS (SELECT event_id, ts, user_id AS key, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Bash' WHEN 'error' THEN 'Bash' WHEN 'signup' THEN 'store' ELSE 'Other' END AS tool,
 CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS ok FROM events)"""


def _sessions_sql(gap: int, more: str = "") -> str:
    return f"WITH {_EV}, g AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= CAST({gap} AS BIGINT) * 1000000 AS INTEGER), 0) AS b FROM ev WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY key ORDER BY ts, event_id) AS s FROM g) SELECT key, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY key, s {more}"


@query(_sessions_sql(4 * 3600))
def sessions_4h(spark, d):
    return Z.sessions(tool_events(spark, d)).select("key", "start", "last", "n")


@query(_sessions_sql(300, "HAVING count(*) >= 2"))
def sessions_5m_threshold(spark, d):
    return Z.busy_sessions(tool_events(spark, d), least=2).select("key", "start", "last", "n")


@query()
def phase_machine(spark, d):
    return Z.phases(tool_events(spark, d))


@query(f"WITH {_EV}, s AS (SELECT *, sum(CASE WHEN tool = 'store' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS seg FROM ev) SELECT event_id, key, CAST(row_number() OVER (PARTITION BY key, seg ORDER BY ts, event_id) AS INTEGER) AS calls FROM s")
def calls_since_store(spark, d):
    return Z.calls_since_store(tool_events(spark, d))


@query(f"WITH {_EV}, b AS (SELECT *, lag(ok) OVER (PARTITION BY key ORDER BY ts, event_id) AS p FROM ev WHERE tool = 'Bash') SELECT event_id, key FROM b WHERE ok AND NOT p")
def build_resolved(spark, d):
    return Z.resolved_builds(tool_events(spark, d))


@query(f"WITH {_EV}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts, event_id) AS gap FROM ev) SELECT event_id, key FROM g WHERE gap IS NULL OR gap >= CAST(7200 AS BIGINT) * 1000000")
def rate_limit(spark, d):
    return Z.spaced(tool_events(spark, d), 7200)


@query(f"WITH {_EV}, l AS (SELECT key, list([epoch_us(ts), event_id] ORDER BY ts, event_id) AS l FROM ev GROUP BY ALL), k AS (SELECT key, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1][1] - a[-1][1] >= CAST(7200 AS BIGINT) * 1000000 THEN list_concat(a, x) ELSE a END) AS k FROM l) SELECT x[2] AS event_id, key FROM (SELECT key, unnest(k) AS x FROM k)")
def rate_limit_exact(spark, d):
    return Z.rate_limit(tool_events(spark, d), 7200)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def periodic_hourly(spark, d):
    return Z.periodic(tool_events(spark, d), "1 hour")


@query("SELECT session, entry_id FROM (SELECT DISTINCT user_id AS session, event_id % 97 AS entry_id FROM events)")
def injected_once(spark, d):
    e = read(spark, d, "events").select("ts", F.col("user_id").alias("session"), (F.col("event_id") % 97).alias("entry_id"))
    return Z.once_per_session(e).select("session", "entry_id")


# --- prompts ---


@query(f"WITH {KB}, s AS (SELECT *, sum(strlen(topic) + 30 + strlen(source)) OVER (PARTITION BY topic ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM kb) SELECT topic, entry_id FROM s WHERE coalesce(spent, 0) < 400")
def prompt_budget(spark, d):
    return T.budgeted(entries(spark, d), F.octet_length("topic") + 30 + F.octet_length("source"), 400, ["topic"], ["entry_id"]).select("topic", "entry_id")


_CUT = "CASE WHEN strlen(x) <= 200 THEN x ELSE substr(x, 1, list_max(list_filter(range(1, 201), lambda i: strlen(substr(x, 1, i)) <= 200))) END"


@query(f"WITH {KB}, g AS (SELECT topic, count(*) AS n, arg_min(body, entry_id) AS body FROM kb GROUP BY ALL), f AS (SELECT topic, n, {_FIRST} AS x FROM g) SELECT topic, n, {_CUT} AS sample FROM f")
def drift_sample(spark, d):
    return T.drift_sample(entries(spark, d)).select("topic", "n", "sample")


@query(f"WITH {KB}, t AS (SELECT topic FROM kb GROUP BY ALL ORDER BY count(*) DESC, topic LIMIT 5) SELECT topic, entry_id, CAST(row_number() OVER (PARTITION BY topic ORDER BY ts_min, entry_id) AS INTEGER) AS age_rank FROM kb WHERE topic IN (SELECT topic FROM t)")
def stale_candidates(spark, d):
    return T.stale_candidates(entries(spark, d)).select("topic", "entry_id", "age_rank")


@query()
def generated(spark, d):
    return P.generate(P.prompt(P.synthesis(entries(spark, d), -1), "Sum up:"))
