"""Text functions as Spark expressions: tokens, tags, topics, metadata lines, snippets.

Every function takes and returns columns, so all of it stays in the JVM and is open to Catalyst.
Lengths are bytes, as the data model has them. Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SEGMENT = r"([A-Za-z0-9]+|[^\x00-\x7F][A-Za-z0-9\x{80}-\x{10FFFF}]*)"
#: Query words that say nothing.
STOP_WORDS = sorted("about after also been before both could does each from have into just more most only other same should some than that their them then there this very were when which will with would".split())
METADATA_LINE = r"^\[(tags|source|type|modified|tier|confidence|links|linked from):"
TAG_RULES = [
    ("gotcha", ("bug:", "gotcha:")),
    ("invariant", ("security:", "invariant:")),
    ("decision", ("design:", "decision:")),
    ("data-flow", ("flow:", "data flow:")),
    ("performance", ("benchmark:", "perf:")),
    ("gap", ("todo:", "missing:", "gap:")),
    ("how-to", ("fix:", "impl:", "how-to:")),
    ("module-map", ("module:",)),
    ("architecture", ("overview:",)),
    ("coupling", ("coupling:",)),
    ("pattern", ("pattern:",)),
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segments(text: Column | str) -> Column:
    """Runs of ASCII alphanumerics, or a non-ASCII character with what follows; two bytes at least."""
    return F.filter(F.regexp_extract_all(col(text), F.lit(SEGMENT), F.lit(1)), lambda s: F.octet_length(F.lower(s)) >= 2)


def camel_parts(segment: Column | str) -> Column:
    """Lower-case parts of a segment before each capital, two bytes at least; none if there is one part."""
    s = col(segment)
    parts = F.split(s, r"(?<=.)(?=\p{Lu})")
    low = F.filter(F.transform(parts, F.lower), lambda p: (F.octet_length(p) >= 2) & (p != F.lower(s)))
    return F.when(F.substring(s, 2, 1 << 30).rlike("[A-Z]"), low).otherwise(F.array().cast("array<string>"))


def tokens(text: Column | str) -> Column:
    """Array of lower-case tokens: parts of CamelCase segments, then the segment, in text order."""
    return F.flatten(F.transform(segments(text), lambda s: F.concat(camel_parts(s), F.array(F.lower(s)))))


def token_counter() -> Callable[[bytes], dict[str, int]]:
    """The tokens of a UTF-8 text with their numbers, in the order in which they are first seen, as ``tokens`` has them.

    For whole tables: a text's segments are counted first and taken apart once each, several times as
    fast as expressions that treat every token. The function returned travels to tasks by value.
    """
    import re
    import unicodedata
    from collections import Counter

    segment = re.compile("[A-Za-z0-9]+|[^\x00-\x7f][A-Za-z0-9\x80-\U0010ffff]*")
    capital = re.compile("[A-Z]")

    def count(text: bytes) -> dict[str, int]:
        found: dict[str, int] = {}
        for s, n in Counter(segment.findall(text.decode("utf-8", "replace"))).items():
            low = s.lower()
            if len(low) < 2 and low.isascii():
                continue
            if low != s and capital.search(s, 1):
                at = [0, *(i for i in range(1, len(s)) if unicodedata.category(s[i]) == "Lu"), len(s)]
                for i, j in zip(at, at[1:], strict=False):
                    part = s[i:j].lower()
                    if part != low and (len(part) > 1 or not part.isascii()):
                        found[part] = found.get(part, 0) + n
            found[low] = found.get(low, 0) + n
        return found

    return count


def terms(query: Column | str) -> Column:
    """Distinct tokens of a query without stop words, in first-seen order."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(tokens(query), lambda t: ~F.array_contains(stop, t)))


def long_terms(text: Column | str) -> Column:
    """Distinct tokens of three bytes or more, which duplicate checks compare."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.octet_length(t) >= 3))


def trim(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def lines(text: Column | str) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    t = col(text)
    return F.split(F.regexp_replace(t, r"\n\z", ""), r"\r?\n")


def is_metadata_line(line: Column) -> Column:
    return line.rlike(METADATA_LINE)


def content_lines(body: Column | str) -> Column:
    """Trimmed lines that are neither blank nor metadata."""
    kept = F.filter(lines(body), lambda s: ~is_metadata_line(s) & (trim(s) != ""))
    return F.transform(kept, trim)


def first_content(body: Column | str) -> Column:
    """The first content line; empty if there is none. All lines are looked at only if the first eight have none."""
    few = F.get(content_lines(F.substring_index(col(body), "\n", 8)), F.lit(0))
    return F.coalesce(few, F.get(content_lines(body), F.lit(0)), F.lit(""))


def metadata(body: Column | str) -> Column:
    """Struct of tags, source and confidence (1.0 unless given); the last line of a kind wins."""
    b = col(body)

    def last(kind: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(b, F.lit(rf"(?m)^\[{kind}: (.*)\]\r?$"), F.lit(1)), F.lit(-1))

    tags = F.filter(F.transform(F.split(last("tags"), ","), trim), lambda t: t != "")
    return F.struct(
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        trim(last("source")).alias("source"),
        F.coalesce(trim(last("confidence")).try_cast("double"), F.lit(1.0)).alias("confidence"),
    )


def truncate_bytes(text: Column | str, n: int) -> Column:
    """At most n bytes, cut before a character that would not fit."""
    cut = F.make_valid_utf8(F.substring(col(text).cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(col(text)) <= n, col(text)).otherwise(F.regexp_replace(cut, "�+$", ""))


def snippet(topic: Column | str, date: Column | str, body: Column | str, limit: int = 120) -> Column:
    """``[topic] date`` and the first two content lines, at most ``limit`` bytes, cut at a space."""
    full = F.concat(F.lit("["), col(topic), F.lit("] "), col(date), F.lit(" "), F.array_join(F.slice(content_lines(body), 1, 2), " "))
    short = truncate_bytes(full, limit)
    whole = F.regexp_extract(short, r"(?s)^(.*) ", 1)
    return F.when(F.octet_length(full) <= limit, full).otherwise(F.when(whole != "", whole).otherwise(short))


def singularize(word: Column | str) -> Column:
    w = col(word)
    n = F.octet_length(w)
    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies") & (n >= 5), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y")))
        .when(w.endswith("sses"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def normalize_tags(raw: Column | str) -> Column:
    """Comma-separated tags: singular, lower case, sorted, once each."""
    parts = F.transform(F.split(col(raw), ","), lambda t: F.lower(singularize(trim(t))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != ""))), ", ")


def auto_tags(text: Column | str) -> Column:
    """Tags that the prefix of the first non-blank line stands for; null if none."""
    first = F.lower(F.coalesce(F.get(F.filter(F.transform(lines(text), trim), lambda s: s != ""), F.lit(0)), F.lit("")))
    found = [F.when(reduce(lambda a, b: a | b, [first.startswith(p) for p in prefixes]), F.lit(tag)) for tag, prefixes in TAG_RULES]
    joined = F.concat_ws(", ", *found)
    return F.when(joined != "", joined)


def build_body(text: Column, tags: Column, source: Column, confidence: Column, links: Column) -> Column:
    """A body with its metadata lines in front; absent ones (null, or full confidence) leave no line."""
    def line(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"[{kind}: "), value.cast("string"), F.lit("]")))

    return F.concat_ws("\n", line("tags", tags), line("source", source), F.when(confidence < 1, line("confidence", confidence)), line("links", links), text)


def sanitize_topic(topic: Column | str) -> Column:
    """Lower case; other than letters, digits, ``-`` and ``/`` become ``-``; no empty or dash-edged levels."""
    t = F.regexp_replace(F.lower(col(topic)), r"[^\p{L}\p{N}/-]", "-")
    parts = F.transform(F.split(t, "/"), lambda p: F.regexp_replace(p, "^-+|-+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def topic_matches(topic: Column | str, query: str) -> Column:
    """The topic itself or one below it."""
    t = col(topic)
    return (t == query) | t.startswith(query + "/")


def hierarchy_distance(topic: Column | str, query: str) -> Column:
    """0 for the topic itself, the number of levels below it plus nothing else, null outside."""
    t = col(topic)
    return F.when(t == query, F.lit(0)).when(t.startswith(query + "/"), F.size(F.split(t, "/")) - F.lit(len(query.split("/"))))


def glob_to_like(pattern: str) -> str:
    """``*`` wildcards as a LIKE pattern; a pattern without one means contains."""
    p = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return p.replace("*", "%") if "*" in p else f"%{p}%"


def contains_word(line: Column, word: Column) -> Column:
    """The word stands in the line with no identifier character at either side."""
    return F.rlike(line, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E(?![A-Za-z0-9_])")))


def has_timing(line: Column | str) -> Column:
    """A duration such as 12ms or 1.5s; one digit directly before the unit is not enough."""
    return col(line).rlike(r"[0-9][0-9.]+(ms|µs|us|ns)|[0-9][0-9.]*\.[0-9.]*s(?![A-Za-z0-9])")


def dominant_term(line: Column | str) -> Column:
    """The longest capitalised word of three bytes or more, the last of equals; null if none."""
    words = F.transform(F.split(trim(line), r"(?U)\s+"), lambda w, i: F.struct(F.octet_length(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("n"), i.alias("at"), F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("w")))
    return F.array_max(F.filter(words, lambda s: (s["n"] >= 3) & s["w"].rlike(r"^\p{Lu}")))["w"]


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays of distinct values, as a double; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0.0)), F.lit(0.0))


def parse_query(query: str) -> tuple[str, dict[str, str]]:
    """Free words of a query and its ``tag:``, ``topic:`` and ``source:`` filters, the last of a kind."""
    found: dict[str, str] = {}
    rest = []
    for word in query.split():
        kind, colon, value = word.partition(":")
        if colon and value and kind in ("tag", "topic", "source"):
            found[kind] = value.lower() if kind == "tag" else value
        else:
            rest.append(word)
    return " ".join(rest), found


def register(spark: SparkSession) -> None:
    """SQL functions of the text analysis, as pure SQL expressions: kb_tokens, kb_terms."""
    seg = "filter(regexp_extract_all(t, '([A-Za-z0-9]+|[^\\\\x00-\\\\x7F][A-Za-z0-9\\\\x{80}-\\\\x{10FFFF}]*)', 1), s -> octet_length(lower(s)) >= 2)"
    camel = "if(substring(s, 2) rlike '[A-Z]', filter(transform(split(s, '(?<=.)(?=\\\\p{Lu})'), p -> lower(p)), p -> octet_length(p) >= 2 and p <> lower(s)), array())"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kb_tokens(t STRING) RETURNS ARRAY<STRING> RETURN flatten(transform({seg}, s -> concat({camel}, array(lower(s)))))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kb_terms(q STRING) RETURNS ARRAY<STRING> RETURN array_distinct(filter(kb_tokens(q), w -> not array_contains(array({stop}), w)))")
