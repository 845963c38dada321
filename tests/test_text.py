from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import text as X


def model_tokens(text: str) -> list[str]:
    out = []
    for s in re.findall(r"[A-Za-z0-9]+|[^\x00-\x7F][A-Za-z0-9\x80-\U0010ffff]*", text):
        low = s.lower()
        if len(low.encode()) < 2:
            continue
        if re.search("[A-Z]", s[1:]):
            parts, cur = [], ""
            for i, c in enumerate(s):
                if i and c.isupper():
                    parts.append(cur)
                    cur = ""
                cur += c
            out += [p.lower() for p in [*parts, cur] if len(p.lower().encode()) >= 2 and p.lower() != low]
        out.append(low)
    return out


CASES = ["", "a", "FxHashSet", "HTTPServer iOS9App", "snake_case-kebab", "café naïve", "x→y — z", "ÉcoleNormale", "日本語 text", "A1b2 C3", "I O"]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


@pytest.mark.parametrize("text", CASES)
def test_tokens(spark, text):
    assert one(spark, text, X.tokens("v")) == model_tokens(text)


def test_tokens_as_sql_function(spark):
    X.register(spark)
    for text in CASES:
        assert spark.createDataFrame([(text,)], "v string").selectExpr("kb_tokens(v) AS x").first().x == model_tokens(text)
    assert spark.sql("SELECT kb_terms('with Thin hand thin THIN') AS x").first().x == ["thin", "hand"]


def test_terms_keep_order_and_drop_stop_words(spark):
    assert one(spark, "the then with Thin the hand", X.terms("v")) == ["the", "thin", "hand"]


@pytest.mark.parametrize(("raw", "want"), [("Gaps, gap", "gap"), ("entries,classes, bus,this", "bus, class, entry, this"), ("", ""), (" ,,", ""), ("GOTCHAs", "gotcha"), ("gas,ies", "gas, ies")])
def test_normalize_tags(spark, raw, want):
    assert one(spark, raw, X.normalize_tags("v")) == want


@pytest.mark.parametrize(("raw", "want"), [("A//B", "a/b"), ("-x-/-y-/", "x/y"), ("Foo Bar!", "foo-bar"), ("é/ñ", "é/ñ"), ("---", "")])
def test_sanitize_topic(spark, raw, want):
    assert one(spark, raw, X.sanitize_topic("v")) == want


def test_metadata_last_line_wins(spark):
    body = "[tags: a, b ]\ntext\n[tags: c]\n[source: x.rs:3]\n[confidence: 0.25]\n[confidence: bad]"
    m = one(spark, body, X.metadata("v"))
    assert m.tags == ["c"] and m.source == "x.rs:3" and m.confidence == 1.0
    m = one(spark, "nothing", X.metadata("v"))
    assert m.tags == [] and m.source is None and m.confidence == 1.0


def test_truncate_keeps_characters_whole(spark):
    assert one(spark, "aéé", X.truncate_bytes("v", 2)) == "a"
    assert one(spark, "aéé", X.truncate_bytes("v", 3)) == "aé"
    assert one(spark, "abc", X.truncate_bytes("v", 9)) == "abc"


def test_timing(spark):
    for text, want in [("took 12ms", True), ("took 5ms", False), ("1.5s flat", True), ("15s", False), ("1.5second", False), ("3.2µs", True)]:
        assert one(spark, text, X.has_timing("v")) is want, text


def test_topic_matching(spark):
    rows = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a/b/c",)], "t string")
    got = {r.t: (r.m, r.d) for r in rows.select("t", X.topic_matches("t", "a").alias("m"), X.hierarchy_distance("t", "a").alias("d")).collect()}
    assert got == {"a": (True, 0), "a/b": (True, 1), "ab": (False, None), "a/b/c": (True, 2)}


def test_contains_word(spark):
    for line, want in [("call foo()", True), ("xfoo", False), ("foo_", False), ("a.foo", True)]:
        assert one(spark, line, X.contains_word(F.col("v"), F.lit("foo"))) is want


def test_dominant_term_and_first_content(spark):
    assert one(spark, "see (Alpha) and Gamma, Delta", X.dominant_term("v")) == "Delta"
    assert one(spark, "no capitals", X.dominant_term("v")) is None
    assert one(spark, "[tags: a]\n\n  first \nsecond", X.first_content("v")) == "first"
    assert one(spark, "[tags: a]", X.first_content("v")) == ""


def test_snippet(spark):
    s = one(spark, "[tags: a]\n" + "word " * 60, X.snippet(F.lit("t"), F.lit("d"), F.col("v")))
    assert s.startswith("[t] d word") and len(s) <= 120 and s.endswith("word")


def test_parse_query():
    assert X.parse_query("a tag:X b topic:t tag:Y source:") == ("a b source:", {"tag": "y", "topic": "t"})


def test_token_counter_equals_tokens(spark):
    from collections import Counter

    texts = ["FxHashSet HTTPServer iOS9App snake_case a b é éa verchö Öffen xÖy", "", "ΟΔΟΣ ΟδοςΑΒ İx K ª ßA aB", "the The THE tHe", "x" * 100 + "Y", "日本語 本A 本AB z9Z99 A1 1A", "a\nB cD\teF"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.tokens("t").alias("w")).collect()
    count = X.token_counter()
    assert {r.id: Counter(r.w) for r in rows} == {i: Counter(count(t.encode())) for i, t in enumerate(texts)}
