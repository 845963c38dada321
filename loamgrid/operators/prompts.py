"""Prompt building under a byte budget, and generation by an injected callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import text as X
from loamgrid.operators import topics as T


def synthesis(entries: DataFrame, seen: int, budget: int = 4000) -> DataFrame:
    """(topic, entry_id, line): entries after the last synthesised one, within the budget of their topic."""
    snip = X.truncate_bytes(X.first_content("body"), 200)
    e = entries.filter(F.col("entry_id") > seen).select("topic", "entry_id", snip.alias("snip"))
    kept = T.budgeted(e, F.octet_length("snip") + F.octet_length("topic") + 20, budget, ["topic"], ["entry_id"])
    return kept.select("topic", "entry_id", F.concat(F.lit("["), "topic", F.lit("] "), "snip").alias("line"))


def prompt(lines: DataFrame, instruction: str) -> DataFrame:
    """(topic, prompt): the instruction and the topic's lines in order."""
    rows = F.sort_array(F.collect_list(F.struct("entry_id", "line")))
    return lines.groupBy("topic").agg(F.concat(F.lit(instruction + "\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("prompt"))


def hashed(prompt_text: str) -> str:
    """Stand-in for a model: the prompt's digest."""
    import hashlib

    return hashlib.sha256(prompt_text.encode()).hexdigest()


def stopped(text: str, run: int = 16) -> str:
    """Text up to a character that repeats ``run`` times."""
    n = 0
    for i, c in enumerate(text):
        n = n + 1 if i and c == text[i - 1] else 1
        if n >= run:
            return text[: i - run + 2]
    return text


def generate(prompts: DataFrame, model: Callable[[str], str] = hashed) -> DataFrame:
    """(topic, answer) of each prompt by a callable, in batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"topic": b.topic, "answer": [stopped(model(p)) for p in b.prompt]})

    return prompts.select("topic", "prompt").mapInPandas(run, "topic string, answer string")
