"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Statistics of each whole text (word, symbol, capital, digit and sentence rates, repeated lines and
words) are Spark expressions. Boosted trees on a labelled sample propose conjunctive rules, the
paths to their nodes; an L1-penalised logistic regression keeps few of them and weighs them. What
remains is one Spark column: the logistic function of a sum of weighted conditions. Scoring runs
wholly in the JVM.

Labels come from a sample of at most about ``max_rows`` labelled documents, chosen by a hash of
the id and broadcast.

Edge cases: null and empty texts have all statistics zero and are scored by the rules that zeros
meet; documents without a label are scored alike; several labels of one document count as the
highest; without labels of both kinds every score is the base rate (0.5 without any); null ids are
scored and have no label; rows that share an id share its labels and are scored by their own texts; a
score of 0.5 is predicted 1, so the tie goes to good; texts of any length are read whole; repeated rows
get equal results; an empty table gives an empty result; extra columns are ignored.

Size of the model, whatever the corpus: the ``MAX_RULES`` shortest rules go to the lasso.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm._core import crc_mod, table
from loamgrid.llm._trees import Boosted

MAX_ROWS, MAX_RULES = 16_000, 400
_SPREAD = 1 << 32


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name. Counts come first; rates refer to them by name (``_n_...``)."""
    t = F.coalesce(text, F.lit(""))
    return {
        "_n_chars": F.length(t),
        "_n_words": F.regexp_count(t, F.lit(r"\S+")),
        "_n_symbols": F.regexp_count(t, F.lit(r"[#$%&*|!<>{}=~^@\\/+]+")),
        "_n_capitals": F.regexp_count(t, F.lit(r"\b\p{Lu}{2,}")),
        "_n_digits": F.regexp_count(t, F.lit(r"\d+")),
        "_n_stops": F.regexp_count(t, F.lit(r"[.?]")),
        "_lines": F.split(t, "\n"),
        "_words": F.split(t, r"\s+"),
    }


def rates() -> dict[str, Column]:
    """The features, from the columns of ``statistics``."""
    words = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    lines = F.size("_lines").cast("double")
    return {
        "n_chars": F.col("_n_chars").cast("double"),
        "n_words": F.col("_n_words").cast("double"),
        "word_length": F.col("_n_chars") / words,
        "symbols": F.col("_n_symbols") / words,
        "capitals": F.col("_n_capitals") / words,
        "digits": F.col("_n_digits") / words,
        "stops": F.col("_n_stops") / words,
        "line_words": words / lines,
        "line_repeats": 1.0 - F.size(F.array_distinct("_lines")) / lines,
        "word_repeats": 1.0 - F.size(F.array_distinct("_words")) / F.size("_words").cast("double"),
    }


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each whole text."""
    s = docs.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    return s.select("doc_id", *[c.alias(n) for n, c in rates().items()])


Rule = tuple[tuple[int, bool, float], ...]


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, low, cut in rule:
        ok &= (x[:, f] <= cut) == low
    return ok


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights and free intercept, by accelerated proximal gradient."""
    n, m = r.shape
    rate = 4.0 / (np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n)
    w, b = np.zeros(m), 0.0
    v, c = w.copy(), b
    for k in range(steps):
        g = 1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y
        w2 = v - rate * (r.T @ g) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * g.mean()
        q = k / (k + 3)
        v, c = w2 + q * (w2 - w), b2 + q * (b2 - b)
        w, b = w2, b2
    return w, float(b)


class Model:
    """Weighted rules over named features."""

    def __init__(self, names: list[str], rules: list[Rule], weights: list[float], bias: float):
        self.names, self.rules, self.weights, self.bias = names, rules, weights, bias

    def column(self) -> Column:
        """The score as a Spark expression over the features."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            held = F.lit(True)
            for f, low, cut in rule:
                c = F.col(self.names[f])
                held = held & ((c <= cut) if low else (c > cut))
            z = z + F.when(held, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{self.names[f]} {'<=' if low else '>'} {cut:.4g}" for f, low, cut in r) for r, w in zip(self.rules, self.weights, strict=True)]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 1e-3, max_rules: int = MAX_RULES) -> Model:
    """Rule ensemble of a feature matrix and 0/1 labels."""
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9))
        return Model(names, [], [], float(np.log(rate / (1 - rate))))
    boosted = Boosted(x, y, trees=25, depth=3)
    seen: dict[bytes, Rule] = {}
    for rule in sorted({p for t in boosted.trees for p in t.paths()}, key=lambda p: (len(p), p)):
        held = _holds(x, rule)
        if 0 < held.sum() < len(x):
            seen.setdefault(np.packbits(held).tobytes(), rule)  # rules that hold alike are one
    rules = list(seen.values())[:max_rules]
    r = np.stack([_holds(x, rule) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    if not rules:
        rate = float(y.mean())
        return Model(names, [], [], float(np.log(rate / (1 - rate))))
    w, b = lasso(r, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(names, [rules[i] for i in keep], [float(w[i]) for i in keep], b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows (doc_id, ``label``) of ``docs``."""
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD)) < int(_SPREAD * min(1.0, max_rows / max(1, total))))
    names = list(rates())
    # about max_rows ids at most are broadcast, and as many rows of ten numbers come back
    rows = featurise(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")
    t = rows.orderBy("doc_id").select("y", *names).toArrow()
    x = np.stack([np.asarray(t.column(n)) for n in names], axis=1) if t.num_rows else np.zeros((0, len(names)))
    return fit(x, np.asarray(t.column("y")).astype(float), names)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out rows (crc32 of the id mod 3 is 1) teach nothing."""
    held = crc_mod("doc_id", 3) == 1
    model = train(docs, labels.filter(~held), max_rows=max_rows)
    return featurise(docs).select("doc_id", held.alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
