"""Language identification: known words first, then ever shorter character n-grams.

Training counts words and the character n-grams (1 to 5, words marked ``^word$``) of the labelled
documents per language. A word is a run of letters and combining marks that holds a letter. A
text's score for a language is the sum, over its words, of the word's log frequency there; a word
never seen is scored by its n-grams of the greatest length of which any is known, averaged so that
each word weighs alike. Words and n-grams are handled as hashes of their characters, whole batches
of texts at once.

The training documents may be a sample: at most about ``max_docs`` per language, chosen by a hash
of the id, always with their whole texts. All words and n-grams of the sample are kept, those seen
once too, whatever its size. Prediction reads every whole text and nothing else.

Edge cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; so
is everything if no labelled text has a letter. Equal scores go to the language first in
alphabetical order. Null ids are held out or not as the empty string is; repeated ids and rows are
rows like any other and get results of their own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm._core import byte_views, crc_mod, prefix_hash, released, row_chunks, share, span_hash, table, worker_state

MAX_DOCS, MAX_ORDER, SMOOTH = 2000, 5, 0.1
#: Words that a task remembers beyond the trained ones; forgetting some costs time only.
MAX_REMEMBERED = 200_000
#: Bytes of text that are handled at once.
CHUNK = 1 << 19
_SPREAD = 1 << 32


def _classes() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if a combining mark, else 0."""
    state = worker_state("letters")
    if not hasattr(state, "classes"):
        kinds = {"L": 2, "M": 1}
        state.classes = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    return state.classes


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, first and end of each word, its row)."""
    lowered = [t.lower() + "\n" for t in texts]
    codes = _codes(lowered)
    kind = _classes()[codes]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = kind > 0
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    letters = np.concatenate([[0], np.cumsum(kind == 2)])
    real = letters[end] > letters[start]
    start, end = start[real], end[real]
    bounds = np.cumsum([len(t) for t in lowered])
    return codes, start, end, np.searchsorted(bounds, start, side="right")


def gram_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words, marked for n > 1, and each one's word."""
    mark = int(n > 1)
    size = end - start + 2 * mark
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    word = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(flat)) - begin[word] - mark
    inner = (at >= 0) & (at < (end - start)[word])
    flat[inner] = codes[start[word[inner]] + at[inner]]
    if mark:
        flat[begin], flat[begin + size - 1] = ord("^"), ord("$")
    p = np.flatnonzero(at + mark <= (size - n)[word])
    return span_hash(prefix_hash(flat), p, p + n), word[p]


def hashes(grams: list[str]) -> np.ndarray:
    """Hash of each string."""
    end = np.cumsum([len(g) for g in grams])
    return span_hash(prefix_hash(_codes(grams)), end - [len(g) for g in grams], end)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, row = np.unique(keys, return_inverse=True)
    return keys, np.bincount(row, n, len(keys)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of chunks of the column; nulls are empty."""
    for a, b in row_chunks(byte_views(column)[1], CHUNK):
        yield a, [v or "" for v in column.slice(a, b - a).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, ord, h, n): order 0 are words, 1 to MAX_ORDER n-grams; summed within chunks."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = np.asarray(langs.indices)
        for a, texts in _texts(batch.column(1)):
            codes, start, end, row = words(texts)
            whole = span_hash(prefix_hash(codes), start, end)
            lang = code[a + row]
            for k in np.unique(lang):
                mine = np.flatnonzero(lang == k)
                keys, first, inverse = np.unique(whole[mine], return_index=True, return_inverse=True)
                n = np.bincount(inverse).astype(np.int64)
                s, e = start[mine[first]], end[mine[first]]
                found = [(0, keys, n)]
                for order in range(1, MAX_ORDER + 1):
                    h, word = gram_hashes(codes, s, e, order)
                    found.append((order, *_sums(h, n[word])))
                name = langs.dictionary[int(k)].as_py()
                size = sum(len(x[1]) for x in found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), pa.array(np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in found])), pa.array(np.concatenate([x[1] for x in found]).view(np.int64)), pa.array(np.concatenate([x[2] for x in found]))], ["lang", "ord", "h", "n"])


class _Keys:
    """Row of each known gram: its place among the sorted hashes."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.hashes = sorted_hashes

    def __len__(self) -> int:
        return len(self.hashes)

    def rows(self, want: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 for those not known."""
        if not len(self.hashes):
            return np.full(len(want), -1)
        i = np.minimum(np.searchsorted(self.hashes, want), len(self.hashes) - 1)
        return np.where(self.hashes[i] == want, i, -1)

    def find(self, grams: list[str]) -> np.ndarray:
        """Rows of those grams that are known."""
        i = self.rows(hashes(grams))
        return i[i >= 0]

    def __getitem__(self, gram: str) -> int:
        found = self.find([gram])
        if not len(found):
            raise KeyError(gram)
        return int(found[0])


class Model:
    """Log frequencies of words and n-grams by language, in rows sorted by the keys' hashes."""

    def __init__(self, rows: Sequence[tuple[str, int, str, int]]):
        lang, order, key, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        self._fill(list(lang), np.array(order, np.int32), hashes(list(key)) if key else np.zeros(0, np.uint64), np.array(n, np.int64))

    @classmethod
    def of(cls, t: pa.Table) -> Model:
        """From a table of lang, ord, h (the key's hash) and n."""
        model = cls.__new__(cls)
        model._fill(t.column("lang"), np.asarray(t.column("ord")), np.asarray(t.column("h")).view(np.uint64), np.asarray(t.column("n")))
        return model

    def _fill(self, lang, order: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
        coded = pa.chunked_array([lang if isinstance(lang, list) else lang.combine_chunks()], pa.string()).combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.langs = sorted(names)
        at = np.array([self.langs.index(x) for x in names], np.int64)[np.asarray(coded.indices)]
        self.at: list[_Keys] = []
        self.logs: list[np.ndarray] = []
        for o in range(MAX_ORDER + 1):
            mine = order == o
            keys, row = np.unique(key[mine], return_inverse=True)
            counts = np.zeros((len(keys), len(self.langs)), np.float32)
            np.add.at(counts, (row, at[mine]), n[mine])
            total = counts.sum(axis=0, dtype=np.float64)
            self.at.append(_Keys(keys))
            self.logs.append(np.log((counts + np.float32(SMOOTH)) / (total + SMOOTH * max(1, len(keys))).astype(np.float32)))

    def word(self, w: str) -> np.ndarray:
        codes = _codes([w])
        return self.scores(codes, np.array([0]), np.array([len(codes)]), hashes([w]))[0]

    def scores(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """A row of log frequencies for each word, of which ``whole`` has the hashes."""
        out = np.zeros((len(start), len(self.langs)), np.float32)
        row = self.at[0].rows(whole)
        out[row >= 0] = self.logs[0][row[row >= 0]]
        open_ = np.flatnonzero(row < 0)
        for n in range(MAX_ORDER, 0, -1):
            if not len(open_):
                break
            h, word = gram_hashes(codes, start[open_], end[open_], n)
            row = self.at[n].rows(h)
            word, row = word[row >= 0], row[row >= 0]
            if not len(row):
                continue
            first = np.flatnonzero(np.diff(word, prepend=-1))
            many = np.diff(np.append(first, len(word))).astype(np.float32)
            out[open_[word[first]]] = np.add.reduceat(self.logs[n][row], first, axis=0) / many[:, None]
            open_ = np.delete(open_, word[first])
        return out


class _Memory:
    """Scores of the words that tasks have met, sorted by hash."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.matrix = _Keys(np.zeros(0, np.uint64)), np.zeros((0, len(self.model.langs)), np.float32)

    def scores(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> np.ndarray:
        out = np.empty((len(whole), len(self.model.langs)), np.float32)
        row = self.keys.rows(whole)
        out[row >= 0] = self.matrix[row[row >= 0]]
        new = np.flatnonzero(row < 0)
        out[new] = self.model.scores(codes, start[new], end[new], whole[new])
        if len(self.keys) + len(new) > MAX_REMEMBERED:
            self._forget()
        every = np.concatenate([self.keys.hashes, whole[new]])
        order = np.argsort(every, kind="stable")
        self.keys, self.matrix = _Keys(every[order]), np.concatenate([self.matrix, out[new]])[order]
        return out


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Model of the labelled rows of ``docs`` (text, lang, doc_id)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(_SPREAD * min(1.0, max_docs / n)))])
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD))
    chosen = rows.filter(spread < share[F.col("lang")]).select("lang", "text")
    counted = chosen.mapInArrow(released(_count), "lang string, ord int, h long, n long").groupBy("lang", "ord", "h").agg(F.sum("n").alias("n"))
    return Model.of(counted.select("lang", "ord", "h", "n").toArrow())  # whatever the sample holds is kept


def predict(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) from the text alone; with ``keep`` also the text and those columns."""
    shared = share(docs.sparkSession, model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        memory = _Memory(model)
        for batch in batches:
            pred = np.full(batch.num_rows, len(model.langs))
            score = np.zeros(batch.num_rows)
            for a, texts in _texts(batch.column(1)) if model.langs else ():
                codes, start, end, row = words(texts)
                if not len(row):
                    continue
                keys, some, inverse = np.unique(span_hash(prefix_hash(codes), start, end), return_index=True, return_inverse=True)
                each = memory.scores(codes, start[some], end[some], keys).astype(np.float64)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                total = np.add.reduceat(each[inverse], first, axis=0)
                best = total.argmax(axis=1)
                pred[a + row[first]] = best
                score[a + row[first]] = 1.0 / np.exp(np.maximum(total - total.max(axis=1)[:, None], -700)).sum(axis=1)
            named = pa.array([*model.langs, "und"], pa.string()).take(pa.array(pred))
            kept = [] if keep is None else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([batch.column(0), named, pa.array(score), *kept], names)

    source = docs.select("doc_id", "text", *(keep or ()))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + ([] if keep is None else source.schema.fields[1:]))
    names = schema.names
    return source.mapInArrow(released(run), schema)


def identify(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows held out (crc32 of the id mod 4 is 2) teach nothing."""
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.filter(~held), max_docs)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
