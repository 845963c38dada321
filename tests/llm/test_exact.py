"""Operators with one right answer, against brute force: op1, op3, op6, op7, op10."""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import bpe, decontaminate, embeddings, simhash, suffix
from tests.conftest import SF

DOCS = "doc_id long, text string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# --- op1 ---


def brute_vectors(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))
    for s, a in enumerate(ok):
        for b in ok[s + 1 :]:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                n[a] += 1
                n[b] += 1
                parent[find(parent, a)] = find(parent, b)
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(rows):
        r = find(parent, i)
        least[r] = min(k, least.get(r, k))
    return sorted((k, n[i], least[find(parent, i)], k == least[find(parent, i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize(("dim", "spread", "chunk"), [(16, 0.05, 8192), (16, 0.05, 9), (2, 0.05, 8192), (1, 0.1, 5)])
def test_embeddings(spark, dim, spread, chunk):
    rng = np.random.default_rng(dim)
    v = []
    for _ in range(12):
        u = rng.normal(size=dim)
        v += [[float(np.float32(x)) for x in u + rng.normal(size=dim) * spread * np.linalg.norm(u)] for _ in range(9)]
    v += v[:7] + [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [None] * dim, [1.0] * (dim + 1), [1.0] * (dim + 1)]
    rng.shuffle(order := np.arange(len(v)))
    rows = [(int(i), v[j]) for i, j in enumerate(order)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, data string, n int")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df, chunk=chunk).collect())
    assert got == brute_vectors(rows)


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- op3 ---


@pytest.fixture(scope="module")
def tik():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    tokens = bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {t: i for i, t in enumerate(tokens) if t}
    return tokens, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "a", "the then", "l'été déjà  vu\n\n x", "日本語のテキスト русский", "\x00\x1f\x85 ", "<|endoftext|>", "aaaa" * 3000 + " " * 500 + "-" * 999, "x" * 40_000, "🙂👩‍👩‍👧", "don't we'll 12345"]


def test_bpe_round_trip(spark, tik):
    _, enc = tik
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("abcdeéñ \n日12-'s") for _ in range(r.randrange(200))) for _ in range(200)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in bpe.digest(spark.createDataFrame([*rows, rows[5]], DOCS + ", n_tokens string").repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())), repr(t)[:50]
    both = bpe.decode(bpe.encode(spark.createDataFrame(rows[:40], DOCS + ", k string")).drop("text"))
    assert {x.doc_id: x.text for x in both.collect()} == {i: t or "" for i, t, _ in rows[:40]}
    assert bpe.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_transducer_small_tables(tik, monkeypatch):
    tokens, enc = tik
    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 7)
    fst = bpe.Transducer(tokens)
    r = random.Random(5)
    for _ in range(60):
        piece = bytes(r.choice(b"abcdest \xc3\xa9") for _ in range(r.randrange(1, 400)))
        assert fst.encode(piece) == ([fst.rank[piece]] if piece in fst.rank else fst.merge(piece))


def test_utf8_machine(tik):
    r = random.Random(6)
    for _ in range(500):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xC0]) for _ in range(r.randrange(12)))
        m = bpe.Utf8Machine()
        assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.finish() == data.decode("utf-8", "replace")


# --- op6 ---


def brute_print(text):
    xxhash = pytest.importorskip("xxhash")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    r = random.Random(7)
    base = [" ".join(r.choice(["Alpha", "beta", "été", "x", "y1"]) for _ in range(r.randrange(1, 120))) for _ in range(25)]
    texts = [None, "", " \t\n", "one", "one two", "a\x00b c d"] + base
    for b in base:
        w = b.split()
        w[r.randrange(len(w))] = "zz"
        texts += [" ".join(w), b.upper(), b]
    rows = [(i, t, 9) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows, DOCS + ", fp int").repartition(3)).collect()}
    f = [brute_print(t) for t in texts]
    near, parent = [0] * len(f), list(range(len(f)))
    for a in range(len(f)):
        for b in range(a + 1, len(f)):
            if (f[a] ^ f[b]).bit_count() <= 3:
                near[a] += 1
                near[b] += 1
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    for i in range(len(f)):
        assert (got[i].fingerprint, got[i].n_near, got[i].component_id) == (f"{f[i]:016x}", near[i], find(parent, i)), i
        assert simhash.fingerprint(texts[i]) == f[i]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_golay_links(spark):
    r = random.Random(8)
    fps = {0, 2**64 - 1}
    for _ in range(150):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(3):
            y = x
            for b in r.sample(range(64), r.randrange(1, 5)):
                y ^= 1 << b
            fps.add(y)
    s = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(x,) for x in s], "fp long")).collect()}
    mask = 2**64 - 1
    assert got == {(a, b) for i, a in enumerate(s) for b in s[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}
    error, _ = simhash._decoder()
    assert (error >= 0).all()  # the code is perfect: every syndrome has its pattern


# --- op7 ---


def brute_leaks(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            b = words(x)
            n = min(13, len(b))
            if not n:
                continue
            windows = {tuple(b[p : p + n]) for p in range(len(b) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found.add("" if k is None else str(k))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination(spark, bound):
    r = random.Random(9)

    def text(n):
        return "".join(r.choice(["a", "b", "é", "C1", "zz"]) + r.choice([" ", "-", "\n", ".. "]) for _ in range(n))

    items = [(k, text(r.choice([0, 1, 4, 7, 12, 13, 14, 30]))) for k in range(20)] + [(3, None), (None, text(15))]
    docs = [(i, text(r.randrange(60)) + (r.choice(items)[1] or "") + text(r.randrange(20))) for i in range(120)] + [(900, None), (901, ""), (902, "-- \n"), (903, text(30_000))]
    d = spark.createDataFrame([(*x, "h") for x in docs], DOCS + ", h string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_hit int")
    got = sorted(tuple(x) for x in decontaminate.contamination(d, b, max_broadcast_words=bound).collect())
    assert got == brute_leaks(docs, items)
    kept = decontaminate.contamination(d, b, max_broadcast_words=bound, keep=("text", "h"))
    assert kept.count() == len(docs) and {x.h for x in kept.select("h").distinct().collect()} == {"h"}
    none = decontaminate.contamination(d, b.limit(0), max_broadcast_words=bound)
    assert none.filter("contaminated").count() == 0 and none.count() == len(docs)
    assert decontaminate.contamination(d.limit(0), b, max_broadcast_words=bound).count() == 0


# --- op10 ---


def brute_repeats(docs, n):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        out[i] = gone
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_suffix_dedup(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", crowd)
    r = random.Random(10)
    parts = ["".join(r.choice("abcdeé \n") for _ in range(r.randrange(100, 400))) for _ in range(10)]
    docs = [(7000, None), (7001, ""), (7002, "short"), (7003, "é" * 5000), (7004, "ab" * 300), (7005, "\x00" * 150)]
    for i in range(110):
        t = ""
        for _ in range(r.randrange(0, 5)):
            t += r.choice(parts)[r.randrange(0, 60) :] if r.random() < 0.6 else "".join(r.choice("abcdeé \n") for _ in range(r.randrange(200)))
        docs.append((i, t))
    want = brute_repeats(docs, 100)
    df = spark.createDataFrame([(*x, "c", 3) for x in [*docs, docs[20]]], DOCS + ", h string, size int").repartition(4)
    got = suffix.dedup(df).collect()
    assert len(got) == len(docs) + 1
    texts = dict(docs)
    for x in got:
        b, gone = (texts[x.doc_id] or "").encode(), want[x.doc_id]
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())), x.doc_id
    kept = suffix.dedup(df, text_out=True, keep=("h",)).collect()
    assert len(kept) == len(docs) + 1 and {x.h for x in kept} == {"c"}
    assert suffix.dedup(df.limit(0)).count() == 0


def test_run_index_statistics():
    r = random.Random(11)
    for _ in range(60):
        codes = np.array([r.choice([0, 1, 1, 2, 3]) for _ in range(80)] + [0], np.uint8)
        index = suffix.RunIndex(codes)
        order, (matched, got) = suffix.suffix_order(codes)[0], index.matches()
        assert not hasattr(index, "order") and (matched[order[1:]] == order[:-1]).all()
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while a + n < len(codes) and b + n < len(codes) and codes[a + n] == codes[b + n] != 0:
                n += 1
            assert got[b] == n
        assert len(index.runs) <= len(codes)


def test_connected_components_in_rounds(spark):
    from loamgrid.llm._core import components

    r = random.Random(12)
    edges = [(a, a + r.choice([1, 1, 7])) for a in range(0, 300) if r.random() < 0.8]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    want = {(x, find(parent, x)) for x in parent if find(parent, x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for bound in (2_000_000, 5):
        assert {(x.node, x.component) for x in components(df, one_task=bound).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_queries_run_on_tables(spark):
    for q in (embeddings.query, bpe.query, simhash.query, decontaminate.query, suffix.query):
        df = q(spark, SF)
        assert df.count() == spark.read.parquet(f"{SF}/{'embeddings' if q is embeddings.query else 'documents'}.parquet").count()
        assert df.filter(F.col(df.columns[0]).isNull()).count() == 0


def test_decontamination_compares_words(spark):
    """Words whose polynomial hashes modulo 2**64 are equal are told apart, by both ways."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    items = [(1, f"{t} {rest}"), (2, f"{other} {rest}"), (3, f"{t} one"), (4, f"{other} one")]
    docs = [(1, f"x {t} {rest} y"), (2, f"x {other} {rest} y"), (3, f"{other} one"), (4, "x"), (4, f"{t} one"), (None, f"{t} one"), (None, "y")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for bound in (10**6, 0):
        got = [tuple(x) for x in decontaminate.contamination(d, b, max_broadcast_words=bound).collect()]
        assert sorted(got, key=repr) == sorted(brute_leaks_any(docs, items), key=repr)


def brute_leaks_any(docs, items):
    return [brute_leaks([x], items)[0] for x in docs]


def test_decontamination_with_a_common_preamble(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    lead = " ".join(word() for _ in range(20))
    items = [(i, f"{lead} {i} " + " ".join(word() for _ in range(15))) for i in range(10_000)]
    index = decontaminate.Index(pa.array([t for _, t in items]), [str(i) for i, _ in items])
    docs = decontaminate.Words(*decontaminate.byte_views(pa.array([f"so {lead} it is"] * 300)))
    s, _, c = index.find(docs)
    assert len(s) == 300 * 8 and len(index.items(np.unique(c))) == 10_000  # a row a window, not a row an item
    d = spark.createDataFrame([(1, f"so {lead} it is"), (2, items[77][1])], DOCS)
    got = {x.doc_id: x for x in decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1].n_items, got[1].n_hit, got[2].n_items) == (10_000, 20, 10_000)
    assert got[1].items_sha256 == sha(",".join(sorted(str(i) for i, _ in items)).encode())


def test_simhash_on_workers_without_the_package(tmp_path):
    """Operators travel by value: the workers' path doesn't hold the repository."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from loamgrid.llm import bpe, decontaminate, langid, simhash, suffix
sys.path.pop(0)
spark = SparkSession.builder.config(map={{"spark.master": "local-cluster[1,2,1024]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://{tmp_path}/c", "spark.executor.memory": "700m"}}).getOrCreate()
d = spark.createDataFrame([(i, "w%d some words that stand here" % (i % 3), "xx") for i in range(9)], "doc_id long, text string, lang string")
assert simhash.near_duplicates(d).count() == 9 and simhash.survivors(d).count() <= 3
assert suffix.dedup(d).count() == 9 and langid.identify(d).count() == 9
assert decontaminate.contamination(d, d.selectExpr("doc_id item_id", "text").limit(2)).filter("contaminated").count() == 6
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    import pyspark

    env["SPARK_SCALA_VERSION"], env["SPARK_HOME"] = "2.13", str(Path(pyspark.__file__).parent)
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("done"), got.stderr[-3000:]


@pytest.mark.parametrize(("hot", "crowd"), [(64, 4096), (2, 4096), (2, 2)])
def test_suffix_dedup_of_null_shared_and_repeated_ids(spark, monkeypatch, hot, crowd):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", crowd)
    r = random.Random(41)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q = text(300), text(160)
    rows = [(1, p), (7, text(400) + p), (7, p + text(419)), (7, p + q), (None, text(200) + q), (None, q), (None, None), (8, "x" + q), (8, "x" + q), (9, ""), (9, None)]
    rows += [(100 + i % 40, text(90) + p[i : i + 150] + text(90)) for i in range(120)]
    rows += rows[20:24]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], DOCS + ", id string, key int").repartition(5)
    # rows as documents of their own: by id, nulls first, then in any order of the texts, here Spark's
    hashed = {x.text: x.h for x in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    of = sorted({(i is not None, i or 0, hashed[t], t or "") for i, t in rows})
    want = brute_repeats([(k, t) for k, (*_, t) in enumerate(of)], 100)
    number = {(a, i, t): k for k, (a, i, _, t) in enumerate(of)}
    expect = sorted((i is not None, i or 0, len((t or "").encode()), int((g := want[number[i is not None, i or 0, t or ""]]).sum()), sha(np.frombuffer((t or "").encode(), np.uint8)[~g].tobytes())) for i, t in rows)
    got = suffix.dedup(df).collect()
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_bytes, x.n_removed, x.kept_sha256) for x in got) == expect
    assert sum(x.n_removed for x in got if x.doc_id == 7) == 3 * 300 + 160


def test_suffix_dedup_of_a_short_line_in_many_texts(spark, monkeypatch):
    """Its contexts share no string of 100 bytes, so none of them needs its strings listed."""
    monkeypatch.setattr(suffix, "BLOCK_CONTEXTS", 20)
    monkeypatch.setattr(suffix, "_strings", lambda length: pytest.fail("strings of a line's contexts"))
    r = random.Random(42)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, passage = text(80), text(130)
    docs = [(i, text(120) + line + text(120) + passage * (i % 20 == 0) + text(9)) for i in range(200)]
    want = brute_repeats(docs, 100)
    got = suffix.dedup(spark.createDataFrame(docs, DOCS).repartition(4)).collect()
    assert {x.doc_id: x.n_removed for x in got} == {i: int(g.sum()) for i, g in want.items()}
    assert sum(x.n_removed for x in got) >= 9 * 130


@pytest.mark.parametrize("most", [1, 3, 100])
@pytest.mark.parametrize("size", [1, 4, 1000])
def test_suffix_index_by_core(most, size):
    """Parts of one core are compared whole, however they lie in batches; sent on are those of cores with too many."""
    r = random.Random(43)
    texts = ["".join(r.choice("ab") for _ in range(12)) for _ in range(12)]
    parts = [("xyz" * 3)[: r.randrange(2, 9)] for _ in range(5)]
    rows = sorted({(r.randrange(8), (r.choice(parts) + r.choice(texts)).encode(), r.randrange(30), 0, 100 * r.randrange(3)) for _ in range(150)})
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[x[k] for x in rows] for k in (0, 2, 3, 4, 1)], [pa.int64()] * 4 + [pa.binary()], strict=True)], ["core", "id", "key", "at", "data"])
    out = [x for b in suffix._index_cores(10, most)(iter([batch.slice(i, size) for i in range(0, len(rows), size)])) for x in b.to_pylist()]
    cut, sent = {(x["id"], p) for x in out if x["data"] is None for p in range(x["start"], x["end"])}, sorted((x["id"], x["start"], x["data"]) for x in out if x["data"] is not None)
    want, on = set(), []
    for core in {x[0] for x in rows}:
        whole: dict[bytes, list] = {}
        for _, t, i, _, at in (x for x in rows if x[0] == core):
            whole.setdefault(t, []).append((i, at))
        many = len(whole) > most
        want |= {(i, at + p) for t, places in whole.items() for i, at in sorted(places)[1:] for p in range(len(t))}
        on += [(*min(places), t) for t, places in whole.items() if many]
        seen: dict[bytes, list] = {}
        for t, places in whole.items() if len(whole) > 1 and not many else ():
            for p in range(len(t) - 9):
                seen.setdefault(t[p : p + 10], []).append((min(places)[0], min(places)[1] + p))
        want |= {(i, at + p) for v in seen.values() for i, at in sorted(v)[1:] if (i, at) != min(v) for p in range(10)}
    # a block holds several cores, so it may find repeats between their parts too
    every: dict[bytes, list] = {}
    for _, t, i, _, at in rows:
        for p in range(len(t) - 9):
            every.setdefault(t[p : p + 10], []).append((i, at + p))
    may = {(i, at + p) for v in every.values() for i, at in v if (i, at) != min(v) for p in range(10)}
    assert sent == sorted(on) and want <= cut <= want | may
