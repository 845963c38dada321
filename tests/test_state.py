from __future__ import annotations

import struct

from pyspark.sql import functions as F

from loamgrid.operators import context as N
from loamgrid.sources import state as S


def test_checkpoint(spark, tmp_path):
    S.save_checkpoint(spark, str(tmp_path / "c"), "first", 1)
    S.save_checkpoint(spark, str(tmp_path / "c"), "task", 2, done="a; b;", files="x.rs, y.rs")
    r = S.load_checkpoint(spark, str(tmp_path / "c")).first()
    assert (r.task, r.done, r.next, r.files, r.timestamp) == ("task", ["a", "b"], [], ["x.rs", "y.rs"], 2)


def test_insights(spark, tmp_path):
    write = S.insight_sink(str(tmp_path / "i"), "drift")
    for _ in range(2):
        write(spark.createDataFrame([("found it",)], "answer string"), 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "i")).collect() if r.value] == ["--- drift [ts=3] ---", "found it"]


def test_model_file(spark, tmp_path):
    def text(s):
        return struct.pack("<Q", len(s)) + s.encode()

    data = b"GGUF" + struct.pack("<IQQ", 3, 2, 2) + text("name") + struct.pack("<I", 8) + text("tiny") + text("dims") + struct.pack("<IIQ", 9, 4, 2) + struct.pack("<II", 7, 8)
    for i, n in enumerate([3, 5]):
        data += text(f"t{i}") + struct.pack("<IQQ", 2, n, 2) + struct.pack("<IQ", i, 64 * i)
    (tmp_path / "m.gguf").write_bytes(data)
    spark.dataSource.register(S.ModelFile)
    d = spark.read.format("gguf").load(str(tmp_path / "m.gguf"))
    assert {r.name: r.value for r in d.filter("section = 'metadata'").collect()} == {"name": "tiny", "dims": "[7, 8]"}
    assert {r.type: (r.tensors, r.elements) for r in S.by_type(d).collect()} == {"0": (1, 6), "1": (1, 10)}


def test_nucleus(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 1.0, -5.0])], "id long, logits array<double>")
    assert [r.token for r in S.nucleus(df, 0.8).orderBy(F.desc("prob")).collect()] == [1, 2]
    assert [r.token for r in S.nucleus(df, 0.1).collect()] == [1]


def test_gate_and_daemon_content(spark):
    rows = [(1, "how thin hand?"), (2, "short"), (3, "thin hand"), (4, "thin hand erst"), (5, "x" * 600)]
    assert {r.query_id for r in N.gate(spark.createDataFrame(rows, "query_id long, text string")).collect()} == {1, 4}
    body = spark.createDataFrame([("[tags: a]\none\n[odd]\ntwo",)], "b string")
    assert body.select(N.daemon_content("b").alias("c")).first().c == "one\ntwo"
