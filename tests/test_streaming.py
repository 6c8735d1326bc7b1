import shutil
import time

from sylvara.sources.xml import parse_xml
from sylvara.streaming.chunks import PushParser, assemble, parse_stream

SCHEMA = "doc_id long, seq long, data binary, is_last boolean"


def test_chunks(spark, tmp_path):
    texts = {1: "<a>é🙂\r\nx</a>".encode(), 2: "﻿<b>ü</b>".encode("utf-16-le"), 3: b"<c>"}
    rows = []
    for k, raw in texts.items():
        rows += [(k, i, raw[i : i + 1], i == len(raw) - 1 and k != 3) for i in range(len(raw))]
    rows = rows[::2] + rows[1::2][::-1] + rows[:3]  # out of order, some twice
    for n in range(3):
        spark.createDataFrame(rows[n::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    query = assemble(stream).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    # A query with processing-time timeouts always has another batch to run, so there is no end to wait for.
    got, end = {}, time.time() + 90
    try:
        while len(got) < 2 and time.time() < end:
            time.sleep(0.5)
            got = {r["doc_id"]: r["text"] for r in spark.table("assembled").collect()}
    finally:
        query.stop()
    assert got == {1: "<a>é🙂\nx</a>", 2: "<b>ü</b>"}
    nodes = parse_xml(spark.table("assembled").select("doc_id", "text"), "text").nodes
    assert sorted(r["text"] for r in nodes.where("kind = '#text'").collect()) == ["é🙂\nx", "ü"]


def test_whole_documents(spark, tmp_path):
    spark.createDataFrame([(1, "<a>x</a>"), (2, "<a>")], "doc_id long, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, content string").parquet(str(tmp_path / "in"))
    query = parse_stream(stream).nodes.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        assert [r["text"] for r in spark.table("streamed").where("kind = '#text'").collect()] == ["x"]
    finally:
        query.stop()
    shutil.rmtree(tmp_path / "state", ignore_errors=True)


def test_push_parser():
    p = PushParser()
    for byte in "<a>é</a>".encode():
        p.feed(bytes([byte]))
    assert p.close()["nodes"][-1][7] == "é"
    p = PushParser()
    p.feed("<a>é".encode()[:-1])
    assert p.close()["error"]["code"] == "DECODE"
