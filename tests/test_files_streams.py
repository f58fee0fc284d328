import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.schemas import TABLES, get
from tessella.sources import files, sinks
from tessella.streaming import windows as W


def docx(paragraphs):
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p[:2]}</w:t></w:r><w:r><w:t>{p[2:]}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_documents_by_type(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nx")
    (tmp_path / "b.docx").write_bytes(docx(["First one", " ", "Second"]))
    (tmp_path / "c.json").write_text(json.dumps({"question": "Q?", "answer": "A.", "category_name": "Top", "id": 1}))
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"]["text"] == "# T\n\nx" and rows["b.docx"]["text"] == "First one\n\nSecond"
    assert rows["c.json"]["text"] == "Question: Q?\nAnswer: A.\nTopic: Top"
    assert rows["d.json"]["text"] is None and "unsupported" in rows["e.pdf"]["error"]
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_documents(spark, str(tmp_path), {"pdf": lambda b: "page"}).collect()}["e.pdf"] == "page"


def test_csv_manifest_questions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("plan_id,plan_name,price,validity_days,data_gb,voice_minutes,sms_limit,ott_benefits,fiveg_eligible,auto_renew\n00912345678901234567,A,x,30,,,,,true,no\n")
    raw = files.read_csv_table(spark, str(tmp_path / "p.csv"), TABLES["plan_master"]).first()
    assert raw["plan_id"] == "00912345678901234567"
    typed = files.read_csv_table(spark, str(tmp_path / "p.csv"), TABLES["plan_master"], typed=True).first()
    assert typed["_bad_price"] == "x" and typed["fiveg_eligible"] is True and typed["auto_renew"] is False
    (tmp_path / "m.json").write_text(json.dumps([{"document_id": "a", "path": "x"}, {"document_id": "a", "path": "y"}]))
    with pytest.raises(ValueError, match="document_id"):
        files.read_manifest(spark, str(tmp_path / "m.json"), "document_id string, path string")
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query_id": "1", "query": "why"}]}))
    assert [tuple(r) for r in files.question_list(spark, str(tmp_path / "q.json")).collect()] == [("1", "why")]
    with pytest.raises(ValueError):
        get("nope")
    assert len(TABLES) == 28


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, t string")
    kept, rejected = sinks.write_with_quarantine(rows, str(tmp_path / "q"), F.col("t") == "a")
    assert spark.read.parquet(kept).count() == 1 and spark.read.parquet(rejected).count() == 2
    sinks.write_once(rows, str(tmp_path / "o"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(rows, str(tmp_path / "o"))
    sinks.write_partitioned(rows.filter("t IS NOT NULL"), str(tmp_path / "p"), "t")
    sinks.write_partitioned(rows.filter("k = 3").withColumn("k", F.lit(9)), str(tmp_path / "p"), "t")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 9]


def test_stream_equals_batch(spark, base):
    events = spark.read.parquet(f"{base}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/events.parque[t]")
    for make in (lambda e: W.tumbling(e, "1 day"), lambda e: W.sliding(e, "1 day", "12 hours"), lambda e: W.sessions(e, "6 hours")):
        assert sorted(map(tuple, W.run_to_end(spark, make(stream)).collect())) == sorted(map(tuple, make(events).collect()))


def test_stream_without_repeats(spark, tmp_path):
    row = "SELECT 1L event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' ts, 1 user_id, 'a' event_type, 1.0D value"
    both = spark.sql(f"{row} UNION ALL {row}")
    both.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(both.schema).parquet(str(tmp_path / "e"))
    assert W.run_to_end(spark, W.without_repeats(stream, "event_id"), "append").count() == 1


def test_append_mode_writes_closed_windows(spark, base):
    events = spark.read.parquet(f"{base}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/events.parque[t]")
    got = W.run_to_end(spark, W.sessions(stream, "6 hours"), "append")
    want = W.closed(W.sessions(events, "6 hours"), events, "stop")
    assert 0 < want.count() < W.sessions(events, "6 hours").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_vectors_that_do_not_fit(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    metadata = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, title string")
    sinks.write_vectors(vectors, metadata, str(tmp_path / "v"), dim=2)
    assert spark.read.parquet(str(tmp_path / "v/vectors")).count() == 2
    for bad_v, bad_m in ((vectors.limit(1), metadata), (vectors.union(vectors), metadata), (vectors.withColumn("embedding", F.array(F.lit(1.0))), metadata), (vectors, metadata.limit(0))):
        with pytest.raises(ValueError, match="do not fit"):
            sinks.write_vectors(bad_v, bad_m, str(tmp_path / "w"), dim=2)
        assert not (tmp_path / "w" / "vectors").exists() and not (tmp_path / "w" / "unchecked").exists()


def test_graph_export_reads_back(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", None), ("b", "x")], "id string, label string"), spark.createDataFrame([("a", "b", 1)], "src string, dst string, n int")
    for form in ("parquet", "json"):
        sinks.export_graph(nodes, edges, str(tmp_path / form), form)
        read = spark.read.format(form).load(str(tmp_path / form / "nodes")).select("id", "label")
        assert sorted(map(tuple, read.collect())) == [("a", ""), ("b", "x")]


def test_folders(spark, monkeypatch):
    from tessella import session

    place = sinks.scratch(spark, "x")
    spark.range(3).write.parquet(place)
    sinks.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(place).count()
    monkeypatch.setattr(session, "_named_folder", lambda _: None)
    assert session.shared_folder(spark) == session.shared_folder(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(spark)


def test_json_lines_and_lists_of_questions(spark, tmp_path):
    assert files.json_text(b'{"question": "Q?", "answer": "A"}\n{"a": [1, 2], "id": 3}\n') == "Question: Q?\nAnswer: A\n\na: 1, 2"
    (tmp_path / "q.txt").write_text('{"results": [{"id": "1", "query": "a"}]}\n[{"question_id": "2", "question": "b"}]\n')
    assert {tuple(r) for r in files.question_list(spark, str(tmp_path / "q.txt"), lines=True).collect()} == {("1", "a"), ("2", "b")}
