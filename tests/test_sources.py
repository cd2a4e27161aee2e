import base64
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from millrace.sources import files
from millrace.sources.api import ApiSource
from millrace.sources.jobs import Job
from millrace.streaming import incremental


def test_manifests(spark, tmp_path):
    line = json.dumps({"fileId": "1", "fileName": "a.txt", "filePath": "/a.txt", "fileType": "txt", "fileSize": 3})
    (tmp_path / "m.jsonl").write_text(line + "\n")
    row = files.manifest(spark, str(tmp_path / "m.jsonl")).first()
    assert (row.fileId, row.sourceFileSize, row.totalPageNum) == ("1", 3, 0)
    assert files.inline_manifest(spark, base64.b64encode(f"{line}\n{line}\n".encode()).decode()).count() == 2


def test_texts_and_new_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx\r\ny")
    (tmp_path / ".hidden").write_text("no")
    assert [r.text for r in files.texts(spark, str(tmp_path / "a.txt")).collect()] == ["x\ny"]
    known = spark.createDataFrame([], "filePath string")
    found = files.new_files(spark, str(tmp_path), known)
    assert [r.fileName for r in found.collect()] == ["a.txt"]
    assert files.new_files(spark, str(tmp_path), found.select("filePath")).count() == 0


def test_questions_skip_incomplete_lines(spark, tmp_path):
    rows = [{"instruction": "q", "output": "a"}, {"instruction": "q"}, {"instruction": "q", "input": "i", "output": "b"}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert files.questions(spark, str(tmp_path / "q.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text("{")
    with pytest.raises(Exception):
        files.questions(spark, str(tmp_path / "bad.jsonl")).collect()


def test_question_documents_are_checked_as_a_whole(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"instruction": "q", "output": "a"}, {"instruction": "r", "output": "b"}], indent=1))
    assert files.question_document(spark, str(tmp_path / "q.json")).count() == 2
    (tmp_path / "bad.json").write_text(json.dumps([{"instruction": "q", "output": "a"}, {"instruction": "q"}]))
    with pytest.raises(Exception, match="lacks"):
        files.question_document(spark, str(tmp_path / "bad.json")).collect()


def test_job_exports_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "one"), ("a.md", "two"), ("b", "three")], "fileName string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    spec = {"reader": {"name": "parquet", "options": {"path": str(tmp_path / "in")}}, "writer": {"name": "nfs", "options": {"folder": f"file://{tmp_path}/out", "kind": "txt"}}, "steps": [["unicode_spaces", {}]]}
    Job.parse(json.dumps(spec)).run(spark)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.txt", "a_1.txt", "b.txt"]
    assert {(tmp_path / "out" / n).read_text() for n in ("a.txt", "a_1.txt")} == {"one", "two"}
    with pytest.raises(ValueError):
        Job.parse(json.dumps(spec | {"writer": {"name": "fax"}}))


def test_near_new_documents(spark, tmp_path):
    text = lambda *x: "。".join(x)
    for part, rows in enumerate(([(1, text("a", "b", "c")), (2, text("a", "b", "c", "d")), (3, "z")], [(4, text("a", "b", "c", "e")), (5, "y")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        incremental.near_new(stream, str(tmp_path / "known"), str(tmp_path / "state")).awaitTermination()
        assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "known" / "rows")).collect()} == ({1, 3}, {1, 3, 5})[part]


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "x")
    assert files.unpack(str(tmp_path / "a.zip"), str(tmp_path / "out")) == ["d/x.txt"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../x.txt", "x")
    with pytest.raises(ValueError):
        files.unpack(str(tmp_path / "b.zip"), str(tmp_path / "out"))


def test_api_source(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"data": {"items": [{"id": 1, "n": {"x": "a"}}, {"id": 2}]}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(ApiSource)
    fields = json.dumps([{"name": "id"}, {"name": "x", "path": "n.x", "alias": "name"}])
    df = spark.read.format("api").options(url=f"http://127.0.0.1:{server.server_port}/", dataPath="data.items", fields=fields).load()
    assert [tuple(r) for r in df.collect()] == [("1", "a"), ("2", "")]
    server.shutdown()


def test_collect_goes_on_where_it_ended(spark, tmp_path):
    src, to, state = (str(tmp_path / n) for n in ("src", "to", "state"))
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        incremental.collect(spark, src, "id long", to, state).awaitTermination()
        assert spark.read.parquet(to).count() == 10 * (part + 1)


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.counts(stream, "ts", "1 hour", "1 day", "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg({"n": "sum"}).first()[0] == events.count()
