import hashlib
import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tesserae.operators.stages import Answers
from tesserae.sources import landing
from tesserae.sources.http import HttpModel
from tesserae.storage import save


@pytest.fixture
def server():
    """A model that repeats what it hears, or fails as told; it counts how many requests it has at once."""
    seen = {"now": 0, "most": 0, "all": []}
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            user = body["messages"][1]["text"]
            with lock:
                seen["now"] += 1
                seen["most"] = max(seen["most"], seen["now"])
                seen["all"].append((user, self.headers["Authorization"], body["temperature"], body["max_tokens"]))
            time.sleep(5 if "slow" in user else 0.1)
            with lock:
                seen["now"] -= 1
            status = 500 if "fail" in user else 200
            said = b"not json" if "bad" in user else b"broken" if status == 500 else json.dumps({"result": {"alternatives": [{"message": {"text": f"{body['messages'][0]['text']}|{user}"}}]}}).encode()
            try:
                self.send_response(status)
                self.send_header("Content-Length", str(len(said)))
                self.end_headers()
                self.wfile.write(said)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/ask", seen
    made.shutdown()


def test_model_over_http(spark, server):
    url, seen = server
    model = HttpModel(url, {"Authorization": "Key k"}, timeout=1, concurrency=3)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "fail", "slow", "bad", None, "Привет", *["more"] * 12])], "i int, t string").coalesce(1)
    got = {r.i: (r.text, r.error) for r in model.ask(rows, "sys", F.col("t"), 0.5, 7).collect()}
    assert got[0] == ("sys|one", None) and got[5] == ("sys|Привет", None) and got[4] == (None, None) and got[17] == ("sys|more", None)
    assert got[1] == (None, "HTTP 500: broken") and got[2][0] is None and "timed out" in got[2][1] and got[3][1].startswith("JSONDecodeError")
    assert 1 < seen["most"] <= 3 and {x[1:] for x in seen["all"]} == {("Key k", 0.5, 7)}
    down = HttpModel("http://127.0.0.1:9/none", timeout=1)
    assert down.ask(rows.limit(1), "s", F.col("t")).first().error.startswith("URLError")
    for bad in ({"url": "file:///etc"}, {"url": url, "headers": {"Authorization": ""}}):
        with pytest.raises(ValueError):
            HttpModel(**bad)


def test_stages_over_http(spark, server, tmp_path):
    url, seen = server
    models, answers = HttpModel(url, timeout=5).models(), Answers(spark, f"file://{tmp_path}/a")
    rows = spark.createDataFrame([(1, "q"), (2, "q"), (3, "fail")], "i int, t string")
    for _ in range(2):
        got = {r.i: r.correct for r in answers.once(rows, "correct", {"query": F.col("t")}, models.correct).collect()}
        assert got[1] == got[2] and got[1].endswith("|q") and got[3] is None
    assert sorted(x[0] for x in seen["all"]) == ["fail", "fail", "q"]
    told = rows.limit(1).select(models.plan(F.lit("1. A: b"), F.lit("why"))).first()[0]
    assert told.endswith("РАЗДЕЛЫ:\n1. A: b\n\nВОПРОС:\nwhy")


def files(spark, folder):
    return spark.read.format("binaryFile").load(str(folder))


def test_uploads_land_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("A b.md", "one"), ("a b.MD", "two"), ("x.exe", "no")):
        (tmp_path / "in" / name).write_text(text)
    out = tmp_path / "out"
    for _ in range(2):  # a rerun, as of a lost task, leaves one copy of each
        got = {r.path.rsplit("/", 1)[1]: r for r in save(landing.land(files(spark, tmp_path / "in"), f"file://{out}"), "landed").collect()}
        assert got["x.exe"].error == "type not accepted: exe" and got["x.exe"].target is None
        assert {n: r.sha256 for n, r in got.items() if r.error is None} == {n: hashlib.sha256(t).hexdigest() for n, t in (("A b.md", b"one"), ("a b.MD", b"two"))}
        assert sorted(p.read_text() for p in out.iterdir()) == ["one", "two"]


def test_a_write_that_fails_leaves_nothing(tmp_path):
    (tmp_path / "o" / "a.md" / "sub").mkdir(parents=True)  # nothing can be moved onto a folder
    with pytest.raises(OSError):
        landing.put(b"x", f"file://{tmp_path}/o/a.md")
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["a.md"]
    for _ in range(2):
        landing.put(b"x", f"file://{tmp_path}/o/б c.md")
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a.md", "б c.md"] and (tmp_path / "o" / "б c.md").read_bytes() == b"x"


def test_originals_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.MD").write_text("text")
    (tmp_path / "block").write_text("")
    docs = files(spark, tmp_path / "in").withColumn("doc_id", F.lit("id1"))
    assert landing.store_originals(docs, f"file://{tmp_path}/kept").first().target == f"file://{tmp_path}/kept/id1.md"
    assert (tmp_path / "kept" / "id1.md").read_text() == "text"
    failed = landing.store_originals(docs, f"file://{tmp_path}/block/under").first()
    assert failed.sha256 is None and failed.error and failed.bytes is None
