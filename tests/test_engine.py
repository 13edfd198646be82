import os
import time
import uuid

import pytest
from office_files import archive, docx
from pyspark.sql import functions as F

from lexspan.config import Settings
from lexspan.engine import Engine
from lexspan.operators import gate, sync
from lexspan.operators.store import SCHEMAS, Store
from lexspan.sources.extract import Providers


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "资料"
    (root / "船舶档案").mkdir(parents=True)
    (root / "港口说明.txt").write_text("集装箱泊位调度每天更新，采用潮汐表。\n渔船登记册按吨位排列。")
    (root / "船舶档案" / "航线手册.md").write_text("# 手册\n一、航前检查\n说明泊位与潮汐。\n二、靠岸\n其余步骤。")
    (root / "码头平面.dwg").write_bytes(b"AC1027")
    (root / "~$lock.txt").write_text("locked")
    return root


def made(spark, tmp_path, root, providers=None, **more):
    return Engine(spark, str(tmp_path / "store"), Settings(roots=(str(root),), store_parts=4, **more), providers)


def test_sync_search_read_list(spark, tmp_path, folder):
    e = made(spark, tmp_path, folder)
    first = e.sync()
    assert (first["scanned"], first["added"], first["failed"]) == (3, 3, 0)
    assert e.status()["by_status"] == {"indexed": 2, "metadata": 1}
    hits = e.search("泊位").collect()
    assert {h["rel"] for h in hits} == {"港口说明.txt", "船舶档案/航线手册.md"} and all("「泊位」" in h["snippet"] for h in hits)
    assert e.search("渔船登记册").first()["rel"] == "港口说明.txt"
    assert e.search("码头平面").first()["status"] == "metadata"
    assert {h["rel"] for h in e.search("泊位", dir="船舶档案").collect()} == {"船舶档案/航线手册.md"}
    assert {h["rel"] for h in e.search("泊位", ext="md").collect()} == {"船舶档案/航线手册.md"}
    assert e.search("泊位", days=1, as_of="2100-01-01").count() == 0 and e.search("泊位", days=3).count() == 2
    for hostile in ("(((", 'tide" AND "berth', "name:* -泊位", "\\\\", "_%'", ""):
        e.search(hostile).collect()
    assert "渔船登记" in e.read("港口说明.txt").first()["text"]
    assert e.read("码头平面.dwg").first()["text"] == ""
    dirs, files = e.list()
    assert [d["dir"] for d in dirs.collect()] == ["船舶档案"] and files.count() == 2
    assert e.list(needle="dwg")[1].count() == 1
    second = e.sync()
    assert (second["unchanged"], second["added"], second["updated"], second["removed"]) == (3, 0, 0, 0)


def test_sync_sees_changes(spark, tmp_path, folder):
    e = made(spark, tmp_path, folder)
    e.sync()
    ids = {r["rel"]: r["doc_id"] for r in e.store.read("docs").collect()}
    (folder / "新.txt").write_text("全新的内容 zebra")
    time.sleep(0.01)
    (folder / "港口说明.txt").write_text("改过的文字")
    os.remove(folder / "码头平面.dwg")
    assert e.search("zebra").count() == 0
    assert e.staleness() == {"added": 1, "changed": 1, "removed": 1}
    got = e.sync()
    assert (got["added"], got["updated"], got["removed"], got["unchanged"]) == (1, 1, 1, 1)
    assert e.search("zebra").count() == 1 and e.search("码头平面").count() == 0
    assert {r["rel"]: r["doc_id"] for r in e.store.read("docs").collect()}["港口说明.txt"] == ids["港口说明.txt"]
    retry = e.sync(only=["新.txt"])
    assert (retry["updated"], retry["unchanged"], retry["removed"]) == (1, 2, 0)
    assert e.sync(full=True)["added"] == 3
    assert [r["id"] for r in e.log().collect()] == [4, 3, 2, 1]
    assert e.inside_roots(e.store.read("docs").first()["path"]) and not e.inside_roots("/etc/passwd")


def test_one_file_rewrites_one_part(spark, tmp_path, folder):
    e = Engine(spark, str(tmp_path / "store"), Settings(roots=(str(folder),), store_parts=16))
    for i in range(12):
        (folder / f"n{i}.txt").write_text(f"heron {i}")
    e.sync()
    before = e.store.manifest()["tables"]
    (folder / "n3.txt").write_text("changed heron and egret")
    e.sync()
    after = e.store.manifest()["tables"]
    for name in ("docs", "chunks", "postings", "index_stats"):
        assert sum(before[name][k] != after[name][k] for k in before[name]) == 1 and before[name].keys() == after[name].keys()
    stats = e.store.read("index_stats").agg(F.sum("chunks"), F.sum("terms")).first()
    post = e.store.read("postings")
    assert tuple(stats) == (e.store.read("chunks").count(), post.dropDuplicates(["chunk_id"]).agg(F.sum("dl")).first()[0])
    assert e.search("egret").count() == 1 and e.search("heron", limit=30).count() == 12
    assert e.last_sync()["updated"] == 1 and e.last_sync()["unchanged"] == 14


def test_a_sync_that_dies_leaves_the_tables_as_they_were(spark, tmp_path, folder, monkeypatch):
    e = made(spark, tmp_path, folder)
    e.sync()
    before = e.store.manifest()["tables"]
    (folder / "新.txt").write_text("pelican")
    real = e.store.stage

    def dies(name, df):
        if name == "postings":
            raise OSError("no space")
        return real(name, df)

    monkeypatch.setattr(e.store, "stage", dies)
    with pytest.raises(OSError):
        e.sync()
    after = e.store.manifest()["tables"]
    assert all(before[n] == after[n] for n in ("docs", "chunks", "postings", "index_stats"))
    assert e.search("pelican").count() == 0 and e.search("泊位").count() == 2 and e.last_sync()["level"] == "error"
    monkeypatch.undo()
    assert e.sync()["added"] == 1 and e.search("pelican").count() == 1


def test_replaced_folders_go_after_a_while(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), parts=2, grace=0.0)
    rows = lambda *ids: spark.createDataFrame([(i * 10, i, 0, "", None, f"t{i}") for i in ids], SCHEMAS["chunks"])
    s.write("chunks", rows(*range(20)))
    s.write("session_state", spark.createDataFrame([("a", True, None)], SCHEMAS["session_state"]))
    part = spark.range(1).select(F.lit(7).cast("long").alias("doc_id")).select(s.part()).first()[0]
    kept = s.read("chunks", {part}).where("doc_id <> 7")
    s.swap([s.stage("chunks", kept)], {part})
    assert sorted(r["doc_id"] for r in s.read("chunks").collect()) == [i for i in range(20) if i != 7]
    assert s.read("session_state").count() == 1 and len(list((tmp_path / "s" / "manifest").glob("*.json"))) == 1
    (tmp_path / "s" / "manifest" / "000000000099.json").write_text('{"number": 9')  # half a manifest: the one before it holds
    assert s.read("chunks").count() == 19
    s.clear("chunks")
    assert s.read("chunks").count() == 0 and s.read("session_state").count() == 1


def test_names_that_begin_with_an_underscore_or_a_dot(spark, tmp_path):
    root = tmp_path / "files"
    (root / "_drafts" / ".old").mkdir(parents=True)
    (root / ".git").mkdir()
    for name in ("a.txt", "_draft.txt", ".notes.md", "_drafts/b.txt", "_drafts/.old/c.txt", ".git/d.txt"):
        (root / name).write_text(f"walrus in {name}")
    (root / "link.txt").symlink_to(root / "a.txt")
    e = made(spark, tmp_path, root)
    got = e.sync()
    assert (got["scanned"], got["added"], got["failed"]) == (5, 5, 0)
    assert {h["rel"] for h in e.search("walrus", limit=20).collect()} == {"a.txt", "_draft.txt", ".notes.md", "_drafts/b.txt", "_drafts/.old/c.txt"}
    assert e.sync()["unchanged"] == 5
    assert sorted(r["doc_id"] for r in e.store.read("docs").collect()) == [1, 2, 3, 4, 5]


def test_missing_root_removes(spark, tmp_path, folder):
    e = made(spark, tmp_path, folder)
    e.sync()
    other = Engine(spark, str(tmp_path / "store"), Settings(roots=(str(tmp_path / "none"),)))
    got = other.sync()
    assert got["removed"] == 3 and got["errors"]
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "store"), Settings(roots=(str(tmp_path / "none"),), fail_on_missing_root=True)).sync()


def test_pictures_in_office_files(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "航图.docx").write_bytes(docx(b"p" * 30000))
    (root / "坏.docx").write_bytes(b"broken")
    (root / "旧.doc").write_bytes(b"old")
    (root / "扫描.pdf").write_bytes(b"%PDF")
    e = made(spark, tmp_path, root)
    got = e.sync()
    assert got["failed"] == 1 and e.status()["by_status"] == {"error": 1, "indexed": 1, "needs_conversion": 1, "needs_ocr": 1}
    assert e.search("吊臂照片").count() == 0
    with_ocr = made(spark, tmp_path, root, Providers(ocr=lambda kind, data: "吊臂照片" if kind == "image" else None))
    assert with_ocr.sync()["images"] == 1
    assert with_ocr.search("吊臂照片").first()["rel"] == "航图.docx"
    assert with_ocr.sync()["images"] == 0


def test_pictures_are_read_once_and_scans_without_text(spark, tmp_path):
    root, calls = tmp_path / "files", tmp_path / "calls"
    root.mkdir(), calls.mkdir()
    (root / "a.docx").write_bytes(docx(b"q" * 30000))
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    bare = {"word/document.xml": f"<w:document {names}><w:body><w:p/></w:body></w:document>", "word/media/page.png": b"scan"}
    (root / "scan.docx").write_bytes(archive(**bare))
    assert made(spark, tmp_path / "none", root).sync()["failed"] == 0
    assert made(spark, tmp_path / "none", root).status()["by_status"] == {"indexed": 1, "needs_ocr": 1}

    def ocr(kind, data):
        (calls / uuid.uuid4().hex).write_bytes(data[:4])
        return f"grue {data[:4].decode()}"

    e = made(spark, tmp_path, root, Providers(ocr=ocr))
    e.sync()
    assert e.status()["by_text_source"] == {"native": 1, "ocr": 1} and e.search("scan grue").first()["rel"] == "scan.docx"
    (root / "b.docx").write_bytes(docx(b"q" * 30000))
    assert e.sync()["added"] == 1 and e.search("qqqq", limit=9).count() == 2
    assert sorted(p.read_bytes() for p in calls.iterdir()) == [b"qqqq", b"scan"]
    assert {(r["text"], r["bytes"]) for r in e.store.read("image_ocr").collect()} == {("grue qqqq", 30000), ("grue scan", 4)}


def test_sessions_and_gate(spark, tmp_path, folder):
    e = made(spark, tmp_path, folder)
    e.sync()
    assert e.session("on") is False and e.session("on", True) and e.session("on")
    said = {"a": "用知识库查一下泊位", "b": "先不要用知识库，凭印象说", "c": "按 航线手册.md 写", "d": "讲个笑话", "on": "你好", "e": "用知识库同步一下", "f": None}
    got = {r["session_id"]: (r["allowed"], r["sync"]) for r in e.allowed(spark.createDataFrame(list(said.items()), "session_id string, text string")).collect()}
    assert {k: bool(v[0]) for k, v in got.items()} == {"a": True, "b": False, "c": True, "d": False, "on": True, "e": True, "f": False}
    assert got["e"][1] and not got["a"][1]


def test_stream(spark, tmp_path, folder):
    from lexspan.streaming.watch import watch

    e = made(spark, tmp_path, folder)
    watch(e, str(tmp_path / "checkpoint"), once=True).awaitTermination(60)
    assert e.search("泊位").count() == 2
    (folder / "后来.txt").write_text("late arrival")
    watch(e, str(tmp_path / "checkpoint"), once=True).awaitTermination(60)
    assert e.search("arrival").count() == 1


def test_settings(tmp_path):
    s = Settings().updated({"chunk_chars": "700", "unknown": 1, "explicit_only": "false", "roots": "/a"})
    assert s.chunk_chars == 700 and s.explicit_only is False and s.roots == ("/a",)
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")).chunk_chars == 700
    with pytest.raises(ValueError):
        Settings().updated({"chunk_chars": -1})


def test_log_and_cache(spark):
    log = spark.createDataFrame([(i, None, "info", "m", None) for i in range(600)], "id long, ts timestamp, level string, message string, details string")
    entry = spark.createDataFrame([(600, None, "info", "x" * 5000, '{"added":[{"rel":"a","note":"n"}],"removed":["b"]}')], log.schema)
    kept = sync.append_log(log, entry)
    assert kept.count() == 500 and kept.agg(F.max(F.length("message"))).first()[0] == 4000
    assert [(r["change"], r["rel"], r["total"]) for r in sync.log_details(kept.where("id = 600")).orderBy("pos").collect()] == [("added", "a", 2), ("removed", "b", 2)]
    cache = spark.createDataFrame([("a", "t", 5, None)], "sha1 string, text string, bytes long, at timestamp")
    put = sync.cache_put(cache, spark.createDataFrame([("a", "new", 9, None), ("b", " ", 1, None)], cache.schema))
    assert {(r["sha1"], r["text"], r["bytes"]) for r in put.collect()} == {("a", "new", 5), ("b", " ", 1)}
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "sha1 string")
    assert {r["sha1"]: r["state"] for r in sync.cache_lookup(images, put).collect()} == {"a": "cached", "b": "dropped", "c": "pending"}


def test_last_turn(spark):
    rows = [("s", 1, "user/message", "user", "old"), ("s", 2, "turn/start", None, None), ("s", 3, "user/message", "plugin", "no"), ("s", 4, "user/message", "user", "a"), ("s", 5, "user/message", "user", "b")]
    got = gate.last_turn_text(spark.createDataFrame(rows, "session_id string, idx int, type string, source string, text string"))
    assert [(r["session_id"], r["text"]) for r in got.collect()] == [("s", "a\nb")]


def test_http_and_tools(spark, tmp_path, folder):
    import json
    import threading
    import urllib.error
    import urllib.request

    from lexspan.http import serve
    from lexspan.tools import REFUSED, Tools

    e = made(spark, tmp_path, folder)
    e.sync()
    server = serve(e)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None, **headers):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(base + path, data, {"Content-Type": "application/json", **headers} if data else headers)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    from urllib.parse import quote

    assert call("/search?q=" + quote("泊位"))[1][0]["rel"] in ("港口说明.txt", "船舶档案/航线手册.md")
    assert call("/search?q=")[0] == 400 and call("/nothing")[0] == 404 and call("/sync")[0] == 405 and call("/status", Host="example.org")[0] == 403
    assert call("/doc?key=nothing")[0] == 404 and call("/preview?path=/etc/passwd")[0] == 403
    path = e.store.read("docs").where("ext = '.txt'").first()["path"]
    assert "mark" in call("/preview?path=" + quote(path) + "&q=" + quote("泊位"))[1]["html"]
    assert call("/session", {"id": "s", "enabled": True})[1] == call("/session?id=s")[1] == {"enabled": True}
    assert call("/settings", {"top_k": 5})[1]["top_k"] == 5 and call("/settings", {"top_k": -5})[0] == 400
    server.shutdown()
    tools = Tools(e)
    assert tools.kb_search("x", "讲个笑话", "泊位") == REFUSED and "泊位" in tools.kb_search("x", "用知识库查泊位", "泊位")
    assert "航线手册.md" in tools.kb_list("s", "", "船舶档案") and tools.kb_read("s", "", "码头平面.dwg").startswith("no text")
    assert "doesn't ask" in tools.kb_status("s", "你好", "now") and "unchanged: 3" in tools.kb_status("s", "同步一下知识库", "now")
    assert tools.kb_session("s", "off") == "off" and "3 files" in tools.prompt_section("s")


def test_asking_once_and_syncs_behind_the_answer(spark, tmp_path, folder):
    from lexspan.tools import REFUSED, Tools

    e = made(spark, tmp_path, folder)
    tools = Tools(e)
    assert tools.kb_list("k", "讲个笑话") == REFUSED and not e.session("k")
    assert tools.kb_status("k", "用知识库同步一下", "now").startswith("A sync of 3 changed files")
    tools.background.join(120)
    assert e.progress["phase"] == "done" and e.progress["added"] == 3
    assert e.session("k") and "船舶档案" in tools.kb_list("k", "讲个笑话") and tools.kb_list("l", "讲个笑话") == REFUSED
