import json
import os
import threading
import time
import urllib.error
import urllib.request

import pytest

from tesserine import cli
from tesserine.operators.generate import Extractive, build_prompt, clean_answer
from tesserine.plans.engine import Engine
from tesserine.server import serve
from tesserine.streaming.watch import watch


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), index_type="flat")


def put(path, text, ago=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if ago:
        os.utime(path, (time.time() - ago,) * 2)
    return str(path)


def test_index_and_ask(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    put(tmp_path / "d/hnsw.md", "The HNSW index builds a layered graph of vectors and is searched from the top layer down.")
    put(tmp_path / "d/cooking.md", "To make bread, mix flour and water, knead the dough and bake it in a hot oven for an hour.")
    assert [r.chunks for r in engine.index([str(tmp_path / "d")])] == [1, 1]
    found = engine.retrieve("how does the hnsw graph index search vectors", 2)
    assert found[0].source.endswith("hnsw.md") and found[0].score > found[1].score
    answer = engine.ask("how to bake bread dough", 1)
    assert "bread" in answer.text and len(answer.sources) == 1
    sources, pieces = engine.ask_stream("how to bake bread dough", 1)
    assert "".join(pieces).strip() == answer.text and sources == answer.sources
    assert engine.store.snapshot().graphs is not None


def test_unchanged_is_skipped_changed_is_replaced(engine, tmp_path):
    path = put(tmp_path / "a.txt", "alpha beta gamma. " * 30, ago=100)
    first = engine.index([path])
    assert not first[0].skipped and engine.index([path])[0].skipped
    n = engine.status()["chunks"]
    assert n == first[0].chunks
    put(tmp_path / "a.txt", "delta epsilon zeta eta. " * 30)
    assert not engine.index([path])[0].skipped
    assert engine.status()["files"] == 1
    assert all("alpha" not in r["text"] for r in engine.store.snapshot().chunks.collect())
    keys = [r["chunk_idx"] for r in engine.store.snapshot().chunks.collect()]
    assert len(set(keys)) == len(keys) and min(keys) >= n  # keys are not used again


def test_refresh_prunes_and_follows(engine, tmp_path):
    keep, gone = put(tmp_path / "keep.txt", "This one stays here, with a text long enough for a chunk.", 50), put(tmp_path / "gone.txt", "This one will go away, with a text long enough for a chunk.", 50)
    engine.index([keep, gone])
    os.remove(gone)
    put(tmp_path / "keep.txt", "This one has changed by now, with a text long enough for a chunk.")
    done = engine.refresh()
    assert done.deleted == [gone] and [r.path for r in done.indexed if not r.skipped] == [keep]
    assert [r["path"] for r in engine.list_files().collect()] == [keep]
    assert engine.refresh().deleted == []


def test_remove_and_clear(engine, tmp_path):
    put(tmp_path / "d/top.txt", "A sentence at the top of it all. " * 5)
    put(tmp_path / "d/sub/deep.txt", "A sentence deep down in a folder. " * 5)
    put(tmp_path / "d/subway.txt", "A sentence about trains under ground. " * 5)
    engine.index([str(tmp_path / "d")])
    files, chunks = engine.remove(str(tmp_path / "d/sub"))
    assert [f.rsplit("/", 1)[1] for f in files] == ["deep.txt"] and chunks == 1
    assert engine.status()["files"] == 2 and engine.remove("/no/such") == ([], 0)
    assert engine.store.remove_files([str(tmp_path / "d/subway.txt")])[1] == 1
    engine.clear()
    assert engine.status()["files"] == engine.status()["chunks"] == 0 and engine.retrieve("x") == []
    assert engine.index([str(tmp_path / "d")]) and engine.status()["files"] == 3


def test_files_without_a_chunk_are_listed(engine, tmp_path):
    path = put(tmp_path / "small.txt", "tiny")
    assert engine.index([path])[0].chunks == 0
    assert [(r["path"], r["chunks"]) for r in engine.list_files().collect()] == [(path, 0)]
    assert engine.index([path])[0].skipped


def test_readers_keep_their_version(engine, tmp_path):
    engine.index([put(tmp_path / "a.txt", "The first text, long enough to make a chunk of its own.")])
    before = engine.store.snapshot()
    engine.index([put(tmp_path / "b.txt", "The second text, long enough to make a chunk of its own.")])
    assert before.chunks.count() == 1 and engine.store.snapshot().chunks.count() == 2


def test_failed_save_changes_nothing(engine, tmp_path, monkeypatch):
    engine.index([put(tmp_path / "a.txt", "The first text, long enough to make a chunk of its own.")])

    class Broken:
        def embed(self, texts):
            raise RuntimeError("no model")

        def dims(self):
            return 0

    engine.embedder = Broken()
    with pytest.raises(Exception, match="no model"):
        engine.index([put(tmp_path / "b.txt", "The second text, long enough to make a chunk of its own.")])
    assert engine.status()["files"] == 1 and not [f for f in os.listdir(engine.store.path) if f.startswith("new-")]


def test_prompt():
    text = build_prompt("Why?", [("a.pdf", 3, "One."), ("b.txt", 0, "Two.")])
    assert text.endswith("Context:\n---\n[Source: a.pdf, Page 3]\nOne.\n\n[Source: b.txt]\nTwo.\n\n---\n\nQuestion: Why?\n\nAnswer:")
    with pytest.warns(UserWarning, match="too long"):
        build_prompt("x" * 13000, [])


def test_clean_answer():
    assert clean_answer("  yes <|end|> no</s>") == "yes" and clean_answer("[end of text]") == ""
    assert Extractive().generate(build_prompt("zebra", [("a", 0, "Nothing here.")]), None) == "The context does not contain the answer."


def test_watch_finds_new_files_only(spark, engine, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    put(folder / "a.txt", "The first text, long enough to make a chunk of its own.")
    watch(engine, str(folder), state).awaitTermination()
    assert engine.status()["files"] == 1
    put(folder / "b.txt", "The second text, long enough to make a chunk of its own.")
    put(folder / "node_modules/c.txt", "Not this text, though it is long enough to make a chunk.")
    watch(engine, str(folder), state).awaitTermination()
    assert engine.status()["files"] == 2


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path / "d/a.txt", "Whales are mammals that live in the sea and breathe air.")
    run = lambda *a: (cli.main([*a, "--store", str(tmp_path / "s"), "--index-type", "flat"], spark), capsys.readouterr().out)
    assert run("list") == (0, "No files indexed.\n")
    assert run("search", "whales")[1] == "No matches.\n"
    assert "1 chunks" in run("index", str(tmp_path / "d"))[1] and "unchanged" in run("index", str(tmp_path / "d"))[1]
    assert "a.txt" in run("search", "whales in the sea", "-k", "1")[1]
    assert "Whales" in run("query", "where do whales live", "--sources", "--stream")[1]
    assert "files   1" in run("status")[1] and "Pruned 0" in run("refresh")[1]
    assert "Nothing indexed" in run("rm", "/no/such")[1] and "Removed 1" in run("remove", str(tmp_path / "d"))[1]
    assert run("clear", "--yes") == (0, "Cleared.\n")
    assert cli.main(["nonsense"]) == 2 and cli.main(["help"]) == 0
    assert cli.human(512) == "512 B" and cli.human(1536) == "1.5 KB"


def test_http(engine, tmp_path):
    path = put(tmp_path / "a.txt", "Whales are mammals that live in the sea and breathe air.")
    engine.index([path])
    server = serve(engine, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(url, body=None, accept="*/*"):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{url}", data, {"Accept": accept})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        code, text = call("/query", {"question": "where do whales live"})
        assert code == 200 and json.loads(text)["sources"][0]["source"] == path and "Whales" in json.loads(text)["answer"]
        events = [json.loads(x[6:]) for x in call("/query", {"question": "whales", "k": 1}, "text/event-stream")[1].strip().split("\n\n")]
        assert "".join(e["token"] for e in events[:-1]) and events[-1]["done"] and events[-1]["sources"][0]["page"] == 0
        assert json.loads(call("/status")[1]) == {"files": 1, "chunks": 1}
        assert [f["path"] for f in json.loads(call("/files")[1])["files"]] == [path]
        assert call("/query")[0] == 405 and call("/query", b"{")[0] == 400 and call("/remove", {"path": " "})[0] == 400 and call("/nowhere")[0] == 404
        assert json.loads(call("/refresh", b"")[1]) == {"pruned": 0, "indexed": 0}
        assert json.loads(call("/remove", {"path": path})[1]) == {"removedFiles": 1, "removedChunks": 1}
        assert json.loads(call("/query", {"question": "whales"})[1])["sources"] == []
        assert json.loads(call("/clear", b"")[1]) == {"ok": True} and "<title>" in call("/")[1]
    finally:
        server.shutdown()


def test_segments_are_added_rewritten_and_merged(spark, tmp_path, monkeypatch):
    from tesserine.operators import store

    engine = Engine(spark, str(tmp_path / "store"))
    text = "The {} text, long enough to make a chunk of its own, and a little more."
    for n in range(3):
        engine.index([put(tmp_path / f"{n}.txt", text.format(n))])
    first = engine.store.snapshot().segments
    assert len(first) == 3
    engine.remove(str(tmp_path / "1.txt"))
    assert engine.store.snapshot().segments == (first[0], first[2])
    engine.index([put(tmp_path / "0.txt", text.format("changed"), ago=50)])
    now = engine.store.snapshot().segments
    assert now[0] == first[2] and len(now) == 2
    monkeypatch.setattr(store, "MOST_SEGMENTS", 2)
    engine.index([put(tmp_path / "3.txt", text.format(3))])
    assert len(engine.store.snapshot().segments) == 1 and engine.status()["files"] == engine.status()["chunks"] == 3
    found = {s.source.rsplit("/", 1)[1] for s in engine.retrieve("text", 9)}
    assert found == {"0.txt", "2.txt", "3.txt"}
    assert engine.remove(str(tmp_path))[1] == 3 and engine.store.snapshot().segments == ()
