"""The HTTP interface: JSON, answers as server-sent events, and a page to ask from."""

from __future__ import annotations

import json
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from tesserine.plans.engine import Engine, Source

PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>tesserine</title>
<style>body{font:16px/1.5 system-ui;max-width:46rem;margin:2rem auto;padding:0 1rem}input{font:inherit;padding:.3rem}#q{width:70%}pre{white-space:pre-wrap}li{margin:.2rem 0}</style>
<h1>Ask your files</h1><form id="f"><input id="q" placeholder="Question" required> <input id="k" type="number" min="1" max="20" value="5"> <button>Ask</button></form>
<pre id="a"></pre><ul id="s"></ul><h2>Files</h2><p id="n"></p><ul id="l"></ul><button id="r">Refresh</button> <button id="c">Clear</button>
<script>
const $=i=>document.getElementById(i),post=(u,b)=>fetch(u,{method:'POST',body:JSON.stringify(b||{})});
async function list(){const d=await(await fetch('/files')).json();$('n').textContent=d.files.length+' files';$('l').replaceChildren(...d.files.map(f=>{const x=document.createElement('li'),b=document.createElement('button');b.textContent='remove';b.onclick=()=>post('/remove',{path:f.path}).then(list);x.append(f.path+' ('+f.chunks+') ',b);return x}))}
$('f').onsubmit=async e=>{e.preventDefault();$('a').textContent='';$('s').replaceChildren();const r=await fetch('/query',{method:'POST',headers:{Accept:'text/event-stream'},body:JSON.stringify({question:$('q').value,k:+$('k').value})}),t=r.body.pipeThrough(new TextDecoderStream()).getReader();let h='';
for(;;){const{value:v,done:d}=await t.read();if(d)break;h+=v;const p=h.split('\\n\\n');h=p.pop();for(const x of p){const m=JSON.parse(x.replace(/^data: /,''));if(m.error)$('a').textContent+='Error: '+m.error;else if(!m.done)$('a').textContent+=m.token;else $('s').replaceChildren(...m.sources.map(s=>{const y=document.createElement('li');y.textContent=s.source+(s.page?', page '+s.page:'')+' ('+s.score.toFixed(3)+')';return y}))}}};
$('r').onclick=()=>post('/refresh').then(list);$('c').onclick=()=>confirm('Drop everything?')&&post('/clear').then(list);list();
</script></html>"""


def sources_json(sources: list[Source]) -> list[dict[str, Any]]:
    return [{"source": s.source, "page": s.page, "score": s.score} for s in sources]


def events(engine: Engine, question: str, k: int) -> Iterator[dict[str, Any]]:
    """One event for each token, then one with the sources, or with the error."""
    try:
        sources, pieces = engine.ask_stream(question, k)
        for piece in pieces:
            yield {"token": piece, "done": False}
        yield {"sources": sources_json(sources), "done": True}
    except GeneratorExit:
        raise
    except Exception as e:  # noqa: BLE001
        yield {"error": str(e), "done": True}


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    protocol_version = "HTTP/1.1"

    def log_message(self, *args: Any) -> None:
        pass

    def _send(self, body: bytes, kind: str = "application/json", code: int = 200) -> None:
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _json(self, value: Any) -> None:
        self._send(json.dumps(value).encode())

    def _fail(self, code: int, text: str) -> None:
        self._send(text.encode(), "text/plain; charset=utf-8", code)

    def do_GET(self) -> None:
        self._route("GET")

    def do_POST(self) -> None:
        self._route("POST")

    def _route(self, method: str) -> None:
        path = self.path.partition("?")[0]
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        if path in ("/query", "/remove", "/refresh", "/clear") and method != "POST":
            return self._fail(405, "POST only")
        try:
            body = json.loads(raw or b"null")
            bad = None if isinstance(body, dict) else "bad request: a JSON object is needed"
        except ValueError as e:
            body, bad = None, f"bad request: {e}"
        body = body if isinstance(body, dict) else {}
        try:
            if path == "/":
                return self._send(PAGE.encode(), "text/html; charset=utf-8")
            if path == "/status":
                s = self.engine.status()
                return self._json({"files": s["files"], "chunks": s["chunks"]})
            if path == "/files":
                rows = self.engine.list_files().collect()
                return self._json({"files": [{"path": r["path"], "modtime": r["modified_ns"], "chunks": r["chunks"]} for r in rows]})
            if path == "/query":
                return self._fail(400, bad) if bad else self._query(body)
            if path == "/remove":
                if bad or not str(body.get("path") or "").strip():
                    return self._fail(400, bad or "bad request: path required")
                files, chunks = self.engine.remove(body["path"])
                return self._json({"removedFiles": len(files), "removedChunks": chunks})
            if path == "/refresh":
                done = self.engine.refresh(body.get("paths") or [])
                return self._json({"pruned": len(done.deleted), "indexed": sum(not r.skipped for r in done.indexed)})
            if path == "/clear":
                self.engine.clear()
                return self._json({"ok": True})
            return self._fail(404, "not found")
        except (BrokenPipeError, ConnectionResetError):
            return None
        except Exception as e:  # noqa: BLE001
            return self._fail(500, str(e))

    def _query(self, body: dict[str, Any]) -> None:
        question, k = str(body.get("question") or ""), body.get("k")
        k = k if isinstance(k, int) and k > 0 else 5
        if "text/event-stream" not in (self.headers.get("Accept") or ""):
            answer = self.engine.ask(question, k)
            return self._json({"answer": answer.text, "sources": sources_json(answer.sources)})
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.send_header("Cache-Control", "no-cache")
        self.send_header("Connection", "close")
        self.end_headers()
        self.close_connection = True
        stream = events(self.engine, question, k)
        try:
            for event in stream:
                self.wfile.write(f"data: {json.dumps(event)}\n\n".encode())
                self.wfile.flush()
        finally:
            stream.close()
        return None


def serve(engine: Engine, host: str = "localhost", port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"engine": engine}))
