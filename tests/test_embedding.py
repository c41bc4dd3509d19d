import math
import sys

import numpy as np
import pytest

from tesserine.operators import embedding as em
from tesserine.operators import generate


def test_similar_texts_are_closer():
    a, b, c = em.BagOfWords(128).embed(["the cat sat on the mat", "the cat lay on the mat", "quantum field theory"])
    assert np.dot(a, b) > np.dot(a, c) and abs(np.linalg.norm(a) - 1) < 1e-6


def test_unit():
    assert em.unit([3, 4]) == pytest.approx([0.6, 0.8]) and em.unit([0, 0]) == [0, 0]


@pytest.mark.parametrize(
    "raw",
    ['{"object":"list","data":[{"embedding":[1,2]},{"embedding":[3,4]}]}', "[[1,2],[3,4]]", "1 2\nlog: loaded\n3 4\n", '  [[1, 2], [3, 4]]  '],
)
def test_program_output_of_two(raw):
    assert em.parse_program_output(raw) == [[1, 2], [3, 4]]


@pytest.mark.parametrize("raw", ['{"embedding":[1,2]}', "[1,2]", "1 2"])
def test_program_output_of_one(raw):
    assert em.parse_program_output(raw) == [[1, 2]]


@pytest.mark.parametrize("raw", ["", "{}", "[]", "words only", '{"data":[]}'])
def test_program_output_of_none(raw):
    with pytest.raises(ValueError):
        em.parse_program_output(raw)


@pytest.mark.parametrize("raw", ['[{"embedding":[1,2]}]', '{"embedding":[1,2]}', '{"data":[{"embedding":[1,2]}]}', '[{"embedding":[[1,2],[9,9]]}]'])
def test_server_shapes(raw):
    assert em.parse_server_response(raw) == [[1, 2]]


def test_server_refuses_others():
    with pytest.raises(ValueError, match="no known shape"):
        em.parse_server_response('{"error": 1}')


def test_no_backend_is_an_error():
    with pytest.raises(RuntimeError, match="no embedder"):
        em.detect("m", "surely-not-a-program")


def test_one_line():
    assert em.one_line(" a\r\nb\nc\rd ") == "a b c d"


def test_udf_and_native_bags_agree(spark):
    from tesserine.functions import text as tx

    df = spark.createDataFrame([(1, "Hello hello wörld"), (2, ""), (3, None)], "id long, text string")
    dense = {r["id"]: r["vec"] for r in em.embed(df, em.BagOfWords(64)).collect()}
    sparse = em.buckets(df, "id", tx.words(tx.trim(df["text"])), 64).collect()
    assert {r["bucket"]: round(r["w"], 6) for r in sparse if r["id"] == 1} == {k: round(v, 6) for k, v in enumerate(dense[1]) if v}
    bags = em.bags(df, "id", "text", 64).collect()
    assert sorted((r["bucket"], round(r["w"], 9)) for r in bags) == sorted((r["bucket"], round(r["w"], 9)) for r in sparse)
    assert not any(dense[2]) and not any(dense[3]) and math.isclose(np.linalg.norm(dense[1]), 1, rel_tol=1e-6)


def test_server_embedder_over_http():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class H(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["content"]
            body = json.dumps([{"embedding": [len(t), 0]} for t in texts]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = em.ServerEmbedder(f"http://127.0.0.1:{server.server_port}")
    assert e.dims() == 2 and e.embed(["abc"] * 40) == [[1, 0]] * 40
    server.shutdown()


def _program(path, body):
    path.write_text(f"#!{sys.executable}\nimport sys\n{body}")
    path.chmod(0o755)
    return str(path)


def test_program_embedder_passes_the_flags_that_print_vectors(tmp_path):
    body = """
args = sys.argv[1:]
assert "--log-disable" not in args and args[args.index("--embd-normalize") + 1] == "2" and args[args.index("--embd-output-format") + 1] == "json", args
parts = open(args[args.index("--file") + 1]).read().rstrip("\\n").split(args[args.index("--embd-separator") + 1])
print([[float(len(x)), 1.0] for x in parts])
"""
    made = em.ProgramEmbedder("m", _program(tmp_path / "embed", body))
    assert made.dims() == 2
    got = made.embed(["ab", "a line\nand another"])
    assert len(got) == 2 and got[0][0] / got[0][1] == pytest.approx(2.0)


def test_program_generator_that_logs_much_does_not_stall(tmp_path):
    body = """
sys.stderr.write("log " * 500_000)
sys.stderr.flush()
print("one two")
"""
    made = generate.ProgramGenerator("m", _program(tmp_path / "gen", body))
    assert "".join(made.stream("p", generate.GenOptions())).strip() == "one two"
