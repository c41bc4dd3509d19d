from tesserine.operators.extract import extract, split_units, strip_markdown
from tesserine.sources import files


def write(root, **found):
    for name, data in found.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())


def read(spark, root, extensions=(), **options):
    listing = files.list_files(spark, [str(root)], extensions)
    return {r["path"].rsplit("/", 1)[1]: r for r in extract(files.read_files(spark, [str(root)], listing), **options).collect()}


def test_text_is_verbatim_and_has_a_time(spark, tmp_path):
    write(tmp_path, notes_dot_txt="hello world\nsecond line")
    row = read(spark, tmp_path)["notes.txt"]
    assert (row["format"], row["content"], row["pages"]) == ("text", "hello world\nsecond line", None)
    assert row["modified_ns"] // 10**6 == (tmp_path / "notes.txt").stat().st_mtime_ns // 10**6


def test_markdown_loses_marks_and_keeps_fences():
    text = "# Title\nSome **bold** _it_ `code` and [a link](http://x.y).\n![alt](i.png)\n```go\nfunc a_b() {}\n```\n> quoted\n> > twice\n- item\n* other\n---\nsnake_case\n~~~\n```\n~~~"
    assert strip_markdown(text) == "Title\nSome bold it code and a link.\nalt\nfunc a_b() {}\nquoted\ntwice\nitem\nother\n\nsnakecase\n```"


def test_code_units():
    assert split_units("package main\nfunc a() {}\nfunc b() {}\n", ".go") == "package main\n\nfunc a() {}\n\nfunc b() {}\n"
    assert split_units("def a():\n  def b(): pass\n\ndef c(): pass", ".py") == "def a():\n  def b(): pass\n\ndef c(): pass"
    assert split_units("x\n  struct Y", ".rs") == "x\n\n  struct Y" and split_units("x\nfunc y", ".sh") == "x\nfunc y"


def test_code_has_a_header(spark, tmp_path):
    write(tmp_path, x_dot_go="package main\nfunc a() {}\n")
    row = read(spark, tmp_path)["x.go"]
    assert row["format"] == "code" and row["content"] == f"// File: {tmp_path}/x.go\n\npackage main\n\nfunc a() {{}}\n"


def test_walk_prunes_filters_and_drops_blanks(spark, tmp_path):
    write(tmp_path, a_dot_txt="a", b_dot_md="b", c_dot_go="c", node_modules__pkg_dot_txt="no", bin_dot_dat=b"\0\1", blank_dot_txt=" \n", _dot_DS_Store="no", sub__d_dot_TXT="d")
    assert set(read(spark, tmp_path)) == {"a.txt", "b.md", "c.go", "d.TXT"}
    assert set(read(spark, tmp_path, [".md", "go"])) == {"b.md", "c.go"}


def test_a_skipped_root_finds_nothing(spark, tmp_path):
    write(tmp_path, build__a_dot_txt="a")
    assert read(spark, tmp_path / "build") == {}


def test_explicit_files_bypass_filters_but_not_the_sniff(spark, tmp_path):
    write(tmp_path, blob_dot_dat=b"\0\1\2\0", odd_dot_xyz="text")
    assert read(spark, tmp_path / "blob.dat") == {}
    assert read(spark, tmp_path / "odd.xyz")["odd.xyz"]["format"] == "text"


def test_pdf_by_pages_with_a_reader(spark, tmp_path):
    write(tmp_path, p_dot_pdf=b"one\x0ctwo", bad_dot_pdf=b"!")

    def pages(data):
        if data == b"!":
            raise ValueError(data)
        return data.decode().split("\x0c")

    rows = read(spark, tmp_path, pdf=pages)
    assert list(rows) == ["p.pdf"] and rows["p.pdf"]["pages"] == ["one", "two"] and rows["p.pdf"]["content"].startswith("[Page 1]\none")


def test_parse_extensions():
    assert files.parse_extensions(" MD, .go,,") == [".md", ".go"]
