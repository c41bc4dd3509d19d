"""Text from files of each format."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine import schema
from tesserine.functions import text as tx
from tesserine.operators.chunking import repair

#: What begins a unit of code, by extension; True where indented lines count too.
UNITS: dict[str, tuple[tuple[str, ...], bool]] = {
    ".go": (("func ",), False),
    ".py": (("def ", "class "), False),
    ".rs": (("fn ", "pub fn ", "impl ", "struct "), True),
    ".js": (("function ", "export function ", "class ", "export class "), True),
    ".ts": (("function ", "export function ", "class ", "export class "), True),
    ".java": (("class ", "struct "), True),
    ".cpp": (("class ", "struct "), True),
    ".c": (("class ", "struct "), True),
    ".h": (("class ", "struct "), True),
    ".rb": (("def ", "class ", "module "), True),
}
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)|!(?=\[)")
_INLINE = str.maketrans("", "", "*_`")


def format_of(path: Column) -> Column:
    """pdf, markdown, code, text, or empty for what no extension tells."""
    ext = tx.extension(path)
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*schema.MARKDOWN), "markdown").when(ext.isin(*schema.CODE), "code").when(ext.isin(*schema.TEXT), "text").otherwise("")


def is_binary(content: Column) -> Column:
    """A zero byte among the first 512."""
    return F.contains(F.substring(content, 1, 512), F.lit(b"\x00"))


def _block(line: str) -> str:
    text = line.strip(" \t")
    if text in ("---", "***", "___"):
        return ""
    if text[:1] == "#":
        return text.lstrip("#").strip()
    while text[:1] == ">":
        text = text[1:].strip()
    return text[2:].strip() if text[:2] in ("- ", "* ", "+ ") else text


def strip_markdown(source: str) -> str:
    """Markdown without its marks; lines within fences stay as they are, fences go."""
    out, fence = [], None
    for line in source.split("\n"):
        mark = line.strip()[:3]
        if fence is None and mark in ("```", "~~~"):
            fence = mark
        elif fence is None:
            out.append(_LINK.sub(r"\1", _block(line)).translate(_INLINE))
        elif mark == fence:
            fence = None
        else:
            out.append(line)
    return "\n".join(out)


def split_units(source: str, ext: str) -> str:
    """Code with a blank line before each unit, unless one is there."""
    starts, indented = UNITS.get(ext, ((), False))
    out: list[str] = []
    for line in source.split("\n"):
        if out and starts and (line.strip() if indented else line).startswith(starts) and out[-1].strip():
            out.append("")
        out.append(line)
    return "\n".join(out)


def unit_breaks(lines: DataFrame, by: list[str], order: str, line: str, ext: str) -> DataFrame:
    """The same over a table of lines: `breaks` tells where a blank line goes in."""
    starts, indented = UNITS.get(ext, ((), False))
    at = tx.trim(F.col(line)) if indented else F.col(line)
    begins = F.lit(False)
    for x in starts:
        begins = begins | at.startswith(x)
    before = F.lag(line).over(Window.partitionBy(*by).orderBy(order))
    return lines.withColumn("breaks", begins & before.isNotNull() & ~tx.is_blank(before))


PdfReader = Callable[[bytes], list[str]]


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page; empty where a page has none. Needs pypdf, which is optional."""
    try:
        from pypdf import PdfReader as Reader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf, or a reader of your own: extract(..., pdf=reader)") from e
    import io

    out = []
    for page in Reader(io.BytesIO(data)).pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  one bad page does not spoil the rest
            out.append("")
    return out


def extract(files: DataFrame, pdf: PdfReader = pdf_pages, sniff_all: bool = False, keep_blank: bool = False) -> DataFrame:
    """Documents from files (path, content, modified_ns): text as it is, Markdown without marks, code under a header, PDF by pages.

    Files of unknown type are text, and dropped if binary; with sniff_all every type but PDF is. Blank documents are dropped unless
    keep_blank. A PDF that cannot be read is dropped.
    """
    import pyarrow as pa

    found = files.withColumn("format", format_of(F.col("path")))
    doubt = F.col("format") != "pdf" if sniff_all else F.col("format") == ""
    found = found.filter(~(doubt & is_binary(F.col("content")))).withColumn("format", F.when(F.col("format") == "", "text").otherwise(F.col("format")))
    found = found.select("path", "format", "content", "modified_ns", tx.extension(F.col("path")).alias("ext"))

    def read(path: str, kind: str, data: bytes, ext: str) -> tuple[str, list[str] | None]:
        if kind == "pdf":
            pages = pdf(data)
            return "".join(f"[Page {n}]\n{t}\n\n" for n, t in enumerate(pages, 1)), pages
        text = repair(data)
        if kind == "markdown":
            return strip_markdown(text), None
        return (f"// File: {path}\n\n{split_units(text, ext)}", None) if kind == "code" else (text, None)

    def run(batches) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for batch in batches:
            rows = []
            for path, kind, data, modified, ext in zip(*(batch.column(k).to_pylist() for k in range(5))):
                try:
                    text, pages = read(path, kind, data or b"", ext)
                except RuntimeError:
                    raise
                except Exception:  # noqa: BLE001, S112  a file that cannot be read is passed over
                    continue
                if keep_blank or text.strip():
                    rows.append((path, kind, text, pages, modified))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.DOCUMENT.names)

    return found.mapInArrow(run, schema.DOCUMENT)
