"""Chunking: one document to many overlapping pieces, along paragraphs, then sentences, then bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.schema import CHUNK, ChunkConfig

_BLANKS = rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_LEAD, _TRAIL = re.compile(_BLANKS + rb"+"), re.compile(_BLANKS + rb"+\Z")
_PARAGRAPH = re.compile(rb"[\n\r \t]*((?s:.+?))(?=\n[\r \t]*\n|\Z)")
_SENTENCE_END = re.compile(rb"[.?!][ \n]")
_JOINT = b"\n\n"

Piece = tuple[bytes, int, int]  # body, first byte, byte after the last


def _trimmed(raw: bytes, at: int) -> Piece | None:
    """A piece without white space around it. Its place passes over plain blanks only."""
    lead = _LEAD.match(raw)
    tail = _TRAIL.search(raw)
    body = raw[lead.end() if lead else 0 : tail.start() if tail else len(raw)]
    if not body or (tail and lead and lead.end() >= len(raw)):
        return None
    begin = at + len(raw) - len(raw.lstrip(b" \t\n\r"))
    return body, begin, begin + len(body)


def paragraphs(text: bytes) -> Iterator[Piece]:
    for m in _PARAGRAPH.finditer(text):
        piece = _trimmed(m[1], m.start(1))
        if piece:
            yield piece


def sentences(piece: Piece, size: int) -> Iterator[Piece]:
    """Runs of sentences no longer than size. A remainder after the last end joins its run whatever its length."""
    body, at, _ = piece
    cuts = [m.end() for m in _SENTENCE_END.finditer(body)]
    begin = done = 0
    for cut in cuts:
        if done > begin and cut - begin > size:
            if run := _trimmed(body[begin:done], at + begin):
                yield run
            begin = done
        done = cut
    if run := _trimmed(body[begin:], at + begin):
        yield run


def windows(piece: Piece, config: ChunkConfig) -> Iterator[Piece]:
    """Overlapping windows; the first that touches the end is the last."""
    body, at, _ = piece
    step = config.chunk_size - config.overlap
    last = max(0, -(-(len(body) - config.chunk_size) // step))
    for k in range(last + 1):
        part = body[k * step : k * step + config.chunk_size]
        yield part, at + k * step, at + k * step + len(part)


def pieces(text: bytes, config: ChunkConfig) -> Iterator[Piece]:
    size = config.chunk_size
    for paragraph in paragraphs(text):
        for run in [paragraph] if len(paragraph[0]) <= size else sentences(paragraph, size):
            yield from [run] if len(run[0]) <= size else windows(run, config)


def merged(parts: Iterable[Piece], size: int) -> Iterator[Piece]:
    """Neighbours joined by a blank line as long as they fit."""
    held: list[bytes] = []
    total = begin = end = 0
    for body, b, e in parts:
        if held and total + len(_JOINT) + len(body) <= size:
            held.append(body)
            total, end = total + len(_JOINT) + len(body), e
            continue
        if held:
            yield _JOINT.join(held), begin, end
        held, total, begin, end = [body], len(body), b, e
    if held:
        yield _JOINT.join(held), begin, end


def chunk_key(text: bytes, source: bytes) -> str:
    return hashlib.sha256(text[:64] + b"\0" + source).hexdigest()[:32]


def repair(raw: bytes) -> str:
    """Text with each byte that is not UTF-8 replaced by U+FFFD."""
    return re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape"))


def split(text: bytes, source: str, config: ChunkConfig) -> Iterator[tuple[str, int, int, bytes]]:
    """(id, start, end, text) of each chunk. Pieces below the least size are dropped and leave the overlap as it was."""
    key, before = source.encode("utf-8", "surrogatepass"), b""
    for body, start, end in merged(pieces(text, config), config.chunk_size):
        if len(body) < config.min_chunk_size:
            continue
        whole = before + _JOINT + body if before else body
        yield chunk_key(whole, key), start, end, whole
        before = body[-config.overlap :]


def chunk(docs: DataFrame, config: ChunkConfig | None = None, source: str = "path", content: str = "content", pages: str | None = "pages") -> DataFrame:
    """Chunks of documents; of each page on its own, numbered from 1, where a document has pages. `ord` counts chunks within a page.

    (source, page_num, ord) is the key: ids repeat, since they depend on the text's first bytes only.
    """
    import pyarrow as pa

    config = config or ChunkConfig()
    whole = F.array(F.struct(F.lit(0).alias("n"), F.col(content).alias("t")))
    if pages and pages in docs.columns:
        each = F.transform(F.col(pages), lambda t, i: F.struct((i + 1).cast("int").alias("n"), t.alias("t")))
        whole = F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, each).otherwise(whole)
    parts = docs.select(F.col(source).alias("source"), F.explode(whole).alias("p")).select("source", "p.n", F.col("p.t").cast("binary").alias("t"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for name, page, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(key, name or "", page, n, start, end, repair(raw)) for n, (key, start, end, raw) in enumerate(split(text or b"", name or "", config))]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=CHUNK.names)

    return parts.mapInArrow(run, CHUNK)


def overlap_carry(segments: DataFrame, by: list[str], order: str, body: str, overlap: int = 64) -> DataFrame:
    """Each segment with the last characters of the one before: the carry-forward as a window."""
    from pyspark.sql import Window

    before = F.lag(body).over(Window.partitionBy(*by).orderBy(order))
    return segments.withColumn("carried", F.when(before.isNull(), F.col(body)).otherwise(F.concat(F.right(before, F.lit(overlap)), F.lit("\n\n"), F.col(body))))
