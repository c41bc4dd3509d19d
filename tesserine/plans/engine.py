"""The engine: index files, keep the index up to date, retrieve, answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import embedding, extract, generate
from tesserine.operators.chunking import chunk
from tesserine.operators.store import Store
from tesserine.schema import ChunkConfig, GenOptions, HnswConfig
from tesserine.sources import files


@dataclass(frozen=True)
class Source:
    source: str
    page: int
    score: float
    text: str


@dataclass(frozen=True)
class Answer:
    text: str
    sources: list[Source] = field(default_factory=list)


@dataclass(frozen=True)
class FileResult:
    path: str
    chunks: int
    pages: int
    skipped: bool


@dataclass(frozen=True)
class RefreshResult:
    deleted: list[str]
    indexed: list[FileResult]


def changes(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, modified_ns, action): new, changed, unchanged or deleted. Any other time of change counts, older ones too."""
    now = listing.select("path", F.col("modified_ns").alias("now"))
    was = manifest.select("path", F.col("modified_ns").alias("was"))
    action = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged")
    return now.join(was, "path", "full_outer").select("path", F.coalesce("now", "was").alias("modified_ns"), action.alias("action"))


def _changed(batches):  # noqa: ANN001, ANN202
    """(path, gone) of the files that are no longer there or have another time of change."""
    import os

    import pyarrow as pa

    for batch in batches:
        out: list[tuple[str, bool]] = []
        for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                if os.stat(path).st_mtime_ns // 1_000_000 != at // 1_000_000:
                    out.append((path, False))
            except FileNotFoundError:
                out.append((path, True))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([g for _, g in out], pa.bool_())], names=["path", "gone"])


class Engine:
    def __init__(self, spark: SparkSession, store: str, embedder: embedding.Embedder | None = None, generator: generate.Generator | None = None, index_type: str = "hnsw", config: ChunkConfig | None = None, extensions: Sequence[str] = (), options: GenOptions | None = None, hnsw_config: HnswConfig | None = None, pdf: extract.PdfReader = extract.pdf_pages):
        self.spark, self.store = spark, Store(spark, store, index_type, hnsw_config)
        self.embedder, self.generator = embedder or embedding.BagOfWords(), generator or generate.Extractive()
        self.config, self.extensions, self.options, self.pdf = config or ChunkConfig(), list(extensions), options or GenOptions(), pdf

    def index(self, paths: Sequence[str]) -> list[FileResult]:
        """Index what is new or changed among files and folders. Contents are read after that is known."""
        listing = files.list_files(self.spark, paths, self.extensions)
        return self._index(paths, listing)

    def _index(self, paths: Sequence[str], listing: DataFrame) -> list[FileResult]:
        with self.store.writing():
            plan = changes(listing, self.store.snapshot().manifest).filter("action <> 'deleted'").persist()
            try:
                todo = plan.filter("action <> 'unchanged'")
                skipped = [FileResult(r["path"], 0, 0, True) for r in plan.filter("action = 'unchanged'").orderBy("path").collect()]
                if todo.isEmpty():
                    return skipped
                single = self._single(paths)
                found = extract.extract(files.read_files(self.spark, paths, todo), self.pdf, keep_blank=True)
                found = found.filter(F.col("path").isin(*single) | F.col("content").rlike(r"(?U)\S")) if single else found.filter(F.col("content").rlike(r"(?U)\S"))
                docs = found.persist()
                try:
                    pieces = embedding.embed(chunk(docs, self.config), self.embedder)
                    marked = docs.select("path", "modified_ns")
                    gone = plan.filter("action = 'changed'").select("path")
                    now = self.store.add(pieces, marked, gone)
                    pages = docs.select("path", F.coalesce(F.size("pages"), F.lit(0)).alias("pages"))
                    counts = now.chunks.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("n"))
                    rows = pages.join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"), F.greatest("pages", F.lit(0)).alias("pages")).orderBy("path").collect()
                finally:
                    docs.unpersist()
                return skipped + [FileResult(r["path"], r["n"], r["pages"], False) for r in rows]
            finally:
                plan.unpersist()

    @staticmethod
    def _single(paths: Sequence[str]) -> list[str]:
        import os

        return [p for p in map(files.clean, paths) if os.path.isfile(p)]

    def refresh(self, paths: Sequence[str] = ()) -> RefreshResult:
        """Drop files that are gone, index again what changed, and index what is new under the paths."""
        with self.store.writing():
            # Every known file is looked at where the tasks run; the driver sees only those that are gone or changed.
            other = self.store.snapshot().manifest.select("path", "modified_ns").mapInArrow(_changed, "path string, gone boolean").collect()
            gone = [r["path"] for r in other if r["gone"]]
            moved = [r["path"] for r in other if not r["gone"]]
            self.store.remove_files(gone)
            todo = [*paths, *moved]
            done = self._index(todo, files.list_files(self.spark, todo, self.extensions)) if todo else []
        return RefreshResult(sorted(gone), done)

    def remove(self, target: str) -> tuple[list[str], int]:
        return self.store.remove(target)

    def clear(self) -> None:
        self.store.clear()

    def list_files(self) -> DataFrame:
        return self.store.files()

    def status(self) -> dict:
        return self.store.status()

    def retrieve(self, question: str, k: int = 5) -> list[Source]:
        hits = self.store.search(self.embedder.embed([question])[0], k)
        return [Source(r["source"], r["page_num"], float(r["score"]), r["text"]) for r in hits.collect()]

    def prompt(self, question: str, sources: Sequence[Source]) -> str:
        return generate.build_prompt(question, [(s.source, s.page, s.text) for s in sources])

    def ask(self, question: str, k: int = 5) -> Answer:
        sources = self.retrieve(question, k)
        return Answer(self.generator.generate(self.prompt(question, sources), self.options), sources)

    def ask_stream(self, question: str, k: int = 5) -> tuple[list[Source], Iterator[str]]:
        """Sources, and the answer piece by piece; closing the iterator stops the generator."""
        sources = self.retrieve(question, k)
        return sources, self.generator.stream(self.prompt(question, sources), self.options)

    def query(self, question: str, k: int = 5) -> str:
        return self.ask(question, k).text
