"""The command line: index, query, search, list, refresh, remove, clear, status, serve."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tesserine.operators import embedding, generate
from tesserine.plans.engine import Engine
from tesserine.sources.files import parse_extensions

HOME = os.path.join(os.path.expanduser("~"), ".tesserine")


def human(n: int) -> str:
    size, units = float(n), iter("KMGTPE")
    if n < 1024:
        return f"{n} B"
    while size >= 1024:
        size, unit = size / 1024, next(units)
    return f"{size:.1f} {unit}B"


def snippet(text: str, n: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= n else f"{flat[:n]}…"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tesserine", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--store", default=HOME, help="folder of the store")
    common.add_argument("--index-type", choices=("hnsw", "flat"), default="hnsw")
    model = argparse.ArgumentParser(add_help=False)
    model.add_argument("--embed", default="", help="embedding model of a program")
    model.add_argument("--bin", default="", help="embedding program, or the URL of a server")
    gen = argparse.ArgumentParser(add_help=False)
    gen.add_argument("--gen", default="", help="generation model")
    gen.add_argument("--llama", default="", help="generation program")
    sub = out.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", parents=[common, model], help="index files and folders")
    p.add_argument("paths", nargs="+")
    p.add_argument("--ext", default="", help="extensions, separated by commas")
    p = sub.add_parser("query", parents=[common, model, gen], help="answer a question")
    p.add_argument("question")
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--stream", action="store_true")
    p.add_argument("--sources", action="store_true")
    p = sub.add_parser("search", parents=[common, model], help="show the best chunks")
    p.add_argument("question")
    p.add_argument("-k", type=int, default=5)
    sub.add_parser("list", parents=[common], help="show the files")
    p = sub.add_parser("refresh", parents=[common, model], help="follow changes of the files")
    p.add_argument("paths", nargs="*")
    p = sub.add_parser("remove", aliases=["rm"], parents=[common], help="drop files or folders")
    p.add_argument("paths", nargs="+")
    p = sub.add_parser("clear", parents=[common], help="drop everything")
    p.add_argument("--yes", action="store_true")
    sub.add_parser("status", parents=[common], help="show sizes")
    p = sub.add_parser("serve", parents=[common, model, gen], help="answer over HTTP")
    p.add_argument("--addr", default="localhost:8080")
    sub.add_parser("help", help="show this text")
    return out


def engine_of(args: argparse.Namespace, spark: SparkSession | None = None) -> Engine:
    spark = spark or SparkSession.builder.appName("tesserine").getOrCreate()
    embedder = None
    if getattr(args, "embed", "") or getattr(args, "bin", ""):
        url = args.bin if args.bin.startswith("http") else ""
        embedder = embedding.detect(args.embed, "llama-embedding" if url or not args.bin else args.bin, url)
    generator = generate.ProgramGenerator(args.gen, args.llama) if getattr(args, "gen", "") else None
    return Engine(spark, args.store, embedder, generator, args.index_type, extensions=parse_extensions(getattr(args, "ext", "")))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    out = parser()
    try:
        args = out.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command == "help":
        out.print_help()
        return 0
    if args.command == "clear" and not args.yes and input(f"Drop everything in {args.store}? [y/N] ").strip().lower() not in ("y", "yes"):
        print("Nothing done.")
        return 0
    engine = engine_of(args, spark)
    return {"index": _index, "query": _query, "search": _search, "list": _list, "refresh": _refresh, "remove": _remove, "rm": _remove, "clear": _clear, "status": _status, "serve": _serve}[args.command](engine, args)


def _index(engine: Engine, args: argparse.Namespace) -> int:
    done = engine.index(args.paths)
    for r in done:
        pages = f", {r.pages} pages" if r.pages else ""
        print(f"  {r.path}: unchanged" if r.skipped else f"  {r.path}: {r.chunks} chunks{pages}")
    print(f"Indexed {sum(not r.skipped for r in done)} files, {sum(r.chunks for r in done)} chunks; {sum(r.skipped for r in done)} unchanged.")
    return 0


def _query(engine: Engine, args: argparse.Namespace) -> int:
    if args.stream:
        sources, pieces = engine.ask_stream(args.question, args.k)
        for piece in pieces:
            print(piece, end="", flush=True)
        print()
    else:
        answer = engine.ask(args.question, args.k)
        sources = answer.sources
        print(answer.text)
    if args.sources:
        for s in sources:
            print(f"  {s.source}{f', page {s.page}' if s.page else ''} ({s.score:.3f})")
    return 0


def _search(engine: Engine, args: argparse.Namespace) -> int:
    found = engine.retrieve(args.question, args.k)
    for n, s in enumerate(found, 1):
        print(f"{n}. {s.source}{f', page {s.page}' if s.page else ''} ({s.score:.3f})\n   {snippet(s.text, 160)}")
    if not found:
        print("No matches.")
    return 0


def _list(engine: Engine, args: argparse.Namespace) -> int:
    rows = engine.list_files().collect()
    for r in rows:
        print(f"{r['chunks']:6d}  {r['path']}")
    print(f"{len(rows)} files, {sum(r['chunks'] for r in rows)} chunks." if rows else "No files indexed.")
    return 0


def _refresh(engine: Engine, args: argparse.Namespace) -> int:
    done = engine.refresh(args.paths)
    print(f"Pruned {len(done.deleted)}, indexed {sum(not r.skipped for r in done.indexed)}, unchanged {sum(r.skipped for r in done.indexed)}.")
    return 0


def _remove(engine: Engine, args: argparse.Namespace) -> int:
    for path in args.paths:
        files, chunks = engine.remove(path)
        print(f"Removed {len(files)} files, {chunks} chunks." if files else f"Nothing indexed under {path}.")
    return 0


def _clear(engine: Engine, args: argparse.Namespace) -> int:
    engine.clear()
    print("Cleared.")
    return 0


def _status(engine: Engine, args: argparse.Namespace) -> int:
    s = engine.status()
    print(f"files   {s['files']}\nchunks  {s['chunks']}\nindex   {s['index_type']}\nsize    {human(s['bytes'])}")
    return 0


def _serve(engine: Engine, args: argparse.Namespace) -> int:
    from tesserine.server import serve

    host, _, port = args.addr.rpartition(":")
    server = serve(engine, host or "localhost", int(port))
    print(f"http://{args.addr}")
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.shutdown()
    return 0


if __name__ == "__main__":
    sys.exit(main())
