"""Grounded prompts, and generators that answer them."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
import warnings
from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as tx
from tesserine.schema import GenOptions

#: The prompt's wording.
HEAD = "You are a helpful assistant answering questions about the user's personal files.\nAnswer based only on the provided context. If the context doesn't contain the answer, say so.\n\nContext:\n---\n"
TOO_LONG = 3000


class Generator(Protocol):
    def generate(self, prompt: str, options: GenOptions) -> str: ...

    def stream(self, prompt: str, options: GenOptions) -> Iterator[str]: ...


def build_prompt(question: str, sources: Sequence[tuple[str, int, str]]) -> str:
    """The prompt for a question from (source, page, text). A prompt that may be too long for a small model warns."""
    parts = [f"[Source: {s}, Page {p}]\n{t}\n\n" if p > 0 else f"[Source: {s}]\n{t}\n\n" for s, p, t in sources]
    prompt = f"{HEAD}{''.join(parts)}---\n\nQuestion: {question}\n\nAnswer:"
    if len(prompt.encode("utf-8", "replace")) // 4 > TOO_LONG:
        warnings.warn(f"the prompt is about {len(prompt) // 4} tokens long, which may be too long for a small model", stacklevel=2)
    return prompt


def prompts(hits: DataFrame, by: str, question: str, rank: str = "rank", source: str = "source", page: str = "page_num", text: str = "text") -> DataFrame:
    """(by, prompt, approx_tokens): the same for many questions, one row for each hit."""
    label = F.when(F.col(page) > 0, F.format_string("[Source: %s, Page %d]\n", source, page)).otherwise(F.format_string("[Source: %s]\n", source))
    rows = hits.select(by, question, F.struct(F.col(rank).alias("r"), F.concat(label, F.col(text), F.lit("\n\n")).alias("t")).alias("hit"))
    own = rows.groupBy(by, question).agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    prompt: Column = F.concat(F.lit(HEAD), F.array_join(F.transform("hits", lambda h: h["t"]), ""), F.lit("---\n\nQuestion: "), F.col(question), F.lit("\n\nAnswer:"))
    return own.select(by, prompt.alias("prompt")).withColumn("approx_tokens", tx.approx_tokens(F.col("prompt")))


def clean_answer(text: str) -> str:
    out = text.strip()
    for marker in tx.END_MARKERS:
        out = out.partition(marker)[0]
    return out.strip()


class Extractive:
    """Answers with the context's sentence that shares most words with the question. Needs no model."""

    def generate(self, prompt: str, options: GenOptions) -> str:
        context, _, question = prompt.partition("Context:\n---\n")[2].rpartition("---\n\nQuestion: ")
        wanted = set(re.findall(r"\w+", question.rpartition("\n\nAnswer:")[0].lower()))
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip() and not s.startswith("[Source: ")]
        best = max(sentences, key=lambda s: len(wanted & set(re.findall(r"\w+", s.lower()))), default="")
        return clean_answer(best if wanted & set(re.findall(r"\w+", best.lower())) else "The context does not contain the answer.")

    def stream(self, prompt: str, options: GenOptions) -> Iterator[str]:
        yield from re.findall(r"\S+\s*", self.generate(prompt, options))


class ProgramGenerator:
    """A program that completes a prompt on standard output."""

    def __init__(self, model: str, program: str = ""):
        found = next((p for p in ([program] if program else ["llama-completion", "llama-cli"]) if shutil.which(p)), None)
        if found is None:
            raise RuntimeError(f"no generator: needs {program or 'llama-completion or llama-cli'} in PATH")
        self.model, self.program = model, found

    def arguments(self, prompt: str, options: GenOptions) -> list[str]:
        return [
            self.program, "--model", self.model, "--prompt", prompt, "--n-predict", str(options.n_predict), "--temp", f"{options.temp:g}",
            "--repeat-penalty", f"{options.repeat_penalty:g}", "-st", "--simple-io", "--no-display-prompt",
        ]

    def generate(self, prompt: str, options: GenOptions) -> str:
        done = subprocess.run(self.arguments(prompt, options), capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.program}: {done.stderr.decode(errors='replace').strip()}")
        return clean_answer(done.stdout.decode(errors="replace"))

    def stream(self, prompt: str, options: GenOptions) -> Iterator[str]:
        """Output as it comes. Closing the iterator ends the program."""
        import codecs

        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        with tempfile.TemporaryFile() as said:  # a pipe that nobody reads would fill and stop the program
            run = subprocess.Popen(self.arguments(prompt, options), stdout=subprocess.PIPE, stderr=said)
            try:
                while part := run.stdout.read1(256):
                    yield decode(part)
                if run.wait():
                    said.seek(0)
                    raise RuntimeError(f"{self.program}: {said.read().decode(errors='replace').strip()}")
            finally:
                if run.poll() is None:
                    run.kill()
                    run.wait()
                run.stdout.close()
