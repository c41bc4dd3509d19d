"""Text functions as Column expressions. Sizes are UTF-8 bytes; white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers after which a model's answer ends, and the separator between prompts of one call.
END_MARKERS = ("[end of text]", "<|end|>", "<|endoftext|>", "</s>", "<|eot_id|>", "<|im_end|>")
SEPARATOR = "<|#SEP#|>"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def words(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def strip_inline(c: Column) -> Column:
    """Links and images become their text; marks of emphasis and code go."""
    return F.translate(unlink(c), "*_`", "")


def unlink(c: Column) -> Column:
    return F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)|!(?=\[)", "$1")


def strip_block(c: Column) -> Column:
    """A line without the marks that begin headings, quotations and lists; a rule becomes blank."""
    line = F.regexp_replace(c, r"^[ \t]+|[ \t]+\z", "")
    plain = F.regexp_replace(F.regexp_replace(line, r"(?U)^(?:>\s*)+", ""), r"(?U)^[-*+] \s*", "")
    plain = F.when(line.startswith(">") | F.regexp_replace(line, r"(?U)^(?:>\s*)+", "").rlike(r"^[-*+] "), trim(plain)).otherwise(plain)
    return F.when(line.isin("---", "***", "___"), "").when(line.startswith("#"), trim(F.regexp_replace(line, r"^#+", ""))).otherwise(plain)


def paragraphs(c: Column) -> Column:
    """Trimmed paragraphs: a break is a line feed followed, but for blanks, by another."""
    return F.filter(F.transform(F.split(c, r"\n[\r \t]*\n"), trim), lambda p: p != "")


def sentence_breaks(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[.?!][ \n]")).cast("long")


def byte_slice(c: Column, begin: Column | int, length: Column | int) -> Column:
    """Bytes of the text, from 1 on."""
    begin, length = (x if isinstance(x, Column) else F.lit(x) for x in (begin, length))
    return F.substring(c.cast("binary"), begin, length)


def byte_tail(c: Column, n: int) -> Column:
    """The last n bytes, or all where n is not positive or not less than the size."""
    raw = c.cast("binary")
    return raw if n <= 0 else F.when(F.octet_length(c) <= n, raw).otherwise(F.substring(raw, F.octet_length(c) - n + 1, F.lit(n)))


def chunk_id(text: Column, source: Column) -> Column:
    """The first 32 hex digits of SHA-256 over 64 bytes of text, a zero byte and the source."""
    return F.left(F.sha2(F.concat(byte_slice(text, 1, 64), F.lit(b"\x00"), source.cast("binary")), 256), F.lit(32))


def sanitize(c: Column) -> Column:
    """One line: line ends and prompt separators become blanks."""
    return trim(F.regexp_replace(c, r"\r\n|\n|\r|\Q" + SEPARATOR + r"\E", " "))


def snippet(c: Column, n: int) -> Column:
    flat = trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def clean_answer(c: Column) -> Column:
    out = trim(c)
    for marker in END_MARKERS:
        out = F.substring_index(out, marker, 1)
    return trim(out)


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}B", F.bround(n / float(1024**power), 1))).otherwise(out)
    return out


def approx_tokens(prompt: Column) -> Column:
    return F.floor(F.octet_length(prompt) / 4).cast("long")


def fnv1a(word: Column) -> Column:
    """FNV-1a of 32 bits over the word's bytes."""
    raw = F.hex(word.cast("binary"))
    at = F.sequence(F.lit(1), F.octet_length(word))
    byte = lambda i: F.conv(F.substring(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: ((h.bitwiseXOR(byte(i))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.when(F.octet_length(word) == 0, F.lit(2166136261)).otherwise(F.aggregate(at, F.lit(2166136261), step))


def extension(path: Column) -> Column:
    """The lower-cased extension of the last part, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
