"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "\n\n[... truncated ...]\n\n"
SAMPLE_FROM, SAMPLE, SAMPLES = 1 << 20, 4096, 16


def slugify(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(F.trim(kept), r"\s+", "-")


def display_title(title: Column, path: Column) -> Column:
    """The title, or the file name as words with a capital first."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")
    words = F.translate(name, "-_", "  ")
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.upper(words.substr(1, 1)), words.substr(F.lit(2), F.length(words))))


def content_hash(content: Column, sampled: bool = False) -> Column:
    """64 hex digits over all content; sampled: of large content over head, strided samples, tail and length."""
    data = content.cast("binary")
    if not sampled:
        return F.sha2(data, 256)
    n = F.octet_length(data)
    stride = F.floor((n - SAMPLE) / (SAMPLES - 1)).cast("int")
    pieces = [F.substring(data, stride * i + 1, F.lit(SAMPLE)) for i in range(SAMPLES - 1)] + [F.substring(data, n - SAMPLE + 1, F.lit(SAMPLE))]
    sampled = F.concat(*pieces, n.cast("string").cast("binary"))
    return F.when(n <= SAMPLE_FROM, F.sha2(data, 256)).otherwise(F.sha2(sampled, 256))


def excerpt(body: Column, query: Column, around: int = 100) -> Column:
    """Characters around the first case-insensitive hit, else the first 200."""
    at = F.position(F.lower(query), F.lower(body))
    start = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(at - 1 + F.length(query) + around, F.length(body))
    hit = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body.substr(start + 1, end - start), F.lit("..."))
    return F.when(at > 0, hit).otherwise(F.concat(body.substr(1, 200), F.lit("...")))


def truncate_structured(text: Column, most: int) -> Column:
    """Front matter, then half of what room is left from the head and half from the tail around a marker; never more
    than most characters."""
    front = F.regexp_extract(text, r"^(---\n(?s:.*?)\n---\n)", 1)
    room = F.lit(most - len(MARKER)) - F.length(front)
    half = F.floor(room / 2).cast("int")
    body = text.substr(F.length(front) + 1, F.length(text))
    cut = F.concat(front, body.substr(F.lit(1), half), F.lit(MARKER), body.substr(F.length(body) - half + 1, half))
    return F.when(F.length(text) <= most, text).when(room < 2, text.substr(1, most)).otherwise(cut)


def heading_positions(text: Column) -> Column:
    """Character offsets of lines that begin with '#'."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        found = F.when(line.startswith("#"), F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), found.alias("found"))

    return F.aggregate(lines, start, step)["found"]


def truncated(text: Column, most: int) -> tuple[Column, Column]:
    """The first characters, and whether there were more."""
    return text.substr(1, most), F.length(text) > most
