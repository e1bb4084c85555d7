"""Language identification by Bayesian fusion of evidence.

The log posterior of a language adds: the text's likelihood under letter-trigram models, the likelihood of the
declared markup language, that of the address suffix, and a host prior. Host priors are counts of text-only
decisions, grouped by host and smoothed hierarchically: host towards registered domain towards suffix towards the
whole corpus. The trigram models are fitted on a bounded sample of rows with a declared language; all counts cover
all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_keys, lookup_spread, row_key, summed, written

LANGS = ("en", "fr", "de", "es")
#: Rows that the trigram models are fitted on, in expectation.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 14
#: Trigrams of a text are far from independent: a text counts as so many at most.
EFFECTIVE_GRAMS = 60.0
#: Pseudo-counts that pull a host, a domain and a suffix towards the level above.
PULL = (20.0, 50.0, 200.0)
#: Country suffixes that speak for a language; other suffixes are one class.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "fr": "fr", "be": "fr", "de": "de", "at": "de", "ch": "de", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es"}
CLASSES = (*LANGS, "other", "none")
MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;?", re.S | re.I)
DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", re.I)
#: Bytes of a text that are turned into trigrams at a time.
PIECE = 1 << 20
NOT_LETTER = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of byte trigrams of the lower-cased text, letters and single gaps only.

    The text is taken in pieces, which bounds memory; the last two bytes of each go before the next, so no trigram is lost.
    """
    out, kept = np.zeros(BUCKETS, np.int64), b" "
    for i in range(0, len(text), PIECE):
        raw = text[i : i + PIECE].lower().encode("utf-8", "replace").translate(NOT_LETTER)
        words = b" ".join(raw.split())
        if not words:
            kept = kept if kept[-1:] == b" " else kept + b" "
            continue
        gap = b" " if raw[:1].isspace() and kept[-1:] != b" " else b""
        piece = kept + gap + words + b" " * raw[-1:].isspace()
        out += _gram_buckets(piece)
        kept = piece[-2:]
    if kept[-1:] != b" ":
        out += _gram_buckets(kept + b" ")
    elif len(kept) > 2:  # the gap came with an empty piece
        out += _gram_buckets(kept)
    return out if out.sum() > 1 else np.zeros(BUCKETS, np.int64)  # a single letter is no evidence


def _gram_buckets(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(18), minlength=BUCKETS)


def fit(labelled: DataFrame, langs: tuple[str, ...] = LANGS) -> np.ndarray:
    """Log probabilities [language, bucket] from labelled(key, text, lang); the last row is the flat model of no language.

    SAMPLE_ROWS rows in expectation, drawn by a hash of all three and counted once if repeated, so the answer depends on
    the rows alone, not on the files and tasks in which they lie, and a hot row does not swell the sample.
    """
    n = labelled.count()
    if n > SAMPLE_ROWS:
        share = int(SAMPLE_ROWS / n * (1 << 20))
        labelled = labelled.where(F.pmod(F.xxhash64("key", "text", "lang"), F.lit(1 << 20)) < share).select("key", "text", "lang").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                if text and lang in langs:
                    sums[langs.index(lang)] += gram_counts(text)
        if sums.any():
            yield pd.DataFrame({"sums": [sums.tobytes()]})

    total = np.zeros((len(langs) + 1, BUCKETS))
    total[:-1] = summed(labelled.select("text", "lang").mapInPandas(count, "sums binary"), "sums", np.zeros((len(langs), BUCKETS), np.int64), np.add)
    total += 0.5
    return np.log(total / total.sum(axis=1, keepdims=True))


def _class(lang: str | None) -> int:
    if not lang:
        return len(CLASSES) - 1
    return CLASSES.index(lang.lower()) if lang.lower() in LANGS else CLASSES.index("other")


def features(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows(kind, id, text, markup, declared, host) -> slim evidence of each row, by a map.

    markup rows are stripped of tags, and their declared language is read from the html element.
    """
    weights = np.ascontiguousarray(model.T.astype(np.float64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, i, text, markup, declared, host in zip(b["kind"], b["id"], b["text"], b["markup"], b["declared"], b["host"], strict=True):
                text = text or ""
                if markup:
                    found = DECLARED.search(text)
                    declared = found[1] if found else None
                    text = MARKUP.sub(" ", text)
                counts = gram_counts(text)
                used = np.flatnonzero(counts)
                grams = int(counts.sum())
                scores = counts[used] @ weights[used] / max(1, grams)
                scores *= grams / (1 + grams / EFFECTIVE_GRAMS)
                host = (host or "").lower()
                labels = host.split(".")
                suffix = labels[-1] if len(labels) > 1 else ""
                best = int(scores.argmax()) if grams else len(LANGS)
                out.append((kind, i, host, ".".join(labels[-2:]), suffix, _class(declared), _class(SUFFIXES.get(suffix, "other") if suffix else None), grams, best, scores.tolist()))
            yield pd.DataFrame(out, columns=["kind", "id", "host", "domain", "suffix", "declared", "address", "grams", "best", "scores"])

    return rows.mapInPandas(run, "kind string, id string, host string, domain string, suffix string, declared int, address int, grams long, best int, scores array<double>")


def _counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array(*[F.sum((F.col("best") == i).cast("double")) for i in range(len(LANGS))]).alias(f"n_{key}"))


def _evidence(rows: DataFrame, column: str) -> np.ndarray:
    """log P(class | language), from a table of len(LANGS) x len(CLASSES) cells, whatever the corpus."""
    table = np.ones((len(LANGS), len(CLASSES)))
    for r in rows.where(F.col("best") < len(LANGS)).groupBy("best", column).count().collect():
        table[r["best"], r[column]] += r["count"]
    return np.log(table / table.sum(axis=1, keepdims=True))


def identify(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """kind, id, lang ('und': no language), probability, text_lang, declared, grams for rows(kind, id, text, markup, declared, host).

    Null and empty texts, and texts that the flat model explains best, are 'und'. Null hosts share one empty host.
    Repeated rows are answered each. An empty table gives an empty result.
    """
    kind = dict(rows.dtypes)["id"]
    slim = written(features(rows.withColumn("id", F.col("id").cast("string")), model), "language")  # pandas rounds longs beside nulls
    declared, address = _evidence(slim, "declared"), _evidence(slim, "address")
    whole = np.ones(len(LANGS))
    for r in slim.where(F.col("best") < len(LANGS)).groupBy("best").count().collect():
        whole[r["best"]] += r["count"]
    whole = np.log(whole / whole.sum())

    known = slim.where(F.col("best") < len(LANGS))
    hosts = slim.select("host", "domain", "suffix").distinct().join(_counts(known, "host"), "host", "left")
    hosts = lookup_spread(hosts, _counts(known, "domain"), ["domain"], ["host"], how="left")
    hosts = lookup_spread(hosts, _counts(known, "suffix"), ["suffix"], ["host"], how="left")
    joined = lookup_spread(slim, hosts.drop("domain", "suffix"), ["host"], ["kind", "id"], how="left")

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            prior = np.tile(np.exp(whole), (len(b), 1))
            for level, pull in zip(("suffix", "domain", "host"), PULL[::-1], strict=True):
                seen = np.array([np.zeros(len(LANGS)) if x is None else x for x in b[f"n_{level}"]], float)
                prior = (seen + pull * prior) / (seen.sum(axis=1, keepdims=True) + pull)
            scores = np.array(b["scores"].tolist(), float)
            post = scores[:, :-1] + np.log(prior) + declared[:, b["declared"]].T + address[:, b["address"]].T
            und = scores[:, -1] + np.log(1e-3) + declared.mean(axis=0)[b["declared"]] + address.mean(axis=0)[b["address"]]
            post = np.column_stack([post, und])
            post[b["grams"] == 0, :-1] = -np.inf
            p = np.exp(post - post.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            names = np.array([*LANGS, "und"], object)
            classes = np.array([*LANGS, "other", None], object)
            yield pd.DataFrame({"kind": b["kind"], "id": b["id"], "lang": names[p.argmax(axis=1)], "probability": p.max(axis=1), "text_lang": names[b["best"]], "declared": classes[b["declared"]], "grams": b["grams"]})

    out = joined.mapInPandas(fuse, "kind string, id string, lang string, probability double, text_lang string, declared string, grams long")
    return out.withColumn("id", F.col("id").cast(kind))


def document_rows(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Documents have no markup: their lang column is what is declared, and their source stands for the host."""
    own = F.col("doc_id").cast("long") if key is None else key
    return docs.select(F.lit("document").alias("kind"), own.alias("id"), "text", F.lit(False).alias("markup"), F.col("lang").alias("declared"), F.col("source").cast("string").alias("host"))


def labelled_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("key"), "text", "lang")


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), F.lit(True).alias("markup"), F.lit(None).cast("string").alias("declared"), host.alias("host"))


def keep_languages(docs: DataFrame) -> DataFrame:
    """docs without the rows that have no identified language; all columns stay."""
    key = row_key(docs, "text", "lang", "source")  # all that the decision on a row depends on
    found = identify(document_rows(docs, key), fit(labelled_rows(docs)))
    return drop_keys(docs, key, found.where(F.col("lang") == "und").select(F.col("id").alias("key")))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = identify(document_rows(docs).unionByName(page_rows(pages)), fit(labelled_rows(docs)))
    own = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(own("document").alias("doc_id"), own("page").alias("page_id"), "lang", "probability", "text_lang", "declared", (F.col("lang") != "und").alias("kept"))
