"""WARC archives: a distributed writer with revisit records, and a reader that verifies the record chain.

A page may hold the text `WARC/1.1` anywhere, so a reader that splits at that magic is wrong. Here tasks emit every
candidate (offset of a header that parses -> offset of its successor), true or not; pointer jumping from offset 0 of
each file (offsets count unpacked bytes) then marks what the chain reaches, and only those records are returned.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_spread, may_be_in, scratch, written

CRLF = "\r\n"
HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[A-Za-z0-9-]+:[^\r\n]*\r\n)+)\r\n")
#: Equal payloads of at least so many bytes are stored once.
REVISIT_FROM = 0
#: Bytes that one archive file holds at most (a larger record is a file of its own): a file is one task's unit when it is read.
FILE_BYTES = 32 << 20
#: Headers of a record take fewer bytes than this beside its address.
HEAD_BYTES = 512
CANDIDATE = "file string, start long, succ long, size long, record_id string, record_type string, refers_to string, digest string, body_bytes long, body_digest string, stated_bytes long"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of SHA-1, from four groups of 40 bits."""
    groups = [F.conv(F.substring(F.sha1(text), 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    one = lambda v, i: F.substring(F.lit(letters), F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[one(v, i) for v in groups for i in range(8)])


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, html, digest, bytes, first: of a revisit the smallest id of its payload, else null.

    A row's own payload decides, so an identifier that stands for several payloads does not confuse them. Pages whose
    payload no other row has are not shuffled: payloads are counted by digest, and a map of fixed size says which rows may
    be copies. These are looked up with salt, so the hot payload of a large group of copies is spread.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    payload = F.concat("digest", F.lit(":"), F.col("bytes").cast("string"))
    groups = rows.where(F.col("bytes") >= REVISIT_FROM).groupBy(payload.alias("_row_key")).agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1").drop("n"), "payloads")
    marked = may_be_in(rows, payload, groups.select("_row_key"))
    alone = marked.where("NOT _may").withColumn("_first", F.lit(None).cast(dict(groups.dtypes)["_first"]))
    copies = lookup_spread(marked.where("_may"), groups, ["_row_key"], ["id", "url"], how="left")
    first = F.when(F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first")), F.col("_first"))
    both = alone.unionByName(copies.select(*alone.columns))
    return both.select("id", "url", "html", "digest", "bytes", first.alias("first"))


def write_warc(pages: DataFrame, folder: str, **columns: str) -> None:
    """One record per row of pages into gzip files under folder, by Spark's committed writer.

    Null html is an empty payload, null url an empty target. Of equal payloads, rows with the smallest
    identifier are responses, all of them if it is repeated; rows without an identifier revisit it, and are responses where
    no row of the payload has one. A null identifier is written as an empty record id. An empty table writes a folder without records.

    Records are dealt to files by size class (powers of 4) and by their row in the task, so many that even if all were
    as large as their class allows a file has FILE_BYTES at most.
    """
    rows = plan_records(pages, **columns)
    revisit = F.col("first").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    fields = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *fields), F.lit(CRLF * 2), body)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    size = F.pow(F.lit(4.0), F.ceil(F.log(4.0, F.octet_length(body) + F.octet_length("url") + F.lit(HEAD_BYTES))))
    chunk = F.floor(row * size / F.lit(FILE_BYTES))
    out = rows.select(record.alias("value"), size.cast("long").alias("size"), chunk.alias("chunk"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").partitionBy("size", "chunk").text(folder)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    for batch in batches:
        for file, data in zip(batch["path"], batch["content"], strict=True):
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            out = []
            for m in HEAD.finditer(data):
                head = dict(x.split(": ", 1) for x in m[1].decode("utf-8", "replace").split(CRLF) if ": " in x)
                size = head.get("Content-Length", "")
                if not size.isdigit():
                    continue
                body = data[m.end() : m.end() + int(size)]
                whole = len(body) == int(size)
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None
                bare = lambda k: head.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None  # noqa: E731, B023
                stated = head.get("X-Payload-Length", "")
                out.append((file, m.start(), m.end() + int(size) + 4, len(data), bare("WARC-Record-ID"), head.get("WARC-Type"), bare("WARC-Refers-To"), head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), len(body), digest, int(stated) if stated.isdigit() else None))
            yield pd.DataFrame(out, columns=names)


def reachable(start: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Which offsets the chain from 0 reaches, by pointer jumping: each round doubles the length of every jump.

    start is sorted and distinct; a successor that is no candidate ends its chain.
    """
    n = len(start)
    at = np.searchsorted(start, succ)
    hop = np.where((at < n) & (start[np.minimum(at, n - 1)] == succ), at, n) if n else at
    hop = np.append(hop, n)
    mark = np.zeros(n + 1, bool)
    mark[:1] = n > 0 and start[0] == 0
    for _ in range(n.bit_length() + 1):
        mark[hop[mark]] = True
        hop = hop[hop]
    return mark[:n]


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("start").drop_duplicates("start")
    return group[reachable(group["start"].to_numpy(np.int64), group["succ"].to_numpy(np.int64))]


def read_warc(spark, folder: str) -> DataFrame:
    """The true records of all files under folder. A file is bounded by the writer (FILE_BYTES, or one larger record);
    one row per candidate header, without payloads, is what meets per file for the jumps."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    found = files.mapInPandas(_candidates, CANDIDATE)
    return found.groupBy("file").applyInPandas(_chain, CANDIDATE)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = dict(pages.dtypes)["page_id"]
    folder = scratch(spark, "warc")
    write_warc(pages, folder)
    back = read_warc(spark, folder)
    response = F.col("record_type") == "response"
    return back.select(
        F.col("record_id").cast(kind).alias("page_id"),
        F.when(response, F.col("body_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("body_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, (unhex(h)::BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           16 * (substr(bits, (5 * i + 1)::BIGINT, 1) = '1')::INT + 8 * (substr(bits, (5 * i + 2)::BIGINT, 1) = '1')::INT
           + 4 * (substr(bits, (5 * i + 3)::BIGINT, 1) = '1')::INT + 2 * (substr(bits, (5 * i + 4)::BIGINT, 1) = '1')::INT
           + (substr(bits, (5 * i + 5)::BIGINT, 1) = '1')::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
