"""Tokens of the search index: split at what is no letter, digit or private-use mark, folded, perhaps stemmed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.porter import stem

FIELDS = ("title", "description", "headings", "body", "type")
#: Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def fold(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), ACCENTED, PLAIN)


def fold_text(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@pandas_udf(StringType())
def stemmed(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


def _arrays(docs: DataFrame, ascii_only: bool) -> DataFrame:
    """path, dl, and each field's terms in order."""
    pattern = "[a-z0-9]+" if ascii_only else r"[\p{L}\p{N}\p{Co}]+"
    text = (lambda c: F.lower(c)) if ascii_only else fold
    terms = [F.regexp_extract_all(text(F.coalesce(F.col(f), F.lit(""))), F.lit(pattern), F.lit(0)).alias(f) for f in FIELDS]
    return docs.select("path", *terms).select("path", sum(F.size(f) for f in FIELDS).cast("long").alias("dl"), *FIELDS)


def token_rows(docs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """path, dl, field, pos, term of docs(path, *FIELDS): positions from 0 in each field, unstemmed; dl is the document's
    number of tokens, which each row has, so that no score has to look it up."""
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in FIELDS]
    rows = _arrays(docs, ascii_only).select("path", "dl", F.array(*fields).alias("x"))
    rows = rows.select("path", "dl", F.explode_outer("x").alias("x"))  # not explode, for which Spark tests sizes below and makes the terms again
    return rows.select("path", "dl", "x.field", F.posexplode_outer("x.terms").alias("pos", "term")).where("term IS NOT NULL")


def lengths_of(docs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """path, dl of each row of docs."""
    return _arrays(docs, ascii_only).select("path", "dl")


def entry_rows(docs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The entries of docs' unstemmed terms, made row by row: sorting a document's own tokens brings those of a term
    together, so nothing is shuffled. Rows that share a path are not brought together."""
    mark = lambda j: lambda t, i: F.struct(t.alias("term"), F.lit(j).alias("f"), i.alias("pos"))
    tagged = [F.transform(f, mark(j)) for j, f in enumerate(FIELDS)]
    rows = _arrays(docs, ascii_only).select("path", "dl", F.sort_array(F.concat(*tagged)).alias("z"))
    first = lambda x, i: F.when((i == 0) | (x["term"] != F.get("z", i - 1)["term"]), i)
    rows = rows.select("path", "dl", "z", F.array_compact(F.transform("z", first)).alias("at"))
    runs = F.transform("at", lambda s, k: F.slice("z", s + 1, F.coalesce(F.get("at", k + 1), F.size("z")) - s))
    rows = rows.select("path", "dl", F.explode_outer(runs).alias("run")).where("run IS NOT NULL")
    return _by_field(rows.select("path", "dl", F.col("run")[0]["term"].alias("term"), "run"))


def entries_of(tokens: DataFrame) -> DataFrame:
    """The entries of any tokens(path, dl, field, pos, term)."""
    f = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")) - 1
    rows = tokens.groupBy("path", "dl", "term").agg(F.sort_array(F.collect_list(F.struct(f.cast("int").alias("f"), "pos"))).alias("run"))
    return _by_field(rows)


def _by_field(rows: DataFrame) -> DataFrame:
    """path, dl, term, the term's count in each field, field, at (its positions there), lead (the first of the term's
    fields, so that each term of a document has one such row) of rows(path, dl, term, run of (f, pos))."""
    is_of = lambda j: lambda x: x["f"] == j
    for j, name in enumerate(FIELDS):
        rows = rows.withColumn(f"at_{name}", F.transform(F.filter("run", is_of(j)), lambda x: x["pos"]))
    counts = [F.size(f"at_{f}").alias(f"in_{f}") for f in FIELDS]
    held = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"at_{f}").alias("at")) for f in FIELDS]), lambda x: F.size(x["at"]) > 0)
    rows = rows.select("path", "dl", "term", *counts, F.posexplode_outer(held).alias("k", "x"))
    return rows.select("path", "dl", "term", *[f"in_{f}" for f in FIELDS], "x.field", "x.at", (F.col("k") == 0).alias("lead"))


def stem_rows(tokens: DataFrame) -> DataFrame:
    """Terms stemmed: Python sees each distinct term once."""
    table = tokens.select("term").distinct().withColumn("stem", stemmed("term"))
    return tokens.join(table, "term").select("path", "dl", "field", "pos", F.col("stem").alias("term"))
