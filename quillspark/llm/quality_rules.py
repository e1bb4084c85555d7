"""Quality rules (DataFrame operations only): counts over words and lines, and a hashed n-gram log-likelihood ratio.

Words, pairs of neighbours and runs of signs are hashed into a fixed number of buckets. Two multinomials over the buckets, one of trusted texts and one of the whole corpus, give each bucket
a log ratio, in whole millionths; a document's score is the mean over all its n-grams. Scores below a fixed threshold
are turned away: no sampling and no noise, and sums of integers, so a verdict does not depend on the layout.

Nothing of a text is shuffled: counts are combined per task into a row a bucket, and the ratios (a number per bucket)
go into the plan as one constant array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A run of what is neither letter, digit nor white space; within or beside words.
SIGNS = r"[^\p{L}\p{N}\s]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
BUCKETS = 10_000
#: A ratio is counted in parts of so much.
UNIT = 1_000_000
#: Mean log ratio below which a text is turned away: its n-grams are on average a third rarer in trusted texts than in
#: the corpus. A language of which there are few trusted texts shifts good texts by some -0.1.
THRESHOLD = -0.4
#: Trusted rows that are used at most, those with the smallest hashes of doc_id: the multinomial is then fixed within a few per cent.
TRUSTED_ROWS = 20_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _joined(runs: Column, apart: int) -> Column:
    """Hash of each run with the one `apart` places on; the last ones have no partner and are to be cut off."""
    return F.transform(runs, lambda x, i: F.xxhash64(x, F.get(runs, i + apart)))


def _whole(runs: Column, n: Column, length: int) -> Column:
    """Of n runs those of `length` words that end within the text."""
    return F.slice(runs, 1, F.greatest(n - (length - 1), F.lit(0)))


def hashed(rows: DataFrame) -> DataFrame:
    """rows(..., words) with h and h2: hashes of words and of pairs of neighbours (and of one without a neighbour)."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("h2", _joined(F.col("h"), 1))


def _bucket(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BUCKETS)).cast("int")


def signs_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SIGNS), F.lit(0))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n over all n-grams of texts(text).

    Words are hashed once they are rows, as columns and not in a lambda. explode_outer, as for explode Spark tests the
    array's size below the projections, and with them in one expression the words would be made anew for every pair.
    """
    words = texts.select(words_of(F.col("text")).alias("words"))
    pairs = words.select(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b")).alias("z"))
    one = pairs.select(F.explode_outer("z").alias("z")).select(F.xxhash64("z.a").alias("a"), F.when(F.col("z.b").isNotNull(), F.xxhash64("z.b")).alias("b"), F.col("z.a").isNotNull().alias("word"))
    # a null, as of a text without words or the last word's pair, has no bucket
    single, pair = F.when(F.col("word"), _bucket(F.col("a"))), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b")))
    buckets = one.select(F.explode(F.array(single, pair)).alias("bucket"))
    signs = texts.select(signs_of(F.col("text")).alias("signs")).select(F.explode_outer("signs").alias("x")).select(F.when(F.col("x").isNotNull(), _bucket(F.xxhash64("x"))).alias("bucket"))
    return buckets.unionByName(signs).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("bucket IS NOT NULL")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Per bucket log(trusted share / corpus share) in 1 / UNIT, both with one added to each count."""
    target, raw = (bucket_counts(x).select("bucket", F.col("n").alias(name)) for x, name in ((trusted.select("text"), "t"), (docs.select("text"), "r")))
    both = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(target, "bucket", "left").join(raw, "bucket", "left").na.fill(0, ["t", "r"])
    one = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("b"), F.sum("t").alias("all_t"), F.sum("r").alias("all_r"))
    ratio = lambda b: F.log((b["t"] + 1) / (F.col("all_t") + BUCKETS)) - F.log((b["r"] + 1) / (F.col("all_r") + BUCKETS))
    # without a trusted text there is nothing to compare with
    row = one.select(F.transform("b", lambda b: F.when(F.col("all_t") == 0, 0).otherwise(F.round(ratio(b) * UNIT)).cast("long")).alias("x")).head()
    return list(row["x"])


def repeated_words(rows: DataFrame) -> DataFrame:
    """rows(..., h, h2) with n_repeat_words: word positions in windows that stand twice or more in the text.

    Runs are told apart by 64 bits of hash, made by doubling. A text whose runs of half a window all differ is done after
    one hash set; else windows are sorted with their places, equal neighbours are kept, and overlaps are taken off.
    """
    n, half = F.size("h"), WINDOW // 2
    rows = rows.withColumn("h4", _joined(F.col("h2"), 2))
    rows = rows.withColumn("halves", _whole(F.col("h4"), n, half))
    twice = F.size(F.array_distinct("halves")) < F.size("halves")
    placed = F.sort_array(F.transform(_whole(_joined(F.col("h4"), half), n, WINDOW), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(twice, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h4", "halves")
    s = F.col("s")
    same = lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("p", F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))).drop("s")
    p = F.col("p")
    own = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1), x + WINDOW) - x).cast("long"))
    return rows.withColumn("n_repeat_words", F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)).drop("p")


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept.

    trusted(text) are texts as they should be; where it has no word, ratio is 0 and the base rules decide alone. Null
    text counts as empty: no words, base_failed. ratio of a text without words is 0. Repeated rows, repeated and null
    identifiers are answered each; an empty table gives an empty result. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ratios = log_ratios(slim, trusted)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # folded into one constant
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = hashed(slim.select("id", signs_of(F.col("text")).alias("signs"), words_of(F.col("text")).alias("words"), F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"), lines.alias("lines")))
    looked_up = lambda runs, key: F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + F.get(table, _bucket(key(x))))
    n = F.size("h")
    rows = rows.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "total": looked_up(F.col("h"), lambda x: x) + looked_up(_whole(F.col("h2"), n, 2), lambda x: x) + looked_up(F.col("signs"), lambda x: F.xxhash64(x)),
        "n_grams": n + F.greatest(n - 1, F.lit(0)) + F.size("signs"),
    }).drop("lines", "words", "signs")
    rows = repeated_words(rows)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    ratio = F.when(F.col("n_grams") > 0, F.col("total") / (F.col("n_grams").cast("double") * UNIT)).otherwise(0.0)
    rows = rows.withColumn("base_failed", failed).withColumn("ratio", ratio)
    return rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"))


def trusted_texts(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """text of documents that labels call good: at most `most` labels, those with the smallest hashes of their doc_id."""
    good = labels.where("quality > 0 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(good), "doc_id", "left_semi").select("text")


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, trusted_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("id", "doc_id")
