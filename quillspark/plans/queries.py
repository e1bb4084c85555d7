"""Registered queries of the catalog's operators over the test tables, each beside the SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths, text
from ..operators import browse, changes, document, evaluate, graph, metadata, search, topk, validate
from ..operators.tokens import FIELDS, stemmed, token_rows
from ..schema import TABLES, Catalog
from ..sources.ingest import parse_files, read_errors, to_catalog, with_existence
from ..sources.snapshot import export_json, replace_documents
from ..streaming import watch
from .virtual import SQL_DOCS, SQL_LINKS, document_catalog, document_pages, graph_catalog, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


DOCS, LINKS = f"WITH {SQL_DOCS} ", f"WITH {SQL_LINKS} "
META = "path, title, type, description, file_size, modified_at, parse_status"


# --- metadata -------------------------------------------------------------------------------------------------------


@query(DOCS + f"SELECT {META} FROM docs ORDER BY path LIMIT 100")
def metadata_default(spark, sf):
    return metadata.query_metadata(document_catalog(spark, sf))[0]


@query(DOCS + "SELECT path, type FROM docs WHERE type = 'Metric' ORDER BY path LIMIT 1000000")
def metadata_type_eq(spark, sf):
    return metadata.query_metadata(document_catalog(spark, sf), {"type": "Metric"}, ["path", "type"], 1_000_000)[0]


@query(DOCS + "SELECT path, file_size FROM docs WHERE starts_with(path, 'docs/src1/') ORDER BY path LIMIT 1000000")
def metadata_path_prefix(spark, sf):
    return metadata.query_metadata(document_catalog(spark, sf), {"path_prefix": "docs/src1/"}, ["path", "file_size"], 1_000_000)[0]


@query(DOCS + "SELECT path FROM docs WHERE type = 'Metric' AND path IN (SELECT path FROM tags WHERE tag = 'en') ORDER BY path LIMIT 50")
def metadata_tags_contains(spark, sf):
    return metadata.query_metadata(document_catalog(spark, sf), {"type": "Metric", "tags_contains": "en"}, ["path"], 50)[0]


@query(DOCS + "SELECT path, concat('\"', split_part(path, '/', 3), '\"') AS lang FROM docs WHERE split_part(path, '/', 3) = 'fr' ORDER BY path LIMIT 1000000")
def metadata_custom_eq(spark, sf):
    return metadata.query_metadata(document_catalog(spark, sf), {"lang": "fr"}, ["path", "lang"], 1_000_000)[0]


@query(DOCS + "SELECT path, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM docs JOIN tags USING (path) WHERE parse_status = 'partial' GROUP BY path ORDER BY path LIMIT 1000000")
def metadata_projection_tags(spark, sf):
    page = metadata.query_metadata(document_catalog(spark, sf), {"parse_status": "partial"}, ["path", "tags"], 1_000_000)[0]
    return page.select("path", F.array_join("tags", ",").alias("tags"))


@query(DOCS + "SELECT count(*) AS total_matches, count(*) > 10 AS truncated FROM docs WHERE type = 'Policy' AND path IN (SELECT path FROM tags WHERE tag = 'quality')")
def metadata_total(spark, sf):
    return metadata.query_metadata(document_catalog(spark, sf), {"type": "Policy", "tags_contains": "quality"}, limit=10)[1]


# --- browse, listings, lookups --------------------------------------------------------------------------------------


@query(DOCS + "SELECT DISTINCT parent_path FROM docs WHERE starts_with(parent_path, 'docs/') AND parent_path <> 'docs' ORDER BY 1 LIMIT 1000")
def browse_subdirs(spark, sf):
    return browse.subdirectories(document_catalog(spark, sf), "docs", 1, 1000)


@query(DOCS + "SELECT path, title FROM docs WHERE parent_path = 'docs/src1/en' ORDER BY path LIMIT 100")
def browse_docs(spark, sf):
    return browse.documents_in(document_catalog(spark, sf), "docs/src1/en").select("path", "title")


@query(DOCS + "SELECT path FROM docs WHERE starts_with(path, 'docs/src2/') ORDER BY path LIMIT 25")
def list_documents(spark, sf):
    return browse.list_documents(document_catalog(spark, sf), "docs/src2/", 25).select("path")


@query(DOCS + "SELECT path, modified_at FROM docs ORDER BY modified_at DESC, path LIMIT 20")
def recently_modified(spark, sf):
    return browse.recently_modified(document_catalog(spark, sf)).select("path", "modified_at")


@query(f"WITH {SQL_DOCS}, {SQL_LINKS} SELECT (SELECT count(*) FROM docs) AS document_count, (SELECT count(*) FROM docs WHERE parse_status <> 'ok') AS error_count, (SELECT count(*) FROM links) AS link_count, (SELECT count(*) FROM docs) AS heading_count, (SELECT count(*) FROM docs WHERE parse_status <> 'ok') AS scan_error_count")
def stats(spark, sf):
    return browse.stats(document_catalog(spark, sf))


@query(LINKS + "SELECT src AS source_path, title AS source_title, relation FROM links JOIN nodes ON src = path WHERE dst = 'nation/7.md'")
def doc_backlinks(spark, sf):
    return document.backlinks(graph_catalog(spark, sf), "nation/7.md").drop("anchor")


@query(LINKS + "SELECT dst, external_url, dst IS NULL OR dst IN (SELECT path FROM nodes) AS \"exists\", relation FROM links WHERE src = 'region/2.md'")
def doc_links(spark, sf):
    return document.forward_links(graph_catalog(spark, sf), "region/2.md").drop("anchor")


@query(DOCS + "SELECT path, substr(body, 1, 500) AS body, length(body) > 500 AS body_truncated FROM docs")
def doc_body_truncated(spark, sf):
    body, more = text.truncated(F.col("body"), 500)
    return document_catalog(spark, sf).documents.select("path", body.alias("body"), more.alias("body_truncated"))


@query(f"WITH {SQL_DOCS} SELECT path, title, (SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM tags t WHERE t.path = docs.path) AS tags, split_part(body, '.', 1) AS headings FROM docs")
def doc_detail(spark, sf):
    c = document_catalog(spark, sf)
    tags = c.tags.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    heads = document.outline(c, 1, 5).select("path", F.array_join("outline", ",").alias("headings"))
    return c.documents.select("path", "title").join(tags, "path", "left").join(heads, "path", "left")


@query(DOCS + "SELECT path, title, type, file_size, (SELECT count(*) FROM tags t WHERE t.path = docs.path) AS n_tags FROM docs")
def export_flat(spark, sf):
    out = export_json(document_catalog(spark, sf)).select("path", F.from_json("document", "title string, type string, file_size long, tags array<string>").alias("x"))
    return out.select("path", "x.title", "x.type", "x.file_size", F.size("x.tags").cast("long").alias("n_tags"))


@query(LINKS + "SELECT path, CAST(damerau_levenshtein(path, 'custmoer/12.md') AS INT) AS distance FROM nodes WHERE damerau_levenshtein(path, 'custmoer/12.md') <= 3 AND path <> 'custmoer/12.md' ORDER BY 2, 1 LIMIT 4")
def suggest_paths(spark, sf):
    return document.suggestions(graph_catalog(spark, sf), "custmoer/12.md")


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey, trim(lower(p_name)) AS x, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9 _-]', '', 'g')), ' +', '-', 'g') AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.trim(F.lower("p_name")).alias("x"), text.slugify(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, concat(upper(substr(n, 1, 1)), substr(n, 2)) AS title FROM (SELECT p_partkey, replace(replace(concat(lower(p_brand), '-x_', p_partkey), '-', ' '), '_', ' ') AS n FROM part)")
def display_title(spark, sf):
    path = F.concat(F.lit("a-b/"), F.lower("p_brand"), F.lit("-x_"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return table(spark, sf, "part").select("p_partkey", text.display_title(F.lit(""), path).alias("title"))


@query(DOCS + "SELECT path, parent_path FROM docs")
def parent_path(spark, sf):
    return document_catalog(spark, sf).documents.select("path", paths.parent_path(F.col("path")).alias("parent_path"))


@query("SELECT c_custkey, concat('b/', c_custkey, '.md') AS up, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('a/', c_custkey) END AS above FROM customer")
def normalize_path(spark, sf):
    k = F.col("c_custkey").cast("string")
    above = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("../"), k)).otherwise(F.concat(F.lit("./a//"), k))
    return table(spark, sf, "customer").select("c_custkey", paths.normalize_path(F.concat(F.lit("a/./x/../../b/"), k, F.lit(".md"))).alias("up"), paths.normalize_path(above).alias("above"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('top/', c_custkey, '.md') WHEN 1 THEN concat('docs/a b/', c_custkey, '+.md#part one') WHEN 2 THEN 'INVALID_PATH_TRAVERSAL' ELSE concat('https://example.org/', c_custkey, '/../x') END AS resolved FROM customer")
def resolve_link(spark, sf):
    k = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 4
    target = F.when(kind == 0, F.concat(F.lit("/top/"), k, F.lit(".md"))).when(kind == 1, F.concat(F.lit("../docs/a%20b/"), k, F.lit("+.md#part%20one"))).when(kind == 2, F.lit("../../../etc/passwd")).otherwise(F.concat(F.lit("https://example.org/"), k, F.lit("/../x")))
    return table(spark, sf, "customer").select("c_custkey", paths.resolve_link(F.lit("sub/page.md"), target).alias("resolved"))


@query("SELECT c_custkey, concat('a/', c_custkey) AS base, CASE WHEN c_custkey % 2 = 0 THEN concat('s ', c_custkey, '#x') END AS anchor FROM customer")
def split_anchor(spark, sf):
    k = F.col("c_custkey").cast("string")
    base, anchor = paths.split_anchor(F.concat(F.lit("a/"), k, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("#s%20"), k, F.lit("#x"))).otherwise(F.lit(""))))
    return table(spark, sf, "customer").select("c_custkey", base.alias("base"), anchor.alias("anchor"))


@query("SELECT c_custkey, c_custkey % 3 = 1 AS safe FROM customer")
def safe_path(spark, sf):
    k = F.col("c_custkey").cast("string")
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a/b.."), k)).otherwise(F.concat(F.lit("a/../"), k))
    return table(spark, sf, "customer").select("c_custkey", paths.safe_path(path).alias("safe"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE concat(substr(text, 1, 138), '\n\n[... truncated ...]\n\n', substr(text, length(text) - 137, 138)) END AS cut FROM documents")
def truncate_structured(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_structured(F.col("text"), 300).alias("cut"))


@query("SELECT conv_id, turn, CAST(0 AS INT) AS first, CAST(length(text) + 3 AS INT) AS second FROM conversations")
def heading_positions(spark, sf):
    at = text.heading_positions(F.concat(F.lit("# "), F.translate("text", "\n#", "  "), F.lit("\n# end")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.get(at, F.lit(0)).alias("first"), F.get(at, F.lit(1)).alias("second"))


@query("""SELECT doc_id, CASE WHEN p > 0 THEN concat(CASE WHEN p > 101 THEN '...' ELSE '' END, substr(text, greatest(p - 100, 1), least(p - 1 + 8 + 100, length(text)) - greatest(p - 101, 0)), '...') ELSE concat(substr(text, 1, 200), '...') END AS excerpt
FROM (SELECT doc_id, text, strpos(lower(text), 'licensed') AS p FROM documents)""")
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), F.lit("licensed")).alias("excerpt"))


# --- search ---------------------------------------------------------------------------------------------------------

TOKENS = f"""WITH {SQL_DOCS},
toks AS (SELECT path, field, unnest(range(0, len(w))) AS pos, unnest(w) AS term FROM (
  SELECT path, 'title' AS field, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM docs UNION ALL SELECT path, 'headings', regexp_extract_all(lower(split_part(body, '.', 1)), '[a-z0-9]+') FROM docs
  UNION ALL SELECT path, 'body', regexp_extract_all(lower(body), '[a-z0-9]+') FROM docs UNION ALL SELECT path, 'type', regexp_extract_all(lower(type), '[a-z0-9]+') FROM docs)),
dls AS (SELECT docs.path, count(term) AS dl FROM docs LEFT JOIN toks USING (path) GROUP BY 1), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)"""


def _bm25(occurrences: dict[int, str], test: str, extra: str = "", weights: str = "CASE field WHEN 'title' THEN 10e0 WHEN 'headings' THEN 2e0 WHEN 'body' THEN 1e0 ELSE 0e0 END") -> str:
    """SQL of a scored query from the (path, field) rows of each phrase and a test over its flags p0, p1, ..."""
    rows = " UNION ALL ".join(f"SELECT {i} AS i, path, {weights} AS w FROM ({sql})" for i, sql in occurrences.items())
    flags = ", ".join(f"bool_or(i = {i}) AS p{i}" for i in occurrences)
    return f"""{TOKENS}, hits AS (SELECT i, path, sum(w) AS f FROM ({rows}) GROUP BY 1, 2),
ni AS (SELECT i, CASE WHEN ln((n - c + 0.5e0) / (c + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n - c + 0.5e0) / (c + 0.5e0)) END AS idf FROM (SELECT i, count(*) AS c FROM hits GROUP BY 1), tot),
sc AS (SELECT path, sum(idf * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score, {flags} FROM hits JOIN ni USING (i) JOIN dls USING (path), tot GROUP BY path)
SELECT path, round(score, 6) AS score FROM sc WHERE {test} {extra}"""


def _term(t: str) -> str:
    return f"SELECT path, field FROM toks WHERE term = '{t}'"


_INDEXES: dict[tuple, search.Index] = {}


def document_index(spark, sf, store=True):
    """The index of the document catalog: stored once a session where the session names a shared folder. store: False for
    what reads all of it once, which takes a stored one only where there is one."""
    index = search.build_index(document_pages(spark, sf), use_stem=False, ascii_only=True)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    key = (spark.sparkContext.applicationId, sf)
    if not folder or (not store and key not in _INDEXES):
        return index
    if key not in _INDEXES:
        _INDEXES[key] = search.write_index(index, f"{folder}/index-{uuid.uuid4().hex}")
    return _INDEXES[key]


def _scored(spark, sf, q, **kw):
    return search.score_query(document_index(spark, sf), q, **kw).select("path", F.round("score", 6).alias("score"))


@query(TOKENS + " SELECT term, path, field, count(*) AS tf FROM toks GROUP BY 1, 2, 3")
def postings(spark, sf):
    return search.postings(document_index(spark, sf, store=False))


@query(TOKENS + " SELECT term, count(DISTINCT path) AS df, count(*) AS cnt FROM toks GROUP BY 1 ORDER BY df DESC, term LIMIT 50000")
def vocabulary(spark, sf):
    return search.vocabulary(document_index(spark, sf))


@query(_bm25({0: _term("apache")}, "p0"))
def bm25_term(spark, sf):
    return _scored(spark, sf, "apache")


@query(_bm25({0: _term("license"), 1: _term("the")}, "p0 AND p1"))
def bm25_and(spark, sf):
    return _scored(spark, sf, "license the")


@query(_bm25({0: _term("apache"), 1: _term("gnu")}, "p0 OR p1"))
def bm25_or(spark, sf):
    return _scored(spark, sf, "apache OR gnu")


@query(_bm25({0: _term("license"), 1: _term("gnu")}, "p0 AND NOT p1"))
def bm25_not(spark, sf):
    return _scored(spark, sf, "license NOT gnu")


@query(_bm25({0: "SELECT path, field FROM toks WHERE starts_with(term, 'licen')"}, "p0"))
def bm25_prefix(spark, sf):
    return _scored(spark, sf, "licen*")


@query(_bm25({0: "SELECT x.path, x.field FROM toks x JOIN toks y ON x.path = y.path AND x.field = y.field AND y.pos = x.pos + 1 WHERE x.term = 'apache' AND y.term = 'license'"}, "p0"))
def bm25_phrase(spark, sf):
    return _scored(spark, sf, '"apache license"')


@query(_bm25({0: "SELECT path, field FROM toks WHERE term = 'metric' AND field = 'type'"}, "p0"))
def bm25_column(spark, sf):
    return _scored(spark, sf, "type:metric")


@query(_bm25({0: _term("the")}, "p0", weights="CASE field WHEN 'title' THEN 50e0 WHEN 'body' THEN 1e0 ELSE 0e0 END"))
def bm25_weights_title(spark, sf):
    return _scored(spark, sf, "the", weights={"title": 50.0, "body": 1.0})


@query(_bm25({0: _term("license")}, "p0", "AND path IN (SELECT path FROM docs WHERE type IN ('Metric', 'Dataset') AND starts_with(parent_path, 'docs/src5/')) AND path IN (SELECT path FROM tags WHERE tag IN ('en', 'fr', 'P1'))"))
def search_filtered(spark, sf):
    c = document_catalog(spark, sf)
    hits = search.apply_filters(c, search.score_query(document_index(spark, sf), "license"), "docs/src5/", ["Metric", "Dataset"], ["en", "fr", "P1", ""])
    return hits.select("path", F.round("score", 6).alias("score"))


@query("SELECT path, score, split_part(body, '.', 1) AS outline FROM (" + _bm25({0: _term("license")}, "p0") + ") JOIN (WITH " + SQL_DOCS + " SELECT path, body FROM docs) USING (path) ORDER BY score DESC, path LIMIT 20")
def search_topk_outline(spark, sf):
    c = document_catalog(spark, sf)
    page = search.score_query(document_index(spark, sf), "license").select("path", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "path").limit(20)
    return page.join(document.outline(c, 1, 1), "path", "left").select("path", "score", F.array_join("outline", " ").alias("outline"))


@query("SELECT * FROM (" + _bm25({0: _term("license"), 1: _term("gnu")}, "p0 OR p1") + ") ORDER BY score DESC, path LIMIT 20")
def bm25_topk(spark, sf):
    return topk.top_k(document_index(spark, sf), "license OR gnu", 20).rows.select("path", F.round("score", 6).alias("score"))


#: Words and their stems; a search for one finds all of its row.
STEMS = {"general": ("general", "generals", "generally", "generalized"), "licens": ("license", "licenses", "licensed", "licensing"), "publish": ("publish", "published", "publishing", "publishes")}


@query("SELECT DISTINCT word, CAST(stem AS VARCHAR) AS term FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for k, ws in {"gener": STEMS["general"], "licens": STEMS["licens"], "publish": STEMS["publish"]}.items() for w in ws) + ") t(word, stem) JOIN (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) USING (word)")
def stemmed_terms(spark, sf):
    """The stems of those words of all documents of which the stem is known."""
    words = token_rows(search.searchable(document_catalog(spark, sf)), ascii_only=True).where(F.col("field") == "body").select(F.col("term").alias("word")).distinct()
    known = words.where(F.col("word").isin(*[w for ws in STEMS.values() for w in ws]))
    return known.select("word", stemmed("word").alias("term"))


@query(DOCS + """, w AS (SELECT path, regexp_extract_all(lower(concat(title, ' ', body)), '[a-z0-9]+') AS w FROM docs WHERE regexp_full_match(body, '[\\x00-\\x7F]*')) SELECT path FROM w WHERE list_has_any(w, ['license', 'licenses', 'licensed', 'licensing'])""")
def search_stemmed(spark, sf):
    """One form of a word finds all others; over texts of ASCII letters, where folding changes nothing."""
    c = document_catalog(spark, sf)
    docs = search.searchable(c).where(F.col("body").rlike(r"^[\x00-\x7F]*$")).withColumn("headings", F.lit(""))
    return search.score_query(search.build_index(docs), "licensing").select("path")


@query("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}\\p{Co}]+')) AS term FROM documents) GROUP BY 1")
def folded_terms(spark, sf):
    """Every term of all documents without its accents."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), *[F.lit("").alias(f) for f in FIELDS if f != "body"], F.col("text").alias("body"))
    return search.term_counts(search.build_index(docs, use_stem=False))


WRONG = ("licence", "apachee", "versoin", "publik", "generel")


@query(TOKENS + f""", voc AS (SELECT term, count(DISTINCT path) AS df FROM toks GROUP BY 1 ORDER BY df DESC, term LIMIT 50000),
near AS (SELECT token, term, df, levenshtein(token, term) AS d, CASE WHEN length(token) = 5 THEN 1 ELSE 2 END AS most FROM voc, (SELECT unnest({list(WRONG)}) AS token) WHERE substr(token, 1, 1) = substr(term, 1, 1))
SELECT token, term FROM near WHERE d <= most QUALIFY row_number() OVER (PARTITION BY token ORDER BY d, df DESC, term) = 1""")
def typo_correct(spark, sf):
    words = spark.createDataFrame([(w,) for w in WRONG], "token string")
    return search.correct_tokens(search.vocabulary(document_index(spark, sf)), words)


@query(_bm25({0: _term("apache")}, "p0", "ORDER BY score DESC, path LIMIT 10"))
def typo_search(spark, sf):
    c = document_catalog(spark, sf)
    found = search.search(c, document_index(spark, sf), "apachee", limit=10)
    return spark.createDataFrame([(r["path"], round(r["score"], 6)) for r in found["results"]], "path string, score double")


@query(TOKENS + """, it AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]{9,}')) AS term FROM benchmark),
df AS (SELECT term, count(DISTINCT path) AS df FROM toks GROUP BY 1), hit AS (SELECT DISTINCT query, path, term, df FROM it JOIN df USING (term) JOIN toks USING (term)),
sc AS (SELECT query, path, count(*) AS m, round(sum(ln(n::DOUBLE / df)), 6) AS score FROM hit, tot GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM sc),
need AS (SELECT query, count(*) AS n FROM it GROUP BY 1), judged AS (SELECT query, path, rank FROM rk JOIN need USING (query) WHERE m = n),
per AS (SELECT query, count(*) AS n, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first FROM judged GROUP BY 1)
SELECT round(avg(h5 / n), 9) AS recall_5, round(avg(h10 / n), 9) AS recall_10, round(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END), 9) AS mrr_10, round(avg((h10 = 0)::INT::DOUBLE), 9) AS zero_evidence_rate FROM per""")
def eval_recall_mrr(spark, sf):
    """Benchmark items as queries: do the documents that hold all of an item's long words come first?"""
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "path")
    tokens = document_index(spark, sf)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{9,}"), F.lit(0))).alias("term")).distinct()
    df = search.term_counts(tokens) if tokens.terms is None else tokens.terms
    hits = items.join(df, "term").join(tokens.tokens.select("term", "path").distinct(), "term")
    scored = hits.crossJoin(tokens.totals).groupBy("query", "path").agg(F.round(F.sum(F.log(F.col("n") / F.col("df"))), 6).alias("score"), F.count(F.lit(1)).alias("m"))
    ranked = scored.withColumn("rank", F.row_number().over(rank)).where("rank <= 10").select("query", "path", "rank")
    needed = items.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    judged = scored.join(needed, "query").where("m = n").select("query", "path")
    found = evaluate.evaluate(ranked, judged)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


# --- graph ----------------------------------------------------------------------------------------------------------


@query(LINKS + "SELECT src, dst, relation FROM links WHERE relation = 'placed-by' OR relation IS NULL")
def links_by_relation(spark, sf):
    return graph.links_by_relation(graph_catalog(spark, sf).links, ["placed-by", "links_to"]).select("src", "dst", "relation")


@query(LINKS + "SELECT dst, relation FROM links WHERE src = 'customer/51.md'")
def forward_links(spark, sf):
    return graph.forward(graph_catalog(spark, sf), "customer/51.md").select("dst", "relation")


@query(LINKS + "SELECT src AS source_path, relation FROM links WHERE dst = 'nation/3.md' AND relation = 'belongs-to' ORDER BY 1 LIMIT 50")
def backlinks(spark, sf):
    return graph.backward(graph_catalog(spark, sf), "nation/3.md", "belongs-to").select("source_path", "relation")


@query(LINKS + "SELECT src, dst FROM links WHERE external_url IS NULL AND dst NOT IN (SELECT path FROM nodes)")
def broken_links(spark, sf):
    return graph.broken_links(graph_catalog(spark, sf)).select("src", "dst")


@query(LINKS + "SELECT src, dst, count(*) FILTER (relation IS NULL) AS untyped, count(*) FILTER (relation IS NOT NULL) AS typed FROM links WHERE dst IS NOT NULL GROUP BY 1, 2 HAVING untyped > 0 AND typed > 0")
def typed_conflict(spark, sf):
    return graph.typed_conflicts(graph_catalog(spark, sf).links)


_BFS = """, st AS (SELECT DISTINCT src AS a, dst AS b FROM links WHERE dst IS NOT NULL {test} UNION SELECT DISTINCT dst, src FROM links WHERE dst IS NOT NULL {test}),
bfs(start, path, depth) AS (SELECT path, path, 0 FROM nodes WHERE parent_path = 'region' UNION SELECT start, b, depth + 1 FROM bfs JOIN st ON a = path WHERE depth < {depth})
SELECT start, path, depth FROM (SELECT start, path, min(depth) AS depth FROM bfs GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, path) <= 100"""


@query(f"WITH RECURSIVE {SQL_LINKS}" + _BFS.format(test="", depth=2))
def traverse_bfs(spark, sf):
    c = graph_catalog(spark, sf)
    return graph.traverse(c, c.documents.where("parent_path = 'region'").select("path"), 2, 100)[0].select("start", "path", "depth")


@query(f"WITH RECURSIVE {SQL_LINKS}" + _BFS.format(test="AND relation = 'next-to'", depth=5))
def traverse_relation(spark, sf):
    c = graph_catalog(spark, sf)
    return graph.traverse(c, c.documents.where("parent_path = 'region'").select("path"), 9, 500, ["next-to"])[0].select("start", "path", "depth")


_EDGES = """, st AS (SELECT DISTINCT src AS a, dst AS b FROM links WHERE dst <> src UNION SELECT DISTINCT dst, src FROM links WHERE dst <> src),
bfs(start, path, depth) AS (SELECT path, path, 0 FROM nodes WHERE path IN ('nation/7.md', 'customer/51.md') UNION SELECT start, b, depth + 1 FROM bfs JOIN st ON a = path WHERE depth < 2),
n AS (SELECT start, path, depth FROM (SELECT start, path, min(depth) AS depth FROM bfs GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, path) <= 60)
SELECT DISTINCT s.start, src AS source, dst AS target, CASE WHEN s.depth < t.depth OR s.depth = t.depth AND src < dst THEN 'links_to' ELSE 'linked_from' END AS label, relation AS link_relation
FROM links JOIN n s ON s.path = src JOIN n t ON t.path = dst AND t.start = s.start WHERE src <> dst AND least(s.depth, t.depth) < 2"""


@query(f"WITH RECURSIVE {SQL_LINKS}" + _EDGES)
def traverse_edges(spark, sf):
    c = graph_catalog(spark, sf)
    return graph.traverse(c, c.documents.where("path IN ('nation/7.md', 'customer/51.md')").select("path"), 2, 60)[1]


_CYCLES = """, live AS (SELECT DISTINCT src AS a, dst AS b FROM links WHERE external_url IS NULL AND dst IN (SELECT path FROM nodes)), way(a, b) AS (SELECT a, b FROM live UNION SELECT way.a, live.b FROM way JOIN live ON way.b = live.a)
SELECT x.a AS path, min(x.b) AS cycle_id FROM way x JOIN way y ON x.a = y.b AND x.b = y.a GROUP BY 1"""


@query(f"WITH RECURSIVE {SQL_LINKS}" + _CYCLES)
def cycle_members(spark, sf):
    return graph.cycle_members(graph_catalog(spark, sf))


@query("""WITH RECURSIVE nodes AS (SELECT concat(p_partkey, '.md') AS path FROM part), e AS (SELECT p_partkey AS k, p_size AS z FROM part),
links AS (SELECT concat(k, '.md') AS src, concat(k // 10 * 10 + (k + 1) % 10, '.md') AS dst, NULL AS external_url FROM e WHERE z % 7 <> 0 UNION ALL SELECT concat(k, '.md'), concat(k // 10 * 10 + (k * 3) % 10, '.md'), NULL FROM e WHERE z % 3 = 0
  UNION ALL SELECT concat(k, '.md'), concat(k - 10, '.md'), NULL FROM e WHERE k % 40 >= 10 AND z % 2 = 0 UNION ALL SELECT concat(k, '.md'), concat(k // 10 * 10 - 9 + k % 10, '.md'), NULL FROM e WHERE k % 40 >= 30 AND z % 5 = 0)""" + _CYCLES)
def cycles_many(spark, sf):
    """Rings of ten with gaps and chords, some of them joined by links in one direction or both: cycles of many sizes."""
    at = lambda c: F.concat(c.cast("string"), F.lit(".md"))
    k, z, none = F.col("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    ten, digit = F.floor(k / 10) * 10, k % 10
    p = table(spark, sf, "part")
    edge = lambda test, dst: p.where(test).select(at(k).alias("src"), at(dst).alias("dst"), none.alias("anchor"), none.alias("external_url"), none.alias("relation"), F.lit(1).alias("pos"))
    links = edge(z % 7 != 0, ten + (k + 1) % 10).unionByName(edge(z % 3 == 0, ten + (k * 3) % 10)).unionByName(edge((k % 40 >= 10) & (z % 2 == 0), k - 10)).unionByName(edge((k % 40 >= 30) & (z % 5 == 0), ten - 9 + digit))
    c = graph_catalog(spark, sf)
    c.documents, c.links = p.select(at(k).alias("path")), links
    return graph.cycle_members(c)


@query(f"WITH RECURSIVE {SQL_LINKS}, r(path) AS (SELECT dst FROM links WHERE src = 'customer/9.md' AND dst IS NOT NULL UNION SELECT dst FROM links JOIN r ON src = path WHERE dst IS NOT NULL) SELECT path FROM r")
def reachable(spark, sf):
    return graph.reachable(graph_catalog(spark, sf).links, "customer/9.md")


@query(LINKS + "SELECT src, dst, dst IS NULL OR dst IN (SELECT path FROM nodes) AS \"exists\" FROM links")
def link_existence(spark, sf):
    c = graph_catalog(spark, sf)
    return with_existence(c.links, c.documents).select("src", "dst", "exists")


@query(LINKS + "SELECT src, dst FROM links WHERE dst IS NULL OR src <> dst")
def self_reference_filter(spark, sf):
    c = graph_catalog(spark, sf)
    own = c.documents.where("type = 'nation'").select(F.col("path").alias("src"), F.col("path").alias("dst"))
    return graph.self_free(c.links.select("src", "dst").unionByName(own))


# --- parsers: rendered from tables, parsed back ---------------------------------------------------------------------


def _parsed(rendered: DataFrame):
    """rendered(path, text) through the file parser."""
    files = rendered.select("path", F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_at"), F.col("text").cast("binary").alias("content"))
    return parse_files(files, Config())


def _conversations(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda t: F.concat(F.lit("# "), t["turn"].cast("string"), F.lit(" "), t["role"], F.lit("\n\n"), t["text"], F.lit("\n"))), "\n")
    return turns.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\ntype: Chat\n---\n\n"), body).alias("text"))


_CONV = "SELECT concat('conv/', conv_id, '.md') AS path, concat(turn, ' ', role) AS h, concat(turn, '-', role) AS slug, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations"


@query("SELECT concat('doc/', doc_id, '.md') AS path, trim(replace(substr(text, 1, 40), chr(10), ' ')) AS title, CASE WHEN doc_id % 2 = 0 THEN 'Even' ELSE 'Odd' END AS type, concat(lang, ',', source) AS tags, CAST(n_chars AS VARCHAR) AS n_chars, 'ok' AS parse_status FROM documents")
def fm_roundtrip(spark, sf):
    d = table(spark, sf, "documents")
    title = F.trim(F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(title, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    head = F.concat(F.lit("---\ntitle: "), quoted, F.lit("\ntype: "), F.when(F.col("doc_id") % 2 == 0, "Even").otherwise("Odd"), F.lit("\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\nn_chars: "), F.col("n_chars").cast("string"), F.lit("\n---\n\nx"))
    c = _parsed(d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), head.alias("text")))
    return c.select("path", "title", "type", F.array_join("tags", ",").alias("tags"), F.element_at("custom", "n_chars").alias("n_chars"), "parse_status")


@query(f"SELECT path, CAST(1 AS INT) AS level, h AS title, slug AS anchor, CAST(pos AS INT) AS pos FROM ({_CONV})")
def headings_roundtrip(spark, sf):
    return to_catalog(_parsed(_conversations(spark, sf))).headings


@query(f"SELECT path, h AS heading, body AS content, CAST(pos AS INT) AS pos FROM ({_CONV})")
def sections_roundtrip(spark, sf):
    return to_catalog(_parsed(_conversations(spark, sf))).sections.select("path", "heading", "content", "pos")


@query(f"SELECT path, string_agg(concat(h, CASE WHEN body <> '' THEN concat(' ', body) ELSE '' END), ' ' ORDER BY pos) AS plain_text FROM ({_CONV}) GROUP BY path")
def plain_text_roundtrip(spark, sf):
    return to_catalog(_parsed(_conversations(spark, sf))).documents.select("path", "plain_text")


@query(f"SELECT path, slug AS query, h AS heading, substr(body, 1, 100) AS content, length(body) > 100 AS truncated FROM ({_CONV})")
def section_lookup(spark, sf):
    c = table(spark, sf, "conversations")
    wanted = c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.col("turn").cast("string"), F.lit("-"), "role").alias("heading"))
    return document.find_sections(to_catalog(_parsed(_conversations(spark, sf))), wanted, 100).drop("level")


@query("SELECT concat('region/', r_regionkey, '.md') AS path, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, 'Left,Right' AS alignments FROM nation JOIN region ON n_regionkey = r_regionkey")
def tables_roundtrip(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list(F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |")))).alias("rows"))
    body = F.concat(F.lit("| name | key |\n|:--|--:|\n"), F.array_join("rows", "\n"), F.lit("\n"))
    t = to_catalog(_parsed(n.select(F.concat(F.lit("region/"), F.col("r").cast("string"), F.lit(".md")).alias("path"), body.alias("text")))).tables
    return t.select("path", F.explode("rows").alias("row"), F.array_join("alignments", ",").alias("alignments")).select("path", F.get("row", F.lit(0)).alias("name"), F.get("row", F.lit(1)).alias("key"), "alignments")


@query("SELECT concat('e/', event_id, '.md') AS path, 'json' AS language, 'evt.json' AS filename, props AS content FROM events")
def code_roundtrip(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("text\n\n```json:evt.json\n"), "props", F.lit("\n```\n")).alias("text"))
    return to_catalog(_parsed(e)).code_blocks.drop("pos")


@query("""SELECT concat('customer/', c_custkey, '.md') AS src, concat('nation/', c_nationkey, '.md') AS dst, concat('s ', c_custkey) AS anchor, CAST(NULL AS VARCHAR) AS external_url FROM customer
UNION ALL SELECT concat('customer/', c_custkey, '.md'), NULL, NULL, concat('https://example.org/', c_custkey) FROM customer
UNION ALL SELECT concat('customer/', c_custkey, '.md'), concat('customer/wiki/', c_custkey), NULL, NULL FROM customer""")
def links_roundtrip(spark, sf):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    body = F.concat(F.lit("See [the *nation*](../nation/"), n, F.lit(".md#s%20"), k, F.lit(") and `[no](link.md)`, <https://example.org/"), k, F.lit("> or [[wiki/"), k, F.lit("|a label]].\n\n```\n[no](x.md)\n```\n"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("customer/"), k, F.lit(".md")).alias("path"), body.alias("text"))
    return to_catalog(_parsed(c)).links.select("src", "dst", "anchor", "external_url")


_NESTED = """> quoted [one](q{k}.md), ![alt [two](i{k}.md)](img.png)

- item

  second paragraph with [three][Ref]

      [no](code.md)

  1. inner [Ref] and [four][]

&lt;[yes](escaped.md)&gt; but not \\[no](x.md) <!-- [no](comment.md) -->

<div>
[no](html.md)
</div>

[ref]: r{k}.md "title"
[Four]: <f {k}.md>
"""


@query("SELECT concat('c/', c_custkey, '.md') AS src, concat('c/', replace(t, '{k}', CAST(c_custkey AS VARCHAR)), '.md') AS dst, CAST(n AS INT) AS pos FROM customer, (VALUES ('q{k}', 1), ('i{k}', 2), ('r{k}', 3), ('r{k}', 4), ('f {k}', 5), ('escaped', 6)) v(t, n)")
def links_nested(spark, sf):
    """Links in quotes, images, paragraphs and lists of items, by reference; none in code, comments, HTML or escapes."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.replace(F.lit(_NESTED), F.lit("{k}"), F.col("c_custkey").cast("string")).alias("text"))
    return to_catalog(_parsed(c)).links.select("src", "dst", "pos")


@query("""SELECT concat('p/', p_partkey, '.md') AS path, CAST(l AS INT) AS level, CASE l WHEN 1 THEN concat(p_name, ' & more') WHEN 3 THEN concat('q ', p_name) WHEN 4 THEN concat('i ', p_name) ELSE p_name END AS title, CAST(n AS INT) AS pos
FROM part, (VALUES (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (2, 7)) v(l, n)""")
def headings_levels(spark, sf):
    """Levels 1 to 6 in both notations, in quotes and lists, with entities, emphasis and closing signs; none in code."""
    text_ = F.replace(F.lit("{p} &amp; more\n===\n\n{p}\n---\n> ### q **{p}**\n\n- #### i {p} ####\n\n##### {p} #\n###### _{p}_\n```\n# no\n```\n\n    # no\n\n##\t{p}\n####### no\n#no\n"), F.lit("{p}"), F.col("p_name"))
    c = table(spark, sf, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), text_.alias("text"))
    return to_catalog(_parsed(c)).headings.select("path", "level", "title", "pos")


@query("SELECT concat('customer/', c_custkey, '.md') AS src, concat('nation/', c_nationkey, '.md') AS dst, 'belongs-to' AS relation FROM customer")
def typed_links(spark, sf):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    head = F.concat(F.lit("---\ntype: Customer\ntyped_links:\n  version: 1\n  links:\n    - target: /nation/"), n, F.lit(".md\n      relation: belongs-to\n---\n\nBody"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("customer/"), k, F.lit(".md")).alias("path"), head.alias("text"))
    return to_catalog(_parsed(c)).links.select("src", "dst", "relation")


# --- validation -----------------------------------------------------------------------------------------------------


def _val_catalog(spark, sf):
    """Documents whose titles repeat, some without a type, some reserved, over the document catalog."""
    c = document_catalog(spark, sf)
    k = F.col("modified_at") - 1_700_000_000
    docs = c.documents.withColumn("title", F.substring("title", 1, 6)).withColumn("type", F.when(k % 660 == 0, F.lit("")).otherwise(F.col("type")))
    c.documents = docs.withColumn("path", F.when(k % 1020 == 0, F.concat("parent_path", F.lit("/index.md"))).otherwise(F.col("path")))
    c.tags = c.tags.where("false")
    c.custom = c.custom.where("false")
    return c


_VAL = f"""WITH {SQL_DOCS}, v AS (SELECT CASE WHEN (modified_at - 1700000000) % 1020 = 0 THEN concat(parent_path, '/index.md') ELSE path END AS path, parent_path, substr(title, 1, 6) AS title,
CASE WHEN (modified_at - 1700000000) % 660 = 0 THEN '' ELSE type END AS type, content_hash FROM docs WHERE parse_status = 'ok'), c AS (SELECT * FROM v WHERE NOT path LIKE '%/index.md'),
al AS (SELECT CASE WHEN (modified_at - 1700000000) % 1020 = 0 THEN concat(parent_path, '/index.md') ELSE path END AS path, parent_path FROM docs)"""


@query(_VAL + " SELECT path, 'error' AS severity FROM c WHERE trim(type) = ''")
def val_missing_type(spark, sf):
    return validate.check_type(_val_catalog(spark, sf)).select("path", "severity")


@query(_VAL + " SELECT path, concat('Same type and title as ', first) AS message FROM (SELECT path, min(path) OVER (PARTITION BY type, title) AS first FROM c) WHERE path <> first")
def val_dup_concept(spark, sf):
    return validate.check_concepts(_val_catalog(spark, sf)).select("path", "message")


@query(_VAL + " SELECT path, concat('Same content as ', CASE WHEN path = lo THEN hi ELSE lo END, ' (', n, ' documents)') AS message FROM (SELECT path, min(path) OVER w AS lo, max(path) OVER w AS hi, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY content_hash)) WHERE n > 1")
def val_dup_content(spark, sf):
    return validate.check_content(_val_catalog(spark, sf)).select("path", "message")


@query(_VAL + " SELECT content_hash, path FROM (SELECT *, count(*) OVER (PARTITION BY content_hash) AS n FROM c) WHERE n > 1")
def val_dup_members(spark, sf):
    return validate.content_groups(_val_catalog(spark, sf))


#: A file of each document by its number: sound, no UTF-8, broken YAML, front matter that is too large.
_FILES = """CASE doc_id % 4 WHEN 1 THEN 'unsupported_encoding' WHEN 2 THEN 'invalid_yaml' WHEN 3 THEN 'oversized_frontmatter' END"""


@query(f"SELECT concat(doc_id, '.md') AS path, {_FILES} AS category, 'error' AS severity FROM documents WHERE doc_id % 4 > 0")
def val_parse_checks(spark, sf):
    """What reading files finds, by the checks of encoding, front matter and YAML, over one file per document."""
    text_ = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary")
    k, body = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    content = F.when(k == 0, text_("---\ntype: Note\n---\n", body)).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), body.cast("binary"))).when(k == 2, text_("---\ntype: [x\n---\n", body))
    content = content.otherwise(text_("---\ntitle: ", F.repeat(F.lit("x"), 70_000), "\n---\n", body))
    files = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"), F.lit(1).cast("long").alias("modified_at"))
    errors = read_errors(files.withColumn("size", F.octet_length("content").cast("long")), Config())
    found = Catalog(**{name: spark.createDataFrame([], kind) for name, kind in TABLES.items()} | {"errors": errors})
    return validate.check_files(found).select("path", "category", "severity")


@query(DOCS + "SELECT path, 'yaml' AS category, 'bad mapping' AS message FROM docs WHERE parse_status <> 'ok'")
def val_scan_errors(spark, sf):
    return validate.check_errors(document_catalog(spark, sf)).select("path", "category", "message")


@query(_VAL + " SELECT DISTINCT parent_path AS path FROM al WHERE parent_path NOT IN (SELECT parent_path FROM al WHERE path LIKE '%/index.md')")
def val_missingdocument_index(spark, sf):
    return validate.check_index_files(_val_catalog(spark, sf)).select("path")


@query(_VAL + " SELECT path, 'reserved_file_frontmatter' AS category FROM v WHERE path LIKE '%/index.md'")
def val_reserved(spark, sf):
    return validate.check_reserved(_val_catalog(spark, sf)).select("path", "category")


@query(f"""WITH RECURSIVE {SQL_LINKS}, cyc AS (SELECT * FROM (WITH RECURSIVE {SQL_LINKS}{_CYCLES})) SELECT * FROM (VALUES ('typed_link_conflicts', 'warn', (SELECT count(*) FROM (SELECT src, dst FROM links WHERE dst IS NOT NULL GROUP BY 1, 2 HAVING count(relation) > 0 AND count(relation) < count(*)))),
('broken_links', 'warn', (SELECT count(*) FROM links WHERE external_url IS NULL AND dst NOT IN (SELECT path FROM nodes))), ('circular_references', 'warn', (SELECT count(DISTINCT cycle_id) FROM cyc)), ('missing_index_files', 'warn', (SELECT count(DISTINCT parent_path) FROM nodes WHERE parent_path NOT IN (SELECT parent_path FROM nodes WHERE path LIKE '%/index.md')))) t("check", status, issue_count)""")
def val_report(spark, sf):
    c = graph_catalog(spark, sf)
    c.documents = c.documents.withColumns({"has_front_matter": F.lit(True), "parse_status": F.lit("ok"), "description": F.lit(None).cast("string"), "content_hash": F.col("path"), "title": F.col("path")})
    return validate.report(validate.validate(c, require_index_files=True)).where("issue_count > 0")


@query(_VAL + ", i AS (SELECT path, 'missing_type' AS category FROM c WHERE trim(type) = '') SELECT path, category FROM i WHERE contains(path, '/src1/')")
def val_incremental(spark, sf):
    c = _val_catalog(spark, sf)
    changed = c.documents.where(F.col("path").contains("/src1/")).select("path")
    return validate.validate_incremental(validate.check_type(c), changed).select("path", "category")


# --- ingest ---------------------------------------------------------------------------------------------------------


def _snapshots(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    row = lambda df, size, time: df.select(F.concat(F.lit("o/"), k.cast("string"), F.lit(".md")).alias("path"), size.alias("file_size"), time.alias("modified_at"))
    before = row(o.where("o_orderkey % 7 <> 0"), k * 10, k)
    after = row(o.where("o_orderkey % 11 <> 0"), k * 10 + (k % 5 == 0).cast("long"), k + (k % 13 == 0).cast("long"))
    return after, before


_CHG = """SELECT concat('o/', k, '.md') AS path, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'deleted' WHEN k % 5 = 0 OR k % 13 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM (SELECT o_orderkey AS k FROM orders) WHERE NOT (k % 7 = 0 AND k % 11 = 0)"""


@query(_CHG)
def change_detect(spark, sf):
    return changes.detect_changes(*_snapshots(spark, sf))


@query(f"""SELECT count(*) FILTER (change = 'added') AS files_added, count(*) FILTER (change = 'modified') AS files_modified, count(*) FILTER (change = 'deleted') AS files_deleted, count(*) FILTER (change = 'unchanged') AS files_unchanged,
count(*) FILTER (hit AND k % 17 = 0) AS parse_failures, count(*) FILTER (hit AND k % 17 = 1) AS parse_partial, CAST(coalesce(sum(k % 4) FILTER (hit), 0) AS BIGINT) AS total_links, CAST(coalesce(sum((k % 4 > 0 AND k % 3 = 0)::INT + (k % 4 > 1 AND (k + 1) % 3 = 0)::INT + (k % 4 > 2 AND (k + 2) % 3 = 0)::INT) FILTER (hit), 0) AS BIGINT) AS broken_links
FROM (SELECT *, change IN ('added', 'modified') AS hit, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS k FROM ({_CHG}))""")
def change_summary(spark, sf):
    now, before = _snapshots(spark, sf)
    k = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    docs = now.select("path", F.when(k % 17 == 0, "failed").when(k % 17 == 1, "partial").otherwise("ok").alias("parse_status"))
    links = now.select(F.col("path").alias("src"), k.alias("k"), F.explode(F.expr("filter(array(0L, 1L, 2L), i -> i < cast(regexp_extract(path, '[0-9]+', 0) AS long) % 4)")).alias("i"))
    return changes.summarize(changes.detect_changes(now, before), docs, links.select("src", ((F.col("k") + F.col("i")) % 3 != 0).alias("exists")))


@query(DOCS + "SELECT path, CASE WHEN type = 'Policy' THEN 'new' ELSE title END AS title FROM docs WHERE type <> 'Guide'")
def upsert_snapshot(spark, sf):
    c, fresh = document_catalog(spark, sf), document_catalog(spark, sf)
    fresh.documents = fresh.documents.where("type = 'Policy'").withColumn("title", F.lit("new"))
    return replace_documents(c, fresh, c.documents.where("type = 'Guide'").select("path")).documents.select("path", "title")


# --- streaming ------------------------------------------------------------------------------------------------------


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("ts", F.concat(F.lit("docs/user"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.col("event_type").alias("kind"))


@query("""WITH g AS (SELECT ts, user_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 60 SECOND THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 60 SECOND AS session_end, count(*) AS n_events, count(DISTINCT user_id) AS n_paths FROM s GROUP BY sid""")
def debounce_batches(spark, sf):
    return watch.debounce(_events(spark, sf))


@query("""WITH g AS (SELECT ts, user_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 60 SECOND THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT DISTINCT min(ts) OVER (PARTITION BY sid) AS session_start, concat('docs/user', user_id, '.md') AS path FROM s""")
def debounce_paths(spark, sf):
    return watch.batches(_events(spark, sf))


@query("SELECT event_id, event_id % 6 IN (0, 3) AS ignored FROM events")
def gitignore_rules(spark, sf):
    rules = paths.ignore_rules("# build output\n\n/out/\n*.log.md\n!keep.log.md\ndocs/*/tmp\n**/deep/\n!/out/x\n")
    k = F.col("event_id").cast("string")
    names = [F.concat(F.lit("out/"), k, F.lit(".md")), F.concat(F.lit("a/out/"), k, F.lit(".md")), F.concat(F.lit("a/"), k, F.lit("/keep.log.md")), F.concat(F.lit("a/"), k, F.lit(".log.md")), F.concat(F.lit("docs/a/b/tmp/"), k), F.concat(F.lit("deep"), k, F.lit("/a.md"))]
    path = F.get(F.array(*names), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf, "events").select("event_id", paths.gitignored(path, rules).alias("ignored"))


@query("SELECT event_id, event_id % 5 IN (0, 2, 4) AS ignored FROM events")
def gitignore_nested(spark, sf):
    """Rules of a folder beside those of the root: they hold below it, and decide there."""
    rules = paths.ignore_rules("*.draft.md\n") + paths.ignore_rules("!special.draft.md\n/local\n", "docs")
    k = F.col("event_id").cast("string")
    names = [F.concat(k, F.lit(".draft.md")), F.concat(F.lit("docs/"), k, F.lit("/special.draft.md")), F.concat(F.lit("docs/local/"), k), F.concat(F.lit("local/"), k, F.lit(".md")), F.concat(F.lit("docs/"), k, F.lit(".draft.md"))]
    path = F.get(F.array(*names), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf, "events").select("event_id", paths.gitignored(path, rules).alias("ignored"))


@query("SELECT time_bucket(INTERVAL 600 SECOND, ts, TIMESTAMP '1970-01-01') AS tick, count(*) AS n_events FROM events GROUP BY 1")
def reconcile_ticks(spark, sf):
    return watch.reconcile_ticks(_events(spark, sf))


@query("SELECT concat('docs/user', user_id, '.md') AS path, max(ts) AS last_ts, arg_max(event_type, (ts, event_type)) AS last_kind, count(*) AS n_events FROM events GROUP BY 1")
def stream_latest_state(spark, sf):
    return watch.latest_state(_events(spark, sf))


@query("SELECT event_id, event_id % 6 NOT IN (0, 1, 2, 3) AS kept FROM events")
def ignore_predicate(spark, sf):
    k = F.col("event_id").cast("string")
    names = [F.concat(F.lit("a/node_modules/"), k, F.lit(".md")), F.concat(F.lit("a/."), k, F.lit(".md")), F.concat(F.lit("a/"), k, F.lit(".md~")), F.concat(F.lit("build/"), k, F.lit(".md")), F.concat(F.lit("a/target"), k, F.lit(".md")), F.concat(F.lit("x/build.md/"), k)]
    path = F.get(F.array(*names), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf, "events").select("event_id", (~paths.ignored(path, ("build/",))).alias("kept"))


@query("SELECT concat('o/', k, '.md') AS path, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'modified' WHEN k % 3 = 0 THEN 'added' ELSE 'deleted' END AS change FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 3 = 0 OR k % 2 = 0")
def classify_batch(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    return watch.classify(o, o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0"))
