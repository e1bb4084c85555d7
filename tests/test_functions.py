import random
import sqlite3
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.config import Config, load_config
from quillspark.errors import ConfigError, ParseError, ValidationError
from quillspark.functions import paths, text
from quillspark.functions.distance import osa
from quillspark.functions.porter import stem
from quillspark.operators import graph
from quillspark.operators.document import fit_budget, unsafe_query
from quillspark.operators.ftsquery import parse_query
from quillspark.operators.metadata import check_filters, parse_filters
from quillspark.plans.queries import QUERIES
from quillspark.schema import Catalog
from quillspark.sources import markdown
from quillspark.sources.frontmatter import read_yaml, split_front_matter
from quillspark.sources.ingest import parse_files, read_errors, to_catalog


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).head()[0]


@pytest.mark.parametrize(
    ("target", "want"),
    [("costs.md", "metrics/costs.md"), ("../datasets/orders.md", "datasets/orders.md"), ("/datasets/orders.md", "datasets/orders.md"), ("../../../etc/passwd", paths.OUTSIDE), ("report.md#section%20one", "metrics/report.md#section one"), ("costs%20report.md", "metrics/costs report.md"), ("https://example.org/a", "https://example.org/a"), ("a+b.md", "metrics/a+b.md")],
)
def test_resolve(spark, target, want):
    assert one(spark, paths.resolve_link(F.col("s"), F.col("t")), s="metrics/revenue.md", t=target) == want


@pytest.mark.parametrize(("name", "want"), [("Hello World", "hello-world"), ("Test_123", "test_123"), ("Special!@#Chars", "specialchars")])
def test_slug(spark, name, want):
    assert one(spark, text.slugify(F.col("x")), x=name) == want == markdown.slug(name)


def test_truncate(spark):
    doc = "---\ntype: x\n---\n" + "a" * 500
    cut = one(spark, text.truncate_structured(F.col("x"), 200), x=doc)
    assert cut.startswith("---\ntype: x\n---\n") and text.MARKER in cut and len(cut) <= 200


def test_porter_agrees_with_fts5():
    words = "running needles monthly revenue revenues relational conditional happily hoping hopping agreed plastered bled motoring sing conflated troubled sized falling hissing filing happy sky generalization oscillators probate rate cease controlling roll subscriptions cancellation formaliti sensitiviti triplicate goodness adjustable defensible irritant replacement adoption communism effective bowdlerize feed caresses ponies ties cats".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    for w in words:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert db.execute("SELECT term FROM v").fetchall() == [(stem(w),)], w


@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_osa_is_capped_and_symmetric(a, b):
    assert osa(a, b, 3) == osa(b, a, 3) <= 4
    assert (osa(a, b, 3) == 0) == (a == b)


def test_osa_counts_a_swap_once():
    assert osa("ab", "ba", 3) == 1 and osa("reveneu", "revenue", 3) == 1


def test_front_matter():
    assert split_front_matter("no") is None
    assert split_front_matter("---\ntype: A\n---\nbody") == ("type: A", "body")
    assert split_front_matter("﻿---\r\ntype: A\r\n----\r\nx") == ("type: A", "x")
    with pytest.raises(ParseError, match="Missing closing"):
        split_front_matter("---\ntype: A\n")
    with pytest.raises(ParseError, match="exceeds"):
        split_front_matter("---\ntype: A\n---\n", most=3)
    for bad in ("%", "%foo", "%%", "\n-\n%", "[1, 2]", "a: [", "- x"):
        with pytest.raises(ParseError):
            read_yaml(bad)


def test_yaml_values():
    got = read_yaml("type: [a, b]\ntags: [x, x, 1]\nowner: Ann\nn: 3\nf: true\ntyped_links: {version: 2}")
    assert got["type"] == "[a, b]" and got["tags"] == ["x", "1"]
    assert got["custom"] == {"owner": '"Ann"', "n": "3", "f": "true", "typed_links": '{"version":2}'}


def test_markdown():
    got = markdown.parse("# One `x`\n\nA [b](c.md) ![no](i.png).\n\n```py:f.py\n# not\n```\n\n| a | b |\n|:--|--:|\n| 1 | `2` |\n\nTwo\n---\n[[a [2024]]] [[x|y]]")
    assert [(h["level"], h["title"]) for h in got["headings"]] == [(1, "One x"), (2, "Two")]
    assert got["links"] == ["c.md", "a [2024]", "x"]
    assert got["code_blocks"][0] == {"language": "py", "filename": "f.py", "content": "# not", "pos": 1}
    assert got["tables"][0]["alignments"] == ["Left", "Right"] and got["tables"][0]["rows"] == [["1", ""]]
    assert got["sections"][0]["heading"] == "One" and "not" not in got["sections"][0]["content"]


@given(st.text())
def test_markdown_never_fails(body):
    markdown.parse(body)


@pytest.mark.parametrize("bad", ["foo-bar", "what?", "a AND", "c++", "", "(a", "nosuch:a", "OR a"])
def test_malformed_queries(bad):
    with pytest.raises(ValidationError):
        parse_query(bad)


def test_query_tree():
    assert parse_query("a b OR c NOT d")[1] == ("or", ("and", ("p", 0), ("p", 1)), ("not", ("p", 2), ("p", 3)))


def test_filters():
    assert parse_filters(["location=s3://bucket?a=b"]) == {"location": "s3://bucket?a=b"}
    for bad in (["type"], ["=Metric"], ["a=1", "a=2"]):
        with pytest.raises(ValidationError):
            parse_filters(bad)
    for bad in ({"type!": "a"}, {"path;drop": "a"}, {"x_contains": "a"}, {"a": 1}):
        with pytest.raises(ValidationError):
            check_filters(bad)


def test_config(tmp_path):
    with pytest.raises(ConfigError):
        Config(b=2)
    (tmp_path / "c.toml").write_text("max_graph_depth = 3\n")
    assert load_config(str(tmp_path / "c.toml"), {"QUILL_MAX_GRAPH_NODES": "7"}).max_graph_nodes == 7


def test_budget_and_hints():
    out = fit_budget({"path": "p", "body": "x" * 2000, "links": [1] * 400}, 900)
    import json

    assert len(json.dumps(out)) <= 900 and out["body_truncated"]
    assert all(map(unsafe_query, ("", "../a", "./a", "/x", "C:\\a", "file://a"))) and not unsafe_query("a/b.md")


def test_reachable_has_no_bound(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(68)] + [("x", "n3"), ("n5", None)], "src string, dst string")
    assert {r["path"] for r in graph.reachable(links, "n0").collect()} == {f"n{i}" for i in range(1, 69)}


def test_content_hash_covers_whole_long_texts(spark):
    row = spark.range(1).select(F.repeat(F.lit("a"), 1 << 21).alias("t")).select("t", F.concat(F.substring("t", 1, 5000), F.lit("b"), F.substring("t", 5002, 1 << 21)).alias("u"))
    got = row.select(text.content_hash(F.col("t")).alias("t"), text.content_hash(F.col("u")).alias("u"), text.content_hash(F.col("t"), sampled=True).alias("s"), text.content_hash(F.col("u"), sampled=True).alias("v"), F.sha2("t", 256).alias("want")).head()
    assert got["t"] == got["want"] != got["u"] and got["s"] == got["v"]


def test_markdown_containers_references_and_html():
    r = markdown.parse('# A *b* `c` ##\n\n> ## In quote\n> [x](a.md)\nlazy [r][Ref] and [ref] [foo][]\n\n- # Item head\n\n  second [y](b.md "t")\n\n      code\n  1. sub [z](<c d.md>)\n\n[REF]: /r.md \'title\'\n[foo]: <f g.md>\n')
    assert [(h["level"], h["title"]) for h in r["headings"]] == [(1, "A b c"), (2, "In quote"), (1, "Item head")]
    assert r["links"] == ["a.md", "/r.md", "/r.md", "f g.md", "b.md", "c d.md"]
    r = markdown.parse("AT&amp;T &lt;b&gt; &#65; <!-- [no](x.md) --> a<br>b \\*not\\* **bo*ld*** snake_case\n\n<!-- \n# no\n[no](y.md)\n-->\n\n<div>\n[no](z.md)\n</div>\n\n<div>\n\n[yes](w.md)\n\n</div>")
    assert (r["links"], r["headings"], r["plain_text"]) == (["w.md"], [], "AT&T <b> A a b *not* bold snake_case yes")
    r = markdown.parse("``x ` y`` ![alt [in](i.md)](img.png) [out ![i](p.png)](o.md) [a [b](c.md) d](e.md) <me@x.org> [f]() [g](a(b(c)).md)")
    assert r["links"] == ["i.md", "o.md", "c.md", "mailto:me@x.org", "", "a(b(c)).md"]


@pytest.mark.parametrize("part", ["*a ", "**a b** ", "[", "[a](", "[a]", "![[", "`", "<a ", "> ", "- ", "_a_*b", '[a](b "', "| a ", "\\", "<!--", "[a]: b\n", "*_", "- a\n  ", "[[", "[a][b]", "<b c='"])
def test_markdown_takes_linear_time(part):
    def took(n):
        began = time.process_time()
        markdown.parse(part * n)
        return time.process_time() - began

    few, many = min(took(4_000) for _ in range(3)), took(64_000)
    assert many < 48 * few + 0.5


def _links(spark, pairs):
    rows = [(a, b, None, None, None, 1) for a, b in pairs]
    links = spark.createDataFrame(rows, "src string, dst string, anchor string, external_url string, relation string, pos int")
    docs = spark.createDataFrame([(x, x, "t") for x in sorted({x for p in pairs for x in p})], "path string, title string, type string")
    return Catalog(docs, None, None, links, None, None)


def test_cycles_by_labels(spark):
    """Random graphs against plain reachability."""
    rng = random.Random(3)
    between = [("n8", "n9"), ("n9", "n8"), ("n8", "n0"), ("n0", "n5"), ("n5", "n6"), ("n6", "n5")]  # n0 is on no cycle
    for n, m in ((0, 0), (12, 14), (30, 45)):
        pairs = between if not n else sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})
        reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
        for _ in range(n or 9):
            reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
        want = {a: min(b for b in bs if a in reach.get(b, ())) for a, bs in reach.items() if a in bs}
        assert dict(tuple(r) for r in graph.cycle_members(_links(spark, pairs)).collect()) == want


def test_traversal_names_the_linking_document_as_source(spark):
    c = _links(spark, [("a", "hub"), ("b", "hub"), ("hub", "c"), ("c", "d"), ("d", "d"), ("a", "b")])
    nodes, edges = graph.traverse(c, c.documents.where("path = 'hub'").select("path"), 1, 10)
    assert sorted((r["path"], r["depth"]) for r in nodes.collect()) == [("a", 1), ("b", 1), ("c", 1), ("hub", 0)]
    assert sorted((r["source"], r["target"], r["label"]) for r in edges.collect()) == [("a", "hub", "linked_from"), ("b", "hub", "linked_from"), ("hub", "c", "links_to")]
    nodes, edges = graph.traverse(c, c.documents.where("path = 'hub'").select("path"), 2, 3)
    assert sorted(r["path"] for r in nodes.collect()) == ["a", "b", "hub"] and edges.count() == 3


def _odd_files():
    """Files with front matter of every kind, and how large they are."""
    sound, long = "---\ntype: A\n---\nbody\n---\nmore", "---\ntitle: " + "é" * 40_000 + "\n---\nx"
    texts = ["", "no", "---", "-----", "------", "------x", "---\n---", "---\n---\nb", sound, "﻿" + sound, "﻿﻿" + sound, long, long + "\n---\ny", "---\nno end", "---x: 1\n---", "---\n[a\n---\nb", "---\n%\n---\n", "---\ntype: é\n---é", "---\r\ntype: A\r\n---\r\nb"]
    rows = [(f"{i}.md", len(t.encode()), bytearray(t.encode())) for i, t in enumerate(texts)]
    return [*rows, ("bad.md", 5, bytearray(b"\xff\xfe---")), ("big.md", 9 << 20, bytearray(b"x")), ("none.md", None, None)]


def test_errors_without_bodies_are_those_of_parsing(spark):
    files = spark.createDataFrame(_odd_files(), "path string, size long, content binary").withColumn("modified_at", F.lit(1).cast("long"))
    rows = lambda df: sorted(map(repr, df.select("path", "stage", "message", "line").collect()))
    got, want = rows(read_errors(files, Config())), rows(to_catalog(parse_files(files, Config())).errors)
    assert got == want and len(got) > 8


def test_parse_checks_read_each_file_once(spark, tmp_path):
    """One scan and one Python step, and an answer for null texts too."""
    rows = [(i, None if i < 4 else "some *text*") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["val_parse_checks"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("FileScan") == 1, plan
    kinds = {1: "unsupported_encoding", 2: "invalid_yaml", 3: "oversized_frontmatter"}
    assert sorted(map(tuple, found.collect())) == [(f"{i}.md", kinds[i % 4], "error") for i in range(8) if i % 4]
