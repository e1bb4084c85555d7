"""Repository validation: checks as DataFrames of issues(path, severity, category, message), and their report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent_path
from ..schema import Catalog
from .graph import broken_links, cycle_members, typed_conflicts

#: Check name -> (severity, categories).
CHECKS = {
    "broken_links": ("warning", ("broken_link",)),
    "typed_link_conflicts": ("warning", ("typed_link_conflict",)),
    "scan_errors": ("error", ("read", "utf8", "size", "frontmatter", "yaml")),
    "missing_index_files": ("warning", ("missing_index_files",)),
    "unsupported_encoding": ("error", ("unsupported_encoding",)),
    "oversized_frontmatter": ("error", ("oversized_frontmatter",)),
    "invalid_frontmatter": ("error", ("invalid_frontmatter",)),
    "invalid_yaml": ("error", ("invalid_yaml",)),
    "reserved_file_frontmatter": ("error", ("reserved_file_frontmatter",)),
    "missing_type": ("error", ("missing_type",)),
    "duplicate_concept": ("error", ("duplicate_concept",)),
    "duplicate_content": ("warning", ("duplicate_content",)),
    "circular_references": ("warning", ("circular_references",)),
}
RESERVED = r"(^|/)(index|log)\.md$"
ROOT_KEY = "okf_version"


def _issues(df: DataFrame, severity: str, category: str | Column, message: Column, path: str = "path") -> DataFrame:
    category = F.lit(category) if isinstance(category, str) else category
    return df.select(F.col(path).alias("path"), F.lit(severity).alias("severity"), category.alias("category"), message.alias("message"))


def reserved(path: Column) -> Column:
    return path.rlike(RESERVED)


def check_broken_links(c: Catalog) -> DataFrame:
    return _issues(broken_links(c), "warning", "broken_link", F.concat(F.lit("Broken link to "), F.coalesce("dst", F.lit(""))), "src")


def check_conflicts(c: Catalog) -> DataFrame:
    return _issues(typed_conflicts(c.links), "warning", "typed_link_conflict", F.concat(F.lit("Linked with and without a relation: "), "dst"), "src")


def check_errors(c: Catalog) -> DataFrame:
    return _issues(c.errors, "error", F.col("stage"), F.col("message"))


def check_index_files(c: Catalog) -> DataFrame:
    dirs = c.documents.select("parent_path").where("parent_path <> ''").distinct()
    have = c.documents.where(F.col("path").rlike(r"(^|/)index\.md$")).select(parent_path(F.col("path")).alias("parent_path"))
    missing = dirs.join(have, "parent_path", "left_anti")
    return _issues(missing, "warning", "missing_index_files", F.concat(F.lit("No index.md in "), "parent_path"), "parent_path")


def check_files(c: Catalog) -> DataFrame:
    """What is wrong with files' encoding, front matter and YAML, in one pass over the errors."""
    kind = F.when(F.col("stage") == "utf8", "unsupported_encoding").when(F.col("stage") == "yaml", "invalid_yaml")
    kind = kind.when(F.col("message").contains("exceed"), "oversized_frontmatter").otherwise("invalid_frontmatter")
    return _issues(c.errors.where("stage IN ('utf8', 'frontmatter', 'yaml')"), "error", kind, F.col("message"))


def check_encoding(c: Catalog) -> DataFrame:
    return check_files(c).where("category = 'unsupported_encoding'")


def check_front_matter(c: Catalog) -> DataFrame:
    return check_files(c).where("category IN ('oversized_frontmatter', 'invalid_frontmatter')")


def check_yaml(c: Catalog) -> DataFrame:
    return check_files(c).where("category = 'invalid_yaml'")


def _sound(c: Catalog) -> DataFrame:
    return c.documents.where("has_front_matter AND parse_status = 'ok'")


def check_reserved(c: Catalog) -> DataFrame:
    """Reserved files: none has front matter, but at the root a version key alone may stand."""
    docs = _sound(c).where(reserved(F.col("path")))
    keys = c.custom.where(F.col("key") != ROOT_KEY).groupBy("path").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    tags = c.tags.select("path").distinct().withColumn("tagged", F.lit(True))
    docs = docs.join(keys, "path", "left").join(tags, "path", "left")
    used = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in ("title", "type", "description")], F.when(F.col("tagged"), F.lit("tags"))))
    used = F.concat(used, F.coalesce("keys", F.array().cast("array<string>")))
    docs = docs.withColumn("used", used)
    root = ~F.col("path").contains("/")
    docs = docs.where(~root | (F.size("used") > 0))
    text = F.when(root, F.concat(F.lit(f"Only {ROOT_KEY} may stand in a root index: "), F.array_join("used", ", "))).otherwise("Reserved files have no front matter")
    return _issues(docs, "error", "reserved_file_frontmatter", text)


def check_type(c: Catalog) -> DataFrame:
    docs = _sound(c).where(~reserved(F.col("path")) & (F.trim(F.coalesce("type", F.lit(""))) == ""))
    return _issues(docs, "error", "missing_type", F.lit("Required field 'type' is missing"))


def check_concepts(c: Catalog) -> DataFrame:
    """Documents after the first of the same type and title. Groups are folded to their first path and joined back, so
    a very common title is combined before the shuffle."""
    docs = _sound(c).where(~reserved(F.col("path")) & F.col("type").isNotNull() & F.col("title").isNotNull())
    first = docs.groupBy("type", "title").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = docs.join(first, ["type", "title"]).where(F.col("path") != F.col("first"))
    return _issues(again, "error", "duplicate_concept", F.concat(F.lit("Same type and title as "), "first"))


def content_groups(c: Catalog) -> DataFrame:
    """content_hash, path of every member of a group of equal contents: who the others are, as rows and not as a list."""
    docs = _sound(c).where(~reserved(F.col("path")))
    groups = docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(groups, "content_hash").select("content_hash", "path")


def check_content(c: Catalog) -> DataFrame:
    """Every member of a group of equal contents, with the first other member and the group's size."""
    docs = _sound(c).where(~reserved(F.col("path")))
    groups = docs.groupBy("content_hash").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n"), F.max("path").alias("last")).where("n > 1")
    other = F.when(F.col("path") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    return _issues(docs.join(groups, "content_hash"), "warning", "duplicate_content", F.concat(F.lit("Same content as "), other, F.lit(" ("), F.col("n").cast("string"), F.lit(" documents)")))


def check_cycles(c: Catalog) -> DataFrame:
    found = cycle_members(c).groupBy("cycle_id").agg(F.count(F.lit(1)).alias("n"))
    return _issues(found, "warning", "circular_references", F.concat(F.lit("A cycle of "), F.col("n").cast("string"), F.lit(" documents")), "cycle_id")


def validate(catalog: Catalog, require_index_files: bool = False, cycles: bool = True) -> DataFrame:
    parts = [check_broken_links, check_conflicts, check_errors, check_files, check_reserved, check_type, check_concepts, check_content]
    parts += [check_index_files] * require_index_files + [check_cycles] * cycles
    return reduce(DataFrame.unionByName, [p(catalog) for p in parts])


def validate_incremental(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Issues of changed(path); those of links and cycles stay whatever changed."""
    whole = F.col("category").isin("broken_link", "typed_link_conflict", "circular_references")
    marked = issues.join(changed.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return marked.where(whole | F.col("_hit")).drop("_hit")


def report(issues: DataFrame) -> DataFrame:
    """check, status (pass, warn, fail), issue_count over all named checks."""
    table = [(name, severity, category) for name, (severity, categories) in CHECKS.items() for category in categories]
    checks = issues.sparkSession.createDataFrame(table, "check string, severity string, category string")
    counts = issues.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    rolled = checks.join(counts, "category", "left").groupBy("check", "severity").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count"))
    return rolled.select("check", F.when(F.col("issue_count") == 0, "pass").when(F.col("severity") == "error", "fail").otherwise("warn").alias("status"), "issue_count")


def exit_status(issues: DataFrame) -> int:
    kinds = {r[0] for r in issues.select("severity").distinct().collect()}
    return 1 if "error" in kinds else 2 if "warning" in kinds else 0
