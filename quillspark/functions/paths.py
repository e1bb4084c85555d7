"""Path and link functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTSIDE = "INVALID_PATH_TRAVERSAL"
EXTERNAL = r"^(https?://|mailto:)"


def parent_path(path: Column) -> Column:
    """The folder of a path, '' at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def percent_decode(text: Column) -> Column:
    """%XX sequences decoded; a plus sign stays, and undecodable text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def is_external(target: Column) -> Column:
    return target.rlike(EXTERNAL)


def normalize_path(path: Column) -> Column:
    """'.' dropped, '..' goes up, null above the root."""
    start = F.array(F.lit("/")).cast("array<string>")  # a first element no segment equals

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) <= 1, F.lit(None).cast("array<string>")).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when(acc.isNull(), acc).when((s == "") | (s == "."), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(F.split(path, "/"), start, step)
    return F.when(kept.isNotNull(), F.array_join(F.slice(kept, F.lit(2), F.size(kept)), "/"))


def safe_path(path: Column) -> Column:
    """Relative, and never upwards."""
    return ~path.rlike(r"^(/|\\|[A-Za-z]:)") & ~F.array_contains(F.split(path, r"[/\\]"), "..")


def split_anchor(target: Column) -> tuple[Column, Column]:
    """Target before the first '#', and the decoded fragment or null."""
    at = F.locate("#", target)
    return F.substring_index(target, "#", 1), F.when(at > 0, percent_decode(target.substr(at + 1, F.length(target))))


def resolve_link(source: Column, target: Column) -> Column:
    """Repository path that a link in source means; external links as they are, those above the root marked.

    Decoding happens once. A leading slash is the repository's root.
    """
    base, anchor = split_anchor(target)
    base = percent_decode(base)
    folder = parent_path(source)
    joined = F.when(base == "", source).when(base.startswith("/"), base).when(folder == "", base).otherwise(F.concat_ws("/", folder, base))
    path = normalize_path(joined)
    whole = F.coalesce(F.concat(path, F.when(anchor.isNotNull(), F.concat(F.lit("#"), anchor)).otherwise(F.lit(""))), F.lit(OUTSIDE))
    return F.when(is_external(target), target).otherwise(whole)


def glob_pattern(glob: str) -> str:
    """A regular expression for an ignore glob, matched anywhere in a root-relative path."""
    folder = glob.endswith("/")
    anchored = glob.startswith("/")
    body, i, out = glob.strip("/"), 0, ""
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if body[i] in r"\.^$+{}[]|()" else "") + body[i], i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


#: Folders and temporary files that a watcher ignores.
IGNORED = r"(^|/)(\.git|vendor|node_modules|target)/|(^|/)(\.[^/]*|#[^/]*#)$|(~|\.sw[pox]|(?i:\.tmp|\.bak|\.crash))$"


def ignored(path: Column, patterns: tuple[str, ...] = ()) -> Column:
    out = path.rlike(IGNORED)
    for p in patterns:
        out = out | path.rlike(glob_pattern(p))
    return out


def ignore_rules(text: str | None, folder: str = "") -> list[tuple[str, bool]]:
    """(pattern, whether it takes paths back in) of the lines of the .gitignore file of a folder, in order.

    A slash before a pattern's end ties it to the folder; a backslash makes a leading # or ! a plain sign. Rules of a
    folder hold below it only; those of folders further down come after those above, as the last one that matches decides.
    """
    out = []
    for line in (text or "").splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        back = line.startswith("!")
        glob = line[1:] if back else line
        if not glob.strip("/") or glob.startswith("#"):
            continue
        glob = glob.replace("\\ ", " ").removeprefix("\\") if glob[:2] in ("\\#", "\\!") or "\\ " in glob else glob
        if "/" in glob.rstrip("/") and not glob.startswith("**/"):
            glob = "/" + glob.lstrip("/")
        pattern = glob_pattern(glob)
        if folder:
            below = "^" + re.sub(r"([\\.^$+{}\[\]|()*?])", r"\\\1", folder.strip("/")) + "/"
            pattern = below + (pattern[1:] if pattern.startswith("^") else "(?:.*/)?" + pattern.removeprefix("(?:^|/)"))
        out.append((pattern, back))
    return out


def gitignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches a root-relative path decides."""
    out = F.lit(False)
    for pattern, back in rules:
        out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out
