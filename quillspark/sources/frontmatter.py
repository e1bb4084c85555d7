"""YAML front matter: finding it, and reading it into known keys, typed links and custom JSON values."""

from __future__ import annotations

import json
import re

try:
    import yaml
except ImportError:  # pragma: no cover - reported as a YAML error of each file
    yaml = None

from ..errors import LimitError, ParseError

CLOSE = re.compile(r"\n---")
KNOWN = ("type", "title", "description", "tags", "typed_links")


def too_large(most: int, size: int) -> ParseError:
    return ParseError("frontmatter", str(LimitError("front_matter_size", most, size)))


def split_front_matter(text: str, most: int = 64 << 10) -> tuple[str, str] | None:
    """(yaml, body), or None without front matter. The closing line is the first later one that starts with ---."""
    text = text.removeprefix("﻿")
    if len(text) < 6 or not text.startswith("---"):
        return None
    if text.startswith("---", 3):
        found, end = "", 6
    else:
        m = CLOSE.search(text, 3)
        if not m:
            raise ParseError("frontmatter", "Missing closing front-matter delimiter")
        found, end = text[3 : m.start()], m.end()
    size = len(found.encode())
    if size > most:
        raise too_large(most, size)
    after = text.find("\n", end)
    return found.lstrip("\r\n").rstrip("\r"), text[after + 1 :] if after >= 0 else ""


def scalar_text(value) -> str:
    """How a YAML value prints as text."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, list):
        return "[" + ", ".join(map(scalar_text, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{scalar_text(k)}: {scalar_text(v)}" for k, v in value.items()) + "}"
    return str(value)


def _plain(value):
    """JSON types only: dates and the like become text."""
    if isinstance(value, dict):
        return {scalar_text(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def typed_links(value) -> list[dict] | None:
    """Links of a version-1 block; None if it deviates in any way."""
    if not isinstance(value, dict) or value.keys() != {"version", "links"} or value["version"] != 1 or isinstance(value["version"], bool) or not isinstance(value["links"], list):
        return None
    out = []
    for x in value["links"]:
        if not isinstance(x, dict) or x.keys() - {"target", "relation", "anchor"} or not isinstance(x.get("target"), str) or not isinstance(x.get("relation"), str) or not x["target"] or not x["relation"]:
            return None
        if x.get("anchor") is not None and not isinstance(x["anchor"], str):
            return None
        out.append({"target": x["target"], "relation": x["relation"], "anchor": x.get("anchor")})
    return out


def read_yaml(text: str, most: int = 8 << 20) -> dict:
    """type, title, description, tags, links, custom (key -> JSON text)."""
    if len(text.encode()) > most:
        raise ParseError("yaml", str(LimitError("yaml_input_size", most)))
    if yaml is None:
        raise ParseError("yaml", "no YAML reader is installed")
    if not any(x.strip() and not x.lstrip().startswith(("%", "#")) for x in text.splitlines()):
        raise ParseError("yaml", "front matter has no mapping")
    try:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        found = next(iter(yaml.load_all(text, Loader=loader)), None)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise ParseError("yaml", str(e).split("\n")[0], mark.line + 1 if mark else None) from e
    except (ValueError, RecursionError) as e:
        raise ParseError("yaml", str(e)) from e
    if not isinstance(found, dict):
        raise ParseError("yaml", "front matter must be a mapping")
    known = {k: None if found.get(k) is None else scalar_text(found[k]) for k in ("type", "title", "description")}
    tags = [scalar_text(t) for t in found["tags"]] if isinstance(found.get("tags"), list) else []
    custom = {scalar_text(k): _plain(v) for k, v in found.items() if k not in KNOWN}
    links = []
    if "typed_links" in found:
        links = typed_links(found["typed_links"])
        if links is None:
            links, custom["typed_links"] = [], _plain(found["typed_links"])
    return known | {"tags": list(dict.fromkeys(tags)), "typed_links": links, "custom": {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in custom.items()}}
