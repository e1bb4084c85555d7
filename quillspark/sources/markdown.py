"""A CommonMark reader with pipe tables: headings, links, tables, code blocks, sections and plain text.

Blocks come first: containers (quotes, list items) are unwrapped and read like a document of their own, link definitions
are gathered from everywhere. Inline parsing then runs over each block's text with a stack of brackets and one of emphasis
delimiters, in time linear in the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

FENCE = re.compile(r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+|$)(.*)$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
DIVIDER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
LIST = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])( +|$)")
QUOTE = re.compile(r"^ {0,3}>[ ]?")
#: Elements that begin a block of HTML which ends at a blank line.
HTML_BLOCKS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
#: How blocks of HTML begin, and what their last line holds (None: they end before a blank line).
HTML_STARTS = [(re.compile(start, re.I), end and re.compile(end, re.I)) for start, end in ((r"^ {0,3}<(?:script|pre|style|textarea)(?=\s|>|$)", r"</(?:script|pre|style|textarea)>"), (r"^ {0,3}<!--", "-->"), (r"^ {0,3}<\?", r"\?>"), (r"^ {0,3}<!\[CDATA\[", r"\]\]>"), (r"^ {0,3}<![A-Za-z]", ">"), (rf"^ {{0,3}}</?(?:{'|'.join(HTML_BLOCKS.split())})(?=\s|/?>|$)", None), (rf"^ {{0,3}}(?:{TAG})[ \t]*$", None))]
DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|([^\s<]\S*))(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)", re.S)
TOKEN = re.compile(rf"(?P<esc>\\[!-/:-@\[-`{{-~])|(?P<tick>`+)|<(?P<url>[A-Za-z][A-Za-z0-9+.-]{{1,31}}:[^\s<>]*)>|<(?P<mail>[\w.!#$%&'*+/=?^`{{|}}~-]+@[A-Za-z0-9.-]+)>|(?P<html><!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|{TAG})|(?P<entity>&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});)|(?P<open>!?\[)|(?P<close>\])|(?P<mark>\*+|_+)", re.S)
TARGET = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\<]|\\.)?(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
#: Containers inside containers that are unwrapped; deeper ones read as text.
MOST_NESTED = 40


def slug(text: str) -> str:
    kept = "".join(c for c in text.lower() if c.isalnum() or c in " _-" or c.isspace())
    return re.sub(r"\s+", "-", kept.strip())


def _label(text: str) -> str:
    return " ".join(text.casefold().split())


def _unescaped(text: str) -> str:
    return html.unescape(ESCAPED.sub(r"\1", text))


# --- inline ---------------------------------------------------------------------------------------------------------


def _flanks(before: str, after: str, mark: str) -> tuple[bool, bool]:
    """Whether a run of marks between two characters can open and close emphasis."""
    gap = lambda c: not c or c.isspace()
    sign = lambda c: bool(c) and not c.isalnum() and not c.isspace()
    left = not gap(after) and (not sign(after) or gap(before) or sign(before))
    right = not gap(before) and (not sign(before) or gap(after) or sign(after))
    if mark == "_":
        return left and (not right or sign(before)), right and (not left or sign(after))
    return left, right


def _emphasis(marks: list[list], nodes: list[list]) -> None:
    """Takes the marks that pair up out of nodes. marks: [node, character, run length, left, can open, can close]."""
    stack: list[list] = []
    bottoms: dict[tuple, int] = {}
    for m in marks:
        node, char, whole, _, opens, closes = m
        kind = (char, opens, whole % 3)
        while closes and m[3]:
            low = bottoms.get(kind, 0)
            at = next((i for i in range(len(stack) - 1, low - 1, -1) if stack[i][1] == char and not ((opens or stack[i][5]) and (stack[i][2] + whole) % 3 == 0 and (stack[i][2] % 3 or whole % 3))), -1)
            if at < 0:
                bottoms[kind] = len(stack)
                break
            used = 2 if m[3] >= 2 and stack[at][3] >= 2 else 1
            for x in (m, stack[at]):
                x[3] -= used
                nodes[x[0]][1] = char * x[3]
            del stack[at + (stack[at][3] > 0) :]
            bottoms = {k: min(v, len(stack)) for k, v in bottoms.items()}
        if opens and m[3]:
            stack.append(m)


def inline(text: str, defined: dict[str, str] | None = None) -> tuple[list[tuple[str, str]], list[str]]:
    """Pieces (kind text or code) in order, and link targets; defined: label -> target of link definitions."""
    defined = defined or {}
    ticks = defaultdict(list)
    for m in re.finditer("`+", text):
        ticks[len(m[0])].append(m.start())
    #: [kind, text]; a "cut" parts words.
    nodes: list[list] = []
    links: list[str] = []
    #: open brackets: [node, whether it is an image, place in text behind it, number of marks before it, still active]
    brackets: list[list] = []
    marks: list[list] = []
    at = 0
    while m := TOKEN.search(text, at):
        if m.start() > at:
            nodes.append(["text", text[at : m.start()]])
        at, kind = m.end(), m.lastgroup
        if kind == "esc":
            nodes.append(["text", m[0][1]])
        elif kind == "entity":
            nodes.append(["text", html.unescape(m[0])])
        elif kind == "tick":
            same = ticks[len(m[0])]
            k = bisect_right(same, m.start())
            if k < len(same):
                nodes.append(["code", " ".join(text[at : same[k]].split())])
                at = same[k] + len(m[0])
            else:
                nodes.append(["text", m[0]])
        elif kind in ("url", "mail"):
            links.append(m["url"] or "mailto:" + m["mail"])
            nodes += [["cut", ""], ["text", m["url"] or m["mail"]], ["cut", ""]]
        elif kind == "html":
            nodes.append(["cut", ""])
        elif kind == "mark":
            opens, closes = _flanks(text[m.start() - 1 : m.start()], text[at : at + 1], m[0][0])
            marks.append([len(nodes), m[0][0], len(m[0]), len(m[0]), opens, closes])
            nodes.append(["text", m[0]])
        elif kind == "open":
            brackets.append([len(nodes), m[0] == "![", at, len(marks), True])
            nodes.append(["text", m[0]])
        elif not brackets:
            nodes.append(["text", "]"])
        else:
            node, image, begin, first, active = brackets.pop()
            target, end = None, at
            if active:
                if found := TARGET.match(text, at):
                    target, end = _unescaped(found[1] if found[1] is not None else found[2]), found.end()
                elif defined:
                    full = LABEL.match(text, at)
                    name = full[1] if full and full[1].strip() else text[begin : m.start()] if m.start() - begin < 1000 else ""
                    target = defined.get(_label(name))
                    if target is not None and full:
                        end = full.end()
            if target is None:
                nodes.append(["text", "]"])
                continue
            at = end
            _emphasis(marks[first:], nodes)
            del marks[first:]
            nodes[node] = ["cut", ""]
            nodes.append(["cut", ""])
            if not image:
                links.append(target)
                for b in brackets:
                    if not b[1]:
                        b[4] = False
                brackets = [b for b in brackets if b[4]]
    if at < len(text):
        nodes.append(["text", text[at:]])
    _emphasis(marks, nodes)
    pieces: list[tuple[str, str]] = []
    held: list[str] = []
    for kind, value in [*nodes, ["cut", ""]]:
        if kind == "text":
            held.append(value)
            continue
        if words := " ".join("".join(held).split()):
            pieces.append(("text", words))
        held = []
        if kind == "code" and value:
            pieces.append(("code", value))
    return pieces, links


# --- blocks ---------------------------------------------------------------------------------------------------------


def cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _words(pieces: list[tuple[str, str]], code: bool = True) -> str:
    return " ".join(t for kind, t in pieces if code or kind == "text")


def _plain(line: str) -> str:
    """The line with its leading tabs as spaces."""
    bare = line.lstrip(" \t")
    lead = line[: len(line) - len(bare)]
    return lead.expandtabs(4) + bare if "\t" in lead else line


def _html_end(line: str, interrupts: bool) -> tuple[bool, re.Pattern | None]:
    if "<" in line:
        for start, end in HTML_STARTS[:-1] if interrupts else HTML_STARTS:
            if start.match(line):
                return True, end
    return False, None


def _interrupts(line: str) -> bool:
    """Whether a line that could go on a paragraph begins another block."""
    if m := LIST.match(line):
        return bool(line[m.end() :].strip()) and (m[2] in "-*+" or m[2][:-1] == "1") or bool(RULE.match(line))
    return bool(FENCE.match(line) or ATX.match(line) or RULE.match(line) or QUOTE.match(line)) or _html_end(line, True)[0]


def _inside(lines: list[str], i: int, first: str, strip) -> tuple[list[str], int]:
    """The lines of a container whose first one is given, and where it ends. strip: a line's content, or None where the
    container doesn't go on by itself; a paragraph in it may go on lazily."""
    out, fence = [first], ""
    i += 1

    def seen(line: str) -> None:
        nonlocal fence
        if m := FENCE.match(line):
            if not fence:
                fence = m[2]
            elif m[2][0] == fence[0] and len(m[2]) >= len(fence) and not m[3].strip():
                fence = ""

    seen(first)
    while i < len(lines):
        line = strip(lines[i], out)
        if line is None:
            if not lines[i].strip() or not out[-1].strip() or fence or _interrupts(lines[i]):
                break
            last = QUOTE.sub("", out[-1]).strip()  # only text goes on
            if ATX.match(last) or RULE.match(last) or FENCE.match(last) or SETEXT.match(lines[i]):
                break
            line = lines[i].lstrip()
        else:
            seen(line)
        out.append(line)
        i += 1
    return out, i


def blocks(body: str) -> tuple[list[tuple], dict[str, str]]:
    """("heading", level, text) | ("fence", info, content) | ("code", content) | ("table", head, aligns, rows) |
    ("text", lines) in order, whatever contains them, and the link definitions (the first of a label counts)."""
    out: list[tuple] = []
    defined: dict[str, str] = {}
    lines = [_plain(x) for x in body.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    _read(lines, 0, out, defined)
    return out, defined


def _read(lines: list[str], nested: int, out: list[tuple], defined: dict[str, str]) -> None:
    para: list[str] = []

    def text() -> str:
        """The open paragraph without the link definitions that it begins with."""
        whole, at = "\n".join(para), 0
        para.clear()
        while whole.startswith("[", at) and (m := DEFINITION.match(whole[at : at + 4000])):
            defined.setdefault(_label(m[1]), _unescaped(m[2] if m[2] is not None else m[3]))
            at += m.end()
        return whole[at:]

    def flush() -> None:
        if para and (left := text()):
            out.append(("text", left))

    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            flush()
        elif not para and line.startswith("    "):
            content = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                content.append(lines[i][4:])
                i += 1
            out.append(("code", "\n".join(content).rstrip()))
            continue
        elif m := FENCE.match(line):
            flush()
            indent, mark, content = len(m[1]), m[2], []
            closing = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            i += 1
            while i < len(lines) and not closing.match(lines[i]):
                content.append(lines[i][min(indent, len(lines[i]) - len(lines[i].lstrip(" "))) :])
                i += 1
            out.append(("fence", _unescaped(m[3].strip()), "\n".join(content)))
        elif m := ATX.match(line):
            flush()
            title = m[2].strip()
            bare = title.rstrip("#")
            out.append(("heading", len(m[1]), bare.rstrip() if bare != title and (not bare or bare[-1] in " \t") else title))
        elif para and (m := SETEXT.match(line)) and (title := text()):
            out.append(("heading", 1 if m[1][0] == "=" else 2, title))
        elif RULE.match(line):
            flush()
        elif nested < MOST_NESTED and (m := QUOTE.match(line)):
            flush()
            inner, i = _inside(lines, i, _plain(line[m.end() :]), lambda x, _: _plain(x[q.end() :]) if (q := QUOTE.match(x)) else None)
            _read(inner, nested + 1, out, defined)
            continue
        elif nested < MOST_NESTED and (m := LIST.match(line)) and (not para or _interrupts(line)):
            flush()
            width = m.end() if m[3] and len(m[3]) <= 4 and line[m.end() :] else m.end(2) + 1
            go_on = lambda x, had, width=width: x[width:] if x[:width].isspace() and len(x) >= width else "" if not x.strip() and (len(had) > 1 or had[0].strip()) else None
            inner, i = _inside(lines, i, line[width:], go_on)
            _read(inner, nested + 1, out, defined)
            continue
        elif (found := _html_end(line, bool(para)))[0]:
            flush()
            while i < len(lines) and (lines[i].strip() if found[1] is None else not found[1].search(lines[i])):
                i += 1
            if found[1] is None:
                continue
        elif "|" in line and i + 1 < len(lines) and DIVIDER.match(lines[i + 1]) and len(cells(line)) == len(cells(lines[i + 1])):
            flush()
            head = cells(line)
            aligns = ["Center" if c[0] == c[-1] == ":" else "Left" if c[0] == ":" else "Right" if c[-1] == ":" else "None" for c in cells(lines[i + 1])]
            rows, i = [], i + 2
            while i < len(lines) and lines[i].strip() and not _interrupts(lines[i]):
                row = cells(lines[i])
                rows.append((row + [""] * len(head))[: len(head)])
                i += 1
            out.append(("table", head, aligns, rows))
            continue
        else:
            para.append(line.strip(" ") if para else line.lstrip(" "))
        i += 1
    flush()


def wiki_links(body: str) -> list[str]:
    """Targets of [[target|label]]; brackets inside count, and the first unmatched one closes."""
    out, at = [], 0
    while (at := body.find("[[", at)) >= 0:
        depth, i = 1, at + 2
        while i < len(body) and depth:
            depth += (body[i] == "[") - (body[i] == "]")
            i += 1
        if depth:
            break
        target = body[at + 2 : i - 1].split("|")[0].strip()
        if target:
            out.append(target)
        at = i
    return out


def parse(body: str) -> dict:
    """headings, links (Markdown's, then wiki's), tables, code_blocks, sections, plain_text."""
    headings, links, tables, codes, sections, plain = [], [], [], [], [], []
    content: list[str] | None = None

    def close() -> None:
        if content is not None and sections[-1]["heading"]:
            sections[-1]["content"] = " ".join(content).strip()
        elif content is not None:
            sections.pop()

    found_blocks, defined = blocks(body)
    for kind, *rest in found_blocks:
        if kind == "heading":
            pieces, found = inline(rest[1], defined)
            text = _words(pieces)
            links += found
            plain.append(text)
            headings.append({"level": rest[0], "title": text, "anchor": slug(text), "pos": len(headings) + 1})
            close()
            sections.append({"heading": _words(pieces, code=False), "level": rest[0], "content": "", "pos": len(sections) + 1})
            content = []
        elif kind == "fence":
            language, _, file = rest[0].partition(":")
            codes.append({"language": language or None, "filename": file or None, "content": rest[1].rstrip(), "pos": len(codes) + 1})
            plain.append(rest[1])
        elif kind == "code":
            plain.append(rest[0])
            if content is not None:
                content.append(rest[0])
        else:
            parts = [rest[0]] if kind == "text" else [c for row in (rest[0], *rest[2]) for c in row]
            texts = []
            for part in parts:
                pieces, found = inline(part, defined)
                links += found
                plain.append(_words(pieces))
                texts.append(_words(pieces, code=False))
            if content is not None:
                content += [t for t in texts if t]
            if kind == "table":
                n = len(rest[0])
                rows = [texts[i : i + n] for i in range(0, len(texts), n)]
                tables.append({"headers": rows[0], "rows": rows[1:], "alignments": rest[1], "pos": len(tables) + 1})
    close()
    return {"headings": headings, "links": links + wiki_links(body), "tables": tables, "code_blocks": codes, "sections": sections, "plain_text": " ".join(p for p in plain if p)}
