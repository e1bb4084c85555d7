"""Main-text extraction from HTML by two-pass block rules.

Markup is cut into blocks. Pass 1 decides blocks by link density, length and stop-word density; what kind of container a
block sits in is evidence beside them: elements such as nav and footer speak against it, names such as "sidebar" and forms
do as long as the page has other main text, and outside an article only plain prose counts. Within an article a name
only speaks against what is short or full of links, and a list of links may well be its references. Where a text has no
stop words of the languages below, its length and sentences tell. Short and undecided blocks are then labelled in pass 2
by their nearest decided neighbours, headings by what follows them. Time is linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words of the languages that are read.
STOP_WORDS = frozenset(
    """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too very good world
    de la le et les des en un une du que est pour qui dans a par plus pas au sur se ne ce il sont avec son aux mais ou elle leur cette nous vous même être fait
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
    el los del las por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada vida otro después te otros aunque esa""".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never belongs to an article.
SKIP_TAGS = frozenset("head nav footer aside button select dialog menu iframe object svg noscript audio video canvas map search".split())
#: Elements that hold controls, but on some pages everything.
FORM_TAGS = frozenset("form fieldset".split())
#: Words of a class, id or role that name such a container, if all words of the name are such or say where it stands.
SKIP_NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations widget toolbar pager pagination copyright legal disclaimer contentinfo complementary search skip hidden".split())
#: Words that say where or what kind of box something is, or whose.
PLACES = frozenset("site page global main primary secondary left right top bottom inner outer sub mini sticky fixed box block area wrap wrapper container section region panel bar list item items links link text content body row col column cell group holder inline single form field button icon icons title heading article post entry story user reader readers blog news web js module component the and".split())
#: Names of what readers say, whatever element it stands in.
TALK = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Parts that turn a name into a statement about the whole layout ("has-sidebar", "no-comments"), and names of articles' heads.
STATES = frozenset("has have no not non with without".split())
HEADS, OWN = frozenset(("header", "banner")), frozenset("article post entry story content headline title".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Elements of links, which a paragraph ends if nothing else does.
UNCLOSED = frozenset(("nav", "menu"))
#: Elements that are no containers of blocks.
INNER_TAGS = frozenset("p li hr html body tr td th dt dd option".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|xmp|title)\b(?>[^>]*)(?:>|\Z).*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:/?>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
CLOSING = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")
WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\u2026](?=\s|$)|[\u3002\uff01\uff1f\u0964]")
#: A heading over what readers say.
TALK_HEADING = re.compile(r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?|leave a (?:reply|comment))(?:\s*\(?\d+\)?)?\s*:?", re.I)
#: A notice that asks for consent to cookies.
CONSENT = re.compile(r"\bcookies?\b", re.I), re.compile(r"\b(?:accept|agree|consent|policy|preferences|akzeptieren|einverstanden|zustimm\w*|accept(?:er|ez)|acept\w*)\b", re.I)

LINKS_BAD, LINKS_OK = 0.5, 0.2
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
#: Below it a text is in no language of which the stop words are known.
STOPS_NONE = 0.02


class Block:
    __slots__ = ("text", "linked", "tag", "inside", "doubt", "label", "stops", "prose")

    def __init__(self, text: str, linked: int, tag: str, inside: bool, doubt: int):
        """inside: within an article; doubt: 2 in an element that is never content, 1 in a named container or a form.

        stops: share of stop words; prose: long, of whole sentences, hardly linked, in whatever language."""
        self.text, self.linked, self.tag, self.inside, self.doubt, self.label = text, linked, tag, inside, doubt, ""
        words = WORD.findall(text.lower())
        self.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        self.prose = len(text) >= LONG and linked / len(text) <= LINKS_OK and (self.stops >= STOPS_LOW or len(SENTENCE_END.findall(text)) >= 2)


def _names(attributes: str) -> Iterator[set[str]]:
    """The words of each class, id and role."""
    for m in ATTRIBUTE.finditer(attributes):
        for name in m[2].strip("\"'").lower().split():
            yield {w for w in re.split(r"[^a-z]+", name) if w}


def _named(attributes: str) -> bool:
    """Whether class, id or role name a container that is not the article's: "site-footer" does, "share-price" does not."""
    if HIDDEN.search(attributes):
        return True
    for words in _names(attributes):
        found = SKIP_NAMES & words
        if found and words <= SKIP_NAMES | PLACES and not STATES & words and not (found <= HEADS and OWN & words):
            return True
    return False


def _talk(attributes: str) -> bool:
    """Whether class, id or role name what readers say."""
    return any(TALK & words and words <= SKIP_NAMES | PLACES and not STATES & words for words in _names(attributes))


def _doubt(name: str, attributes: str, inside: bool) -> int:
    if name in SKIP_TAGS or (name == "header" and not inside):
        return 2
    if name in CONTENT_TAGS or name in HEADINGS:
        return 0
    return int(name in FORM_TAGS or (bool(attributes) and _named(attributes)))


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. An open container that is never closed ends where the main content begins, a paragraph or
    heading at the latest; names and forms around an article say nothing about what is in it, unless they name comments.
    What follows a heading over comments in the same container is comments."""
    out: list[Block] = []
    parts: list[str] = []
    linked, tag, anchors, at = 0, "", 0, 0
    #: open containers: tag, doubt, whether it is an article, the named containers that were open around it, comments
    stack: list[tuple[str, int, bool, int, bool]] = []
    open_tags: Counter = Counter()
    last_closing = {m[1].lower(): m.start() for m in CLOSING.finditer(page)}
    never = named = inside = talk = 0
    under = 0  # the depth at which a heading over comments stands, plus one
    own = ""  # a paragraph or item with a name of its own

    def end_block(next_tag: str) -> None:
        nonlocal linked, tag, own, under
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            if tag in HEADINGS:
                level = len(stack) + 1 - bool(stack and stack[-1][0] in HEADINGS)
                under = level if TALK_HEADING.fullmatch(text) else 0 if under == level else under
            out.append(Block(text, linked, tag, inside > 0 and not talk, 2 if never else int(named > 0 or own != "" or talk > 0 or under > 0)))
        parts.clear()
        linked, tag, own = 0, next_tag, ""

    def close(since: int) -> None:
        nonlocal never, named, inside, talk, under
        for name, doubt, content, around, says in reversed(stack[since:]):
            talk -= says
            open_tags[name] -= 1
            never -= doubt == 2
            named = around if content else named - (doubt == 1)
            inside -= content
        del stack[since:]
        if under > len(stack) + 1:
            under = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if anchors:
                linked += m.start() - at
        at = m.end()
        name, attributes, closing = (m[3] or "").lower(), m[4], bool(m[2])
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            anchors = 0 if closing else 1
        if name in VOID_TAGS and name != "hr":
            continue
        if name in BLOCK_TAGS:
            end_block("" if closing else name)
            anchors = 0
        if closing:
            if open_tags[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        content = name in CONTENT_TAGS or bool(attributes and name in BLOCK_TAGS and MAIN_ROLE.search(attributes))
        if never and not inside and (content or name == "p" or name in HEADINGS) and (content or stack[-1][0] in UNCLOSED) and last_closing.get(stack[-1][0], -1) < at:
            close(0)
        if name in INNER_TAGS:
            own = name if attributes and name in ("p", "li") and _named(attributes) else ""
        elif name in BLOCK_TAGS or name in SKIP_TAGS or content or (attributes and "class" in attributes.lower() and _named(attributes)):
            doubt = 0 if content else _doubt(name, attributes or "", inside > 0)
            says = bool(attributes) and _talk(attributes)
            stack.append((name, doubt, content, named, says))
            talk += says
            open_tags[name] += 1
            never += doubt == 2
            named = 0 if content else named + (doubt == 1)
            inside += content
    if at < len(page):
        parts.append(page[at:])
    end_block("")
    return out


def _decide(b: Block, elsewhere: bool) -> str:
    """Pass 1: good, bad, or what pass 2 has to settle: short and near. elsewhere: the page has an article without b."""
    n = len(b.text)
    links = b.linked / n
    if b.inside:  # references and paragraphs of links belong to it
        return "short" if b.tag in HEADINGS or n < SHORT else "good" if b.prose or links > LINKS_OK else "near"
    if links > LINKS_BAD or (n < 2 * LONG and all(x.search(b.text) for x in CONSENT)):
        return "bad"
    if elsewhere:
        known = b.stops >= STOPS_HIGH or b.stops < STOPS_NONE
        return "good" if known and b.prose and b.tag not in HEADINGS else "bad"
    if b.tag in HEADINGS or n < SHORT:
        return "short"
    return "good" if b.prose or b.stops >= STOPS_LOW and links <= LINKS_OK else "near"


def _nearest(labels: list[str]) -> list[tuple[int, str]]:
    """Distance and label of the last decided block before each."""
    out, last, label = [], -1, ""
    for i, x in enumerate(labels):
        out.append((i - last, label))
        if x in ("good", "bad"):
            last, label = i, x
    return out


def classify(blocks: list[Block], doubted: int = 1) -> None:
    """Sets label to good or bad; blocks of so much doubt are bad whatever they say.

    Blocks of an article inherit from the article's blocks only, all others from any; where the nearest blocks on both
    sides are equally near and differ, or there are none, the container decides.
    """
    for b in blocks:
        out = b.doubt >= doubted and not (b.doubt == 1 and b.inside and b.prose)
        b.label = "bad" if out else "?"
    article = any(b.inside and b.label != "bad" for b in blocks)
    for b in blocks:
        if b.label == "?":
            b.label = _decide(b, article and not b.inside)
    for group in ([b for b in blocks if b.inside and (b.doubt < doubted or b.label != "bad")], blocks):
        labels = [b.label for b in group]
        before, after = _nearest(labels), _nearest(labels[::-1])[::-1]
        for b, (i, left), (j, right) in zip(group, before, after, strict=True):
            if b.label in ("good", "bad"):
                continue
            default = "good" if b.inside or not (left or right) and b.label == "near" else "bad"
            if b.label == "near":
                b.label = "good" if "good" in (left, right) else default
            elif b.tag in HEADINGS:
                b.label = right or default
            elif not left or not right or left == right:
                b.label = left or right or default
            else:
                b.label = left if i < j else right if j < i else default


def extract(page: str | None) -> str:
    """Main text of one page: good blocks in page order, joined by a line feed. Null, empty and textless pages: ''."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    for doubted in (1, 2):  # where names and forms leave nothing, they are no evidence
        classify(blocks, doubted)
        if any(b.label == "good" for b in blocks):
            break
        # a page that says little: all that is neither doubted nor linked, if there is more to it than headings
        plain = [b for b in blocks if b.doubt < doubted and b.linked <= LINKS_OK * len(b.text) and not all(x.search(b.text) for x in CONSENT)]
        if any(b.tag not in HEADINGS for b in plain):
            for b in plain:
                b.label = "good"
            break
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars per row; a map without a shuffle, in Arrow batches. Other columns aren't read."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    slim = pages.selectExpr(f"CAST(`{id_col}` AS string) AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    out = slim.mapInPandas(run, f"page_id string, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kinds[id_col]))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
