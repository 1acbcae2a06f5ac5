"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block elements.  The first pass labels each block by the
element it stands in, its length, its share of linked characters and its density of stop
words; short blocks and those of middling density stay open.  In the second pass the open
ones take the label of the nearest decided blocks, those of the same container first.
Where a page marks its article or main part, blocks outside it count only if they hold
most of the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import arrays

#: Characters below which a block stays open, and from which dense prose is decided.
SHORT, LONG = 70, 200
#: Shares of stop words from which a block may be, and surely is, prose.
SOME, DENSE = 0.15, 0.30
MOST_LINKED = 0.2
MOST_LINKED_INSIDE = 0.5

# Frequent function words, by language.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from in is it not of on or that the this to was with
    au aux avec dans de des du elle en est et il la le les ne pas par pour que qui sur un une
    als auch auf das dem den der die ein eine für im ist mit nicht sich sie und von zu
    al como con del el las lo los más no para por se su una y
    che di e gli i non per sono
    com da do não o os uma
    een en het van voor zijn
    """.split()
)
# Elements of HTML by how they are treated.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset(
    "article aside blockquote body details div dl fieldset figure footer form header html main menu nav ol "
    "section table td th ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BOILERPLATE = frozenset(
    "aside audio button canvas datalist dialog footer form head header menu nav noscript object select svg "
    "template video".split()
)
CLOSED_BY = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("tr", "td", "th"), "option": ("option",),
}
# Words in class, id or role that name something other than the article.
NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary
    contentinfo comment comments consent cookie cookies copyright dialog disqus footer form gdpr header login
    masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup
    promo promotion related reply replies search share sharing sidebar signup social sponsor sponsored
    subscribe toolbar widget
    """.split()
)
COMMENTS = frozenset("comment comments reply replies".split())
NEGATED = frozenset("has no with without".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\bhidden(?![-\w=])", re.I)
NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
WORD = re.compile(r"\w+")
HEADING = re.compile(r"h[1-6]")
GOOD, BAD, SHORTISH, NEAR = "good", "bad", "short", "near"


@dataclass
class Block:
    """A block of text: where it stands, and what the first pass measures."""

    text: str
    linked: int
    container: int
    region: int  # 2 in an article, 1 in the main part, 0 elsewhere
    heading: bool
    dropped: bool  # in an element that is not of the article
    doubtful: bool  # dropped only because an element around its article is left open or so named
    label: str = ""


@dataclass
class Open:
    """An element that is open, and what holds for the text in it."""

    name: str
    region: int = 0
    container: int = 0
    linked: bool = False
    heading: bool = False
    dropped: bool = False
    surely: bool = False  # dropped by more than a name around the article
    edge: bool = False  # an inline element where dropping begins
    scope: dict[str, int] = field(default_factory=dict)  # where its open p, li, ... stand
    inside: Counter = field(default_factory=Counter)  # elements open in this scope
    around: Counter = field(default_factory=Counter)  # and in the one that holds it


def named(name: str, attributes: str) -> bool:
    """Whether class, id or role say that an element is not of the article."""
    for found in ATTRIBUTE.finditer(attributes):
        key = (found[1] or "hidden").lower()
        value = found[2] or found[3] or found[4] or ""
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "style" or name in ("html", "body", "main"):
            continue
        words = [w.lower() for w in NAME.findall(value)]
        wanted = COMMENTS if name == "article" else NAMES
        if any(w in wanted and (i == 0 or words[i - 1] not in NEGATED) for i, w in enumerate(words)):
            return True
    return False


def opened(name: str, attributes: str, stack: list[Open], container: int) -> Open:
    """What holds inside a new element."""
    top = stack[-1]
    region = max(top.region, {"article": 2, "main": 1}.get(name, 0))
    heading = bool(HEADING.fullmatch(name)) or top.heading and name not in SCOPES
    dropped, surely = top.dropped, top.surely
    if heading and top.name == "header" and top.region and not stack[-2].dropped:
        dropped = surely = False  # the title of the article
    by_name = bool(attributes) and named(name, attributes)
    if name in BOILERPLATE or by_name:
        surely = surely or name in BOILERPLATE or region > 0
        dropped = True
    edge = dropped and not top.dropped and name not in BLOCKS
    return Open(
        name, region, container, top.linked or name == "a", heading, dropped, surely, edge,
        *(({}, Counter()) if name in SCOPES else (top.scope, top.inside)), top.inside,
    )


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order; tags that do not nest are closed as browsers do."""
    out: list[Block] = []
    stack, open_names, containers = [Open("")], Counter(), 0
    text: list[str] = []
    linked = 0

    def add(run: str) -> None:
        nonlocal linked
        run = html.unescape(run)
        text.append(run)
        if stack[-1].linked:
            linked += len(run.strip())

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            top = stack[-1]
            doubtful = top.dropped and top.region == 2 and not top.surely
            out.append(Block(whole, linked, top.container, top.region, top.heading, top.dropped, doubtful))
        text.clear()
        linked = 0

    def close(to: int) -> None:
        if any(e.edge for e in stack[to:]):
            flush()
        while len(stack) > to:
            gone = stack.pop()
            open_names[gone.name] -= 1
            gone.around[gone.name] -= 1

    at, end = 0, len(page)
    while at < end:
        tag = TAG.search(page, at)
        add(page[at : tag.start() if tag else end])
        if tag is None:
            break
        at = tag.end()
        slash, name, attributes = tag.group(1, 2, 3) if tag[2] else tag.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if slash:
            # an inline end closes nothing beyond the block that it stands in
            if (open_names if name in BLOCKS else stack[-1].inside)[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in BLOCKS:
            for other in ("p", *CLOSED_BY.get(name, ())):
                k = stack[-1].scope.get(other)
                if k is not None and k < len(stack) and stack[k].name == other:
                    close(k)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        containers += name in SCOPES
        new = opened(name, attributes, stack, containers if name in SCOPES else stack[-1].container)
        if new.edge:
            flush()
        stack.append(new)
        open_names[name] += 1
        new.around[name] += 1
        if name == "p" or name in CLOSED_BY:
            new.scope[name] = len(stack) - 1
    flush()
    if not any(b.region == 2 and not b.dropped for b in out):
        for b in out:
            b.dropped = b.dropped and not b.doubtful
    return out


def first_pass(b: Block) -> str:
    """The label that a block earns by itself."""
    if b.dropped:
        return BAD
    size = len(b.text)
    words = WORD.findall(b.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
    linked = b.linked / size
    if b.region == 2:  # marked as article: only lists of links are turned away
        if linked > MOST_LINKED_INSIDE and not b.heading and (size < SHORT or stops < SOME):
            return BAD
        return GOOD if stops >= SOME and size >= SHORT else NEAR
    if linked > MOST_LINKED and not b.heading or "\N{COPYRIGHT SIGN}" in b.text:
        return BAD
    if size < SHORT:
        return NEAR if b.heading else SHORTISH
    if stops >= DENSE and size >= LONG:
        return GOOD
    return NEAR if stops >= SOME else BAD


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided ones before and after them; where
    these differ, of the one in their own container, else by how near they were to good."""
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: Block | None = None
        inside: dict[int, Block] = {}
        seen: list[tuple[Block | None, Block | None]] = [(None, None)] * len(found)
        for i in order:
            b = found[i]
            seen[i] = last, inside.get(b.container)
            if b.label in (GOOD, BAD):
                last = b
                if not b.dropped:
                    inside[b.container] = b
        sides.append(seen)
    final = []
    for i, b in enumerate(found):
        if b.label in (GOOD, BAD):
            final.append(b.label)
            continue
        own = {s[i][1].label for s in sides if s[i][1]}
        near = own or {
            s[i][0].label for s in sides if s[i][0] and (b.region < 2 or s[i][0].region == 2 and not s[i][0].dropped)
        }
        if len(near) == 1:
            final.append(near.pop())
        elif not near:  # nothing is decided: the article's own mark decides
            final.append(GOOD if b.region else BAD)
        else:
            final.append(GOOD if b.label == NEAR else BAD)
    for b, label in zip(found, final, strict=True):
        b.label = label


def extract(page: str) -> str:
    """The main text of one page."""
    found = blocks(page)
    for b in found:
        b.label = first_pass(b)
    second_pass(found)
    good = [b for b in found if b.label == GOOD]
    total = sum(len(b.text) for b in good)
    for region in (2, 1, 0):
        kept = [b for b in good if b.region >= region]
        if 2 * sum(len(b.text) for b in kept) >= total:
            break
    return " ".join(b.text for b in kept)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per input row: the article of the page, its blocks in
    page order joined by one space, white space inside a block as one space, character
    references decoded; empty where there is none.

    Reads ``page_id``, ``url`` and ``html`` alone, so other columns may have any name.  A
    null html counts as empty; null and repeated page_ids give a row each; an empty table
    gives an empty result.  Whole pages are read where they are stored, without a shuffle;
    one page is handled by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "html"):
            texts = [extract(x or "") for x in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
