"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; each block knows its length, how
much of it is link text, how many of its words are stop words, the containers
that it lies in and the kind of region it stands in. Pass one decides blocks
whose figures are clear: blocks that are mostly links are dropped, in an article
only where they follow one another as a list; long blocks with a running text's
share of stop words are kept, long ones without stop words outside articles
dropped. What stands in a menu, form, comment list or the like is dropped
whatever its words: no figure tells a reader's comment from the article.

Pass two lets the short and mixed blocks inherit from the nearest decided
neighbours: in an article those of the article, elsewhere those of the innermost
container that has any, at last those of the page, whose ends count as dropped
neighbours. A heading inherits from what follows it. Between two neighbours
equally near one that is kept wins, on the page's level if it has the block's
tag. Tags and regions otherwise decide only what is left: where no block of an article is decided all of it stays, and on
pages without article and without decided text, all that is not dropped stays.
If nothing at all is left, articles inside regions that looked like margins (a
form or a ``with-sidebar`` wrapper round the page) are taken as what they say.

White space inside a block becomes one space, blocks are joined by one newline.

Nulls and odd rows: a null or empty page, or one without text, has the empty
text; markup that ends early is read as far as it goes; long pages are read
whole; rows that repeat, with or without a key, give a row each; an empty table
gives an empty result; columns may have any names, one named as the result is
replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from boardlens.llm.shared import numbered

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in is that for it as with was on be at by this are from or an not have which but were been has"
    " der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " de la le et les un une dans pour que qui sur par pas plus est du au avec ce il sont se ne en"
    " el y los las del una con no su para al lo como más pero sus".split()
)
# How elements behave.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACE_TAGS = frozenset("br td th option".split())
DROP_TAGS = frozenset("script style noscript template svg math iframe object embed applet canvas audio video map textarea select button head title".split())
OUT_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
IN_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond share sharing social related recommended widget login signin signup register search copyright legal disclaimer pagination pager toolbar toc skip".split()
)
IN_NAMES = frozenset("article post entry story".split())
STRONG_ROLES = frozenset(("main", "article"))

#: Pass one: link share above which a block is dropped (in an article one of a list of them), length and stop-word share from which it is kept.
MAX_LINKS, LIST_LINKS, LONG_CHARS, STOP_SHARE, LOW_STOP_SHARE = 0.34, 0.8, 70, 0.22, 0.08
#: Innermost containers whose blocks are asked before the page's.
LEVELS = 4

# Comments, declarations and elements whose content is no markup; an open one runs to the end.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|textarea|title|noscript|iframe|xmp)\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|([^>]*+)(?:>|\Z))""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    region: int  # 0: not known, > 0: the n-th article-like region, -1: outside any text
    heading: bool
    boxes: tuple[int, ...] = ()  # the containers round it, innermost first
    inner: int = 0  # > 0: the n-th article element inside a region outside any text
    tag: str = ""  # the element that began it
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    keep: bool | None = None
    why: str = ""  # what decided it
    text: str = ""

    def close(self) -> None:
        self.text = " ".join("".join(self.parts).split())


def _names(value: str) -> set[str]:
    return {n.lower() for n in _NAME.findall(value)}


def _stance(tag: str, attrs: str, inside: bool) -> int | None:
    """-1 if the element's content is no article text, 1 if it is an article-like region, else None."""
    if tag in OUT_TAGS or (tag == "header" and not inside):
        return -1
    found = {}
    for name, value in _ATTR.findall(attrs):
        found[name.lower()] = value.strip("\"'")
    role = found.get("role", "").lower()
    if role in OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return -1
    if tag in IN_TAGS or role in STRONG_ROLES:
        return 1
    if tag in ("html", "body"):
        return None
    names = _names(found.get("class", "")) | _names(found.get("id", ""))
    if names & OUT_NAMES:
        return -1
    return 1 if names & IN_NAMES and tag in ("div", "section") else None


def cut_blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page, in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements, the region and inner article round them, and their number
    regions = inners = opened = 0
    region, inner, anchors, drop, breaks = 0, 0, 0, "", 0
    block = Block(0, False)

    def around() -> tuple[int, ...]:
        return tuple(e[3] for e in stack[: -LEVELS - 1 : -1] if e[0] not in ("html", "body"))

    def flush(heading: bool = False, tag: str = "") -> None:
        nonlocal block
        block.close()
        if block.text:
            blocks.append(block)
        block = Block(region, heading, around(), inner, tag)

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            block.parts.append(text)
            if anchors:
                block.link_chars += len(" ".join(text.split()))

    page = _RAW.sub("", page)
    at = 0
    for m in _TAG.finditer(page):
        if not drop:
            raw = page[at : m.start()]
            if raw:
                add(raw)
                if not raw.isspace():
                    breaks = 0
        at = m.end()
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3] or m[4] or ""
        if drop:
            if closing and tag == drop or drop == "head" and (tag == "body" or tag in IN_TAGS):
                drop = ""
                if closing:
                    continue
            else:
                continue
        if tag in DROP_TAGS:
            if not closing and tag not in VOID_TAGS:
                drop = tag
            continue
        if tag == "a":
            anchors = 0 if closing else 1
            continue
        if tag in SPACE_TAGS:
            block.parts.append(" ")
            if tag == "br" and not closing:
                breaks += 1
                if breaks >= 2:
                    flush(block.heading)
            continue
        if tag not in BLOCK_TAGS:
            if not closing and tag not in VOID_TAGS:
                stance = _stance(tag, attrs, region > 0) if "=" in attrs else None
                if stance == -1:  # an inline element that is no article text
                    flush(block.heading)
                    opened += 1
                    stack.append((tag, region, inner, opened))
                    region = block.region = -1
            elif closing and stack and stack[-1][0] == tag:
                flush()
                _, region, inner, _ = stack.pop()
                block.region, block.inner = region, inner
            continue
        breaks = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    _, region, inner, _ = stack[i]
                    del stack[i:]
                    anchors = 0
                    block = Block(region, False, around(), inner)
                    break
            else:
                flush()
            continue
        if stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
            flush()
            _, region, inner, _ = stack.pop()
        if tag == "li" and stack and stack[-1][0] == "li":
            flush()
            _, region, inner, _ = stack.pop()
        flush(tag in HEADINGS, tag)
        if tag not in VOID_TAGS:
            opened += 1
            stack.append((tag, region, inner, opened))
            stance = _stance(tag, attrs, region > 0)
            if stance == -1:
                region, inner = -1, 0
            elif stance == 1 and region == 0:
                regions += 1
                region = regions
            elif stance == 1 and region < 0 and not inner and tag in IN_TAGS:
                inners += 1
                inner = inners
            block.region, block.inner = region, inner
    if not drop:
        add(page[at:])
    flush()
    return blocks


def _figures(blocks: list[Block]) -> None:
    """Pass one: ``keep`` and ``why`` of the blocks whose figures are clear."""
    share = [b.link_chars / len(b.text) for b in blocks]
    for i, b in enumerate(blocks):
        if b.region < 0:
            b.keep, b.why = False, "region"
        elif share[i] > MAX_LINKS and (b.region == 0 or share[i] > LIST_LINKS and any(0 <= j < len(blocks) and share[j] > LIST_LINKS and blocks[j].region == b.region for j in (i - 1, i + 1))):
            b.keep, b.why = False, "links"
        elif share[i] <= MAX_LINKS and len(b.text) >= LONG_CHARS:
            words = [w for w in _WORD.findall(b.text.lower())]
            stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
            if stops >= STOP_SHARE:
                b.keep, b.why = True, "prose"
            elif stops < LOW_STOP_SHARE and b.region == 0:
                b.keep, b.why = False, "no prose"


def _nearest(blocks: list[Block], back: bool = False) -> list[dict]:
    """For each undecided block, by group (its article or its containers; None for the page) the last decided block before it (after it, if ``back``)."""
    last: dict = {}
    out: list[dict] = [{}] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1) if back else range(len(blocks)):
        b = blocks[i]
        groups = [("article", b.region)] if b.region > 0 else [*b.boxes, None]
        if b.keep is None:
            out[i] = {g: last[g] for g in groups if g in last}
        else:
            for g in {*groups, *b.boxes, None}:
                last[g] = i
    return out


def _inherit(blocks: list[Block]) -> None:
    """Pass two: ``keep`` of the blocks that pass one left open."""
    articles = any(b.region > 0 for b in blocks)
    decided = any(b.keep for b in blocks)
    before_of, after_of = _nearest(blocks), _nearest(blocks, back=True)
    first = [b.keep for b in blocks]
    for i, b in enumerate(blocks):
        if first[i] is not None:
            continue
        b.why = "inherited"
        groups = [("article", b.region)] if b.region > 0 else [*b.boxes, None]
        found = next((g for g in groups if g is None or g in before_of[i] or g in after_of[i]), "none")
        before, after = before_of[i].get(found), after_of[i].get(found)
        if found == "none" or found is None and not articles and not decided:
            b.keep, b.why = True, "alone"  # an article, or a page without one, of which nothing is decided
            continue
        if found is None:  # the ends of the page are dropped neighbours
            near = [(i - before, before) if before is not None else (i + 1, None), (after - i, after) if after is not None else (len(blocks) - i, None)]
        else:
            near = [(abs(i - j), j) for j in (before, after) if j is not None]
        if b.heading and after is not None:
            b.keep = first[after]
            continue
        least = min(d for d, _ in near)
        votes = [j for d, j in near if d == least]
        kept = [j for j in votes if j is not None and first[j]]
        b.keep = bool(kept) and (found is not None or len(kept) == len(votes) or any(blocks[j].tag == b.tag for j in kept))


def decide(blocks: list[Block]) -> None:
    """Set ``keep`` of every block (both passes)."""
    _figures(blocks)
    _inherit(blocks)
    if not any(b.keep for b in blocks) and any(b.inner for b in blocks):
        for b in blocks:
            b.region, b.keep, b.why = b.inner or -1, None, ""
        _figures(blocks)
        _inherit(blocks)


def main_text(page: str | None) -> str:
    """The page's article, one line per block."""
    blocks = cut_blocks(page or "")
    decide(blocks)
    return "\n".join(b.text for b in blocks if b.keep)


def extract(pages: DataFrame, *, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without its markup, with the main text as ``out`` (empty if none); other columns stay."""
    keep = [c for c in pages.columns if c not in (source, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(batch.column(len(keep))[i].as_py()) for i in range(len(batch))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), texts], names=[*keep, out])

    rows = numbered(pages, keep, F.col(f"`{source}`").cast("string"))
    return rows.mapInArrow(run, StructType([*(pages.schema[c] for c in keep), StructField(out, StringType())]))
