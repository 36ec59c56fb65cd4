"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass labels each block on its own
by the density of stop words, its length and its link density: good, near-good, short or
bad.  In the second pass short and near-good blocks take the label of the nearest decided
neighbours.

The place of a block is known beforehand and comes before or after that: what is inside
navigation, headers, footers, sidebars, adverts, forms, notices or reader comments is bad,
and no neighbour to others; what is in an element whose class only suggests boilerplate is
good by its own density or else left to its neighbours (inside the article) or bad
(elsewhere).  Where a page names its article, only blocks inside it are the article's, and
they have no neighbours outside.  Ambiguous blocks without any decided neighbour are good.
Scripts, styles, templates, comments and the head are never text.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, extended, free_name

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>?)", re.S)
#: Elements whose content is no text, block elements, elements without an end.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas math audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that mark boilerplate by place.
ASIDE = frozenset("nav header footer aside form menu dialog head select button".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot adbox cookie cookies consent gdpr notice popup modal newsletter sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "masthead share sharing comment comments reply replies respond disqus login signup paywall pagination sponsor sponsored promo promotion subscribe subscription discussion".split()
)
#: Of these words, those that beside another word in one name may be about the text itself.
TOPICS = frozenset("menu discussion promotion".split())
#: Words of class or id that suggest boilerplate, but name parts of articles too.
DOUBTFUL_WORDS = frozenset("banner overlay side crumbs foot topbar toolbar social related recommended pager widget legal disclaimer copyright".split())
#: The only classes that mark an article element as one of the readers'.
READERS = frozenset("comment comments reply replies".split())
ARTICLE = frozenset(("article", "main"))
ATTRS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
WORDS = re.compile(r"[^\W_]+")
#: Frequent function words of four languages.
STOP = frozenset(
    "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them "
    "der die das und ist in den von zu mit sich des auf für als auch dem nicht eine ein im an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber "
    "le la les de des du et un une est en que qui dans pour sur au aux par pas ce il elle plus avec son sa ses se ne sont mais ou nous vous leur cette ont "
    "el los las y del que en un una por con no para es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
LINKS, ALL_LINKS, LONG, STOP_LOW, STOP_HIGH, FEW = 0.33, 0.9, 200, 0.10, 0.20, 70
#: Without a named article, one ambiguous block must have so many words for such blocks to be text on their own.
FRAGMENT = 2
GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"
#: Elements that hold running text, and names of parts of a layout.
TEXTUAL = frozenset("p li td th dd dt pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
LAYOUT = frozenset("main top bottom left right item items list wrapper wrap container box bar block section area primary secondary site page inner outer content link links button icon mobile desktop sub dropdown".split())
#: Places: as any other, doubtful, aside.
ANY, DOUBTFUL, APART = 0, 1, 2


class Block:
    __slots__ = ("parts", "link_chars", "place", "inside", "heading", "listed", "tag", "menu")

    def __init__(self, place: int, inside: bool, heading: bool, tag: str = "", menu: bool = False):
        self.parts, self.link_chars, self.place, self.inside, self.heading = [], 0, place, inside, heading
        self.tag, self.menu, self.listed = tag, menu, False


def _place(name: str, attrs: str) -> int:
    """The place that an element makes by its name or attributes."""
    if name in ASIDE:
        return APART
    place = ANY
    for key, a, b, c in ATTRS.findall(attrs) if attrs else ():
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ASIDE_ROLES):
            return APART
        if key in ("class", "id") and name == "article" and not READERS.isdisjoint(value.split()):
            return APART
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            for one in value.split():
                words = [w for w in re.split(r"[^a-z]+", one) if w]
                hit = ASIDE_WORDS.intersection(words)
                # one name such as menu-recipe says what a text is about, one such as menu-item doesn't
                if hit and not (hit <= TOPICS and any(w not in hit and w not in LAYOUT and len(w) > 2 for w in words)):
                    return APART
                place = place if not hit and DOUBTFUL_WORDS.isdisjoint(words) else DOUBTFUL
    return place


def blocks(page: str):
    """``(text, link density, place, inside an article, heading, element, in an unordered
    list)`` of each block with text."""
    open_: list[tuple[str, int, bool, Block | None]] = []  # name, place, inside, for marked inline elements the block around them
    places: dict[str, list[int]] = {}  # of each name in open_
    block_places: list[int] = []  # of block elements in open_
    place, inside = ANY, False
    links, found = 0, []
    block = Block(ANY, False, False)

    def add(raw: str):
        if raw:
            block.parts.append(raw)
            if links:
                block.link_chars += len(raw.strip())

    def turn(heading=False):
        nonlocal block
        if block.parts and not block.listed:
            found.append(block)
            block.listed = True
        lists = [max(places.get(x) or [-1]) for x in ("ul", "ol")]
        block = Block(place, inside, heading, open_[block_places[-1]][0] if block_places else "", lists[0] > lists[1])

    def push(name: str, around: Block | None = None):
        places.setdefault(name, []).append(len(open_))
        if name in BLOCK:
            block_places.append(len(open_))
        open_.append((name, place, inside, around))

    def cut(i: int):
        """Closes the open elements from the i-th on."""
        nonlocal place, inside
        for name, *_ in open_[i:]:
            places[name].pop()
        while block_places and block_places[-1] >= i:
            block_places.pop()
        del open_[i:]
        _, place, inside, _ = open_[-1] if open_ else ("", ANY, False, None)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name or not m[4]:  # a comment, a declaration, or a tag cut off by the end
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            around, opened = None, places.get(name)
            if opened:
                around = open_[opened[-1]][3]
                cut(opened[-1])
            if name in BLOCK or (name in ASIDE and not around):
                links = links if name not in BLOCK else 0
                turn()
            elif around:  # the text goes on
                turn()
                block = around
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            block.parts.append(" ")
        elif name == "a":
            links += 1
        elif name in BLOCK:
            if name in ("p", "li", "td", "th", "tr", "option", "dd", "dt") and block_places and open_[block_places[-1]][0] == name:
                cut(block_places[-1])
            if name not in VOID and not m[3].endswith("/"):
                place, inside = max(place, _place(name, m[3])), inside or name in ARTICLE
                push(name)
            turn(name in ("h1", "h2", "h3", "h4", "h5", "h6"))
        elif name not in VOID and not m[3].endswith("/"):
            if _place(name, m[3]) == APART:
                around, place = block, APART
                push(name, around)
                turn()
            elif places.get(name):  # its end is not that of a marked one around it
                push(name)
    turn()
    for b in found:
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text:
            yield text, b.link_chars / len(text), b.place, b.inside, b.heading, b.tag, b.menu


def first_pass(text: str, links: float, place: int, inside: bool, heading: bool = False, tag: str = "", menu: bool = False) -> str:
    """The label of a block on its own.  An entry of an unordered list that is nearly
    nothing but links is bad, and so, outside the article, is any block of them, and a long text without
    stop words in an element that isn't for text.  Inside the article, or in such an
    element, these are ambiguous: references, tables, formulas and names are like that too."""
    if place == APART or (links > ALL_LINKS and (menu or not inside)) or (links > LINKS and not inside):
        return BAD
    if not inside and ("©" in text or "&copy" in text):
        return BAD
    if len(text) < FEW or links > LINKS:
        return SHORT if (inside or place == ANY) and (inside or links == 0) else BAD
    words = WORDS.findall(text.lower())
    stop = sum(w in STOP for w in words) / max(1, len(words))
    if stop >= STOP_HIGH and len(text) > LONG:
        return GOOD
    if stop >= STOP_LOW and place == ANY:
        return NEAR
    return SHORT if inside or (place == ANY and links == 0 and tag in TEXTUAL) else BAD


def second_pass(labels: list[str], headings: list[bool] | None = None, prior: bool = False) -> list[bool]:
    """Near-good blocks go with one good neighbour.  Short ones need good on both sides, or
    on the nearer one; a heading goes with what follows if both are as near.  Neighbours are
    the nearest good or bad blocks; a side without any has no say, and where both have none
    the prior decides."""
    n = len(labels)
    before, after = [(None, n)] * n, [(None, n)] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last, far = None, 0
        for i in order:
            far += 1
            side[i] = (last, far)
            if labels[i] in (GOOD, BAD):
                last, far = labels[i], 0
    out = []
    for i, (label, (a, da), (b, db)) in enumerate(zip(labels, before, after)):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
        elif a is None and b is None:
            out.append(prior)
        elif a is None or b is None or a == b:
            out.append((a or b) == GOOD)
        elif label == NEAR:
            out.append(True)
        elif da == db:
            out.append((b if headings and headings[i] else BAD) == GOOD)
        else:
            out.append((a if da < db else b) == GOOD)
    return out


def labelled(page: str) -> list[tuple[str, str, bool]]:
    """``(text, label of the first pass, kept)`` of the blocks that were judged, in order:
    those inside the article, if the page names one and keeps any of them, else all.  What
    is aside by its place says nothing about the blocks beside it, so it is passed over when
    these look for neighbours."""
    found = list(blocks(page))
    for part, named in (([b for b in found if b[3] and b[2] != APART], True), (found, False)):
        labels = [first_pass(*b) for b in part]
        told = [i for i, b in enumerate(part) if b[2] != APART]
        keep = [False] * len(part)
        # a page of loose words alone has no main text
        prior = named or any(labels[i] != BAD and len(WORDS.findall(part[i][0])) >= FRAGMENT for i in told)
        for i, k in zip(told, second_pass([labels[i] for i in told], [part[i][4] for i in told], prior)):
            keep[i] = k
        if any(keep):
            break
    return [(b[0], label, k) for b, label, k in zip(part, labels, keep)]


def main_text(page: str) -> str:
    """The kept blocks in page order, joined by one newline."""
    return "\n".join(text for text, _, kept in labelled(page) if kept)


def extract(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` without ``column``, with the main text of it as ``to`` (empty if there is
    none; a null page is empty).  Rows are independent: repeated rows, null keys and other
    columns pass through, an empty table gives no rows, long pages are read whole."""
    base = [c for c in pages.columns if c not in (column, to)]
    name = free_name("html", base)
    src = pages.select(*[F.col(f"`{c}`") for c in base], F.col(f"`{column}`").cast("string").alias(name))
    schema = extended(src.drop(name).schema, f"`{to}` string")

    def run(batches):
        for batch in batches:
            for first, texts in batches_of_texts(batch.column(len(base))):
                got = [main_text(t.decode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:-1]), pa.array(got, pa.string())], names=[*base, to])

    return src.mapInArrow(run, schema)
