"""Main text of web pages by scores on the tree of elements.

Paragraphs, and texts directly in a block, pass points for their length and commas to the elements above
them; an element's points are discounted by the share of its text that lies in links. The best element, and what stands around it without
being mostly links, are kept, without the parts that are never content.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from custlytics.llm.common import map_batches

# Elements that are never content, whose markup is not parsed, that have no end tag, and that hold text
# of their own as a block.
DROPPED = frozenset("head script style noscript template iframe object svg math nav footer aside form button select textarea input dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
#: Elements whose text is scored.
SCORED = frozenset("p pre blockquote td li dd".split())
#: Blocks that only name or mark something: text directly in any other block is scored too, up to the next block or br.
_MARKS = frozenset("address caption dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr legend option summary th".split())
RUNS = BLOCKS - SCORED - _MARKS | {"#root"}
#: An opening tag of the key ends open elements of these names, up to one that holds the key's kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select".split())
_ENDED = frozenset().union(*_CLOSES.values())

# Roles of parts that are not content. Names (classes and ids) are read word by word: a name tells such a part if one of
# these words stands in it, only words of _LEADS before it and only words of _PARTS after it. So ``site-nav`` and
# ``comment-list`` do, but not states of a wrapper (``has-sidebar``, ``nav-fixed``) or subjects (``cookie-recipe``).
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
_NAMES = re.compile(
    r"ads?|adsbygoogle|advert(?:s|isements?|ising)?|sponsor(?:s|ed|ship)?|promo(?:s|tions?)?|banners?|cookies?(?:bar|banner|notice|consent)?"
    r"|consent|gdpr|notices?|popups?|modal|overlay|sidebars?|side(?:nav|menu)|nav(?:bar|igation|menu|links|list)?|menus?|breadcrumbs?"
    r"|footers?|masthead|(?:site|page)header|comments?(?:list|form|area|section|box|thread|wrapper|body)?|disqus|repl(?:y|ies)|respond"
    r"|shares?|share(?:bar|box|buttons?|links|this)|sharing|social|related|recommend(?:ed|ations?)?|newsletter|subscribe|subscription"
    r"|signup|login|widgets?|toolbar|pagination|pager"
)
_LEADS = frozenset(
    "article block blog bottom button c col column desktop dfp email entry facebook fb fixed floating global google header js l latest left "
    "main mobile module more page popular post posts primary privacy reader recent region right secondary section single site "
    "sticky story sub tag the top twitter user wp your".split()
)
_PARTS = frozenset(
    "area articles bar block body bottom box btn button buttons card code col column container content count div element foot form group "
    "head header holder icon icons inner item items label left link links list lists message messages module news outer panel "
    "parent part placeholder posts products reading region right row section sections slot space stories tab tabs text "
    "this thread title toggle top topics trail ul unit wrap wrapper zone".split()
)
#: Their ids name what they say, for links to them.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup p".split())
#: Texts shorter than this are no prose; parts left out by name come back with most of a page's prose.
PROSE_CHARS = 25

_TAG = re.compile(r"""<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)(>)?)""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Points for a paragraph, for each comma, and for each so many characters (to a limit that only bounds
#: one paragraph's points, not its text).
BASE_POINTS, COMMA_POINTS, CHARS_PER_POINT, MOST_LENGTH_POINTS = 1.0, 1.0, 100, 3.0
#: A paragraph below this length gives no points.
LEAST_CHARS = 25
#: What stands beside an article or main is kept from this share of the best score on, and at least these points.
SIBLING_SHARE, SIBLING_POINTS = 0.2, 10.0


class Element:
    """``block`` is the nearest block that is open here, ``opened`` the outermost open element of each name of
    ``_CLOSES`` since the nearest holder: with them no tag has to walk up, however deep the elements lie."""

    __slots__ = (
        "tag", "parent", "children", "dropped", "named", "points", "chars", "link_chars", "commas", "depth", "holds_block", "holds_main",
        "in_main", "block", "opened",
    )

    def __init__(self, tag: str, parent: Element | None, dropped: bool = False, named: bool = False):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped or named, named
        self.children: list[Element | str] = []
        self.points, self.chars, self.link_chars, self.commas = 0.0, 0, 0, 0
        self.holds_block, self.holds_main = tag in BLOCKS, tag in MAIN
        self.depth = parent.depth + 1 if parent else 0
        self.in_main = parent is not None and (parent.in_main or parent.tag in MAIN)
        self.block: Element | None = self if tag in BLOCKS or parent is None else parent.block
        if parent is None or tag in _HOLDERS or tag in MAIN:
            self.opened: dict[str, Element] = {}
        else:
            self.opened = parent.opened | {tag: self} if tag in _ENDED and tag not in parent.opened else parent.opened

    def ancestors(self) -> Iterator[Element]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


def _names_boilerplate(name: str) -> bool:
    """Whether a class or an id names a part that is not content."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    told = [bool(_NAMES.fullmatch(w)) for w in words]
    for k, is_name in enumerate(told):
        if is_name and all(t or w in _LEADS for w, t in zip(words[:k], told)) and all(t or w in _PARTS for w, t in zip(words[k + 1 :], told[k + 1 :])):
            return True
    return words in (["site", "header"], ["page", "header"], ["side", "bar"])


def _boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is never content, and whether it only is left out by its name."""
    if tag == "form":
        return False, True
    if tag in DROPPED:
        return True, False
    named = False
    if not attributes.strip() or tag in ("body", "html", "main"):
        return False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if tag != "article" and (name == "hidden" or name == "aria-hidden" and value.lower() == "true"):
            return True, False
        if name == "role" and tag != "article":
            named = named or value.lower() in _ROLES
        elif name == "class" or name == "id" and tag not in _HEADINGS:
            named = named or any(map(_names_boilerplate, value.split()))
    return False, named


def _restore(root: Element) -> None:
    """Takes back what is left out by its name alone but is what the page is about: a part with half of the page's
    prose or more that holds a main, an h1 or an article (or is a form, as some sites put whole pages into one), or, on a
    page without any of these, a part without which there is no prose."""
    elements, todo = [], [root]
    while todo:
        e = todo.pop()
        if not e.dropped or e.named:
            elements.append(e)
            todo += [c for c in e.children if isinstance(c, Element)]
    if not any(e.named for e in elements):
        return
    prose, holds = {}, {}
    for e in reversed(elements):
        below = [c for c in e.children if isinstance(c, Element) and c in prose]
        own = 0 if e.tag == "a" else sum(n for c in e.children if isinstance(c, str) and (n := len(c.strip())) >= PROSE_CHARS)
        prose[e] = own + (0 if e.tag == "a" else sum(prose[c] for c in below))
        holds[e] = e.tag in ("main", "h1") or e.tag == "article" and not e.named or any(holds[c] for c in below)
    for e in elements:
        if e.named and prose[e]:
            most = 2 * prose[e] >= prose[root] and (holds[e] or e.tag == "form")
            e.dropped = not (most or prose[e] == prose[root] and not holds[root])


def parse(page: str) -> Element:
    """The page's elements and texts. Unknown, unclosed and wrongly nested tags are taken as they come, at any
    depth: each element is left once, and an end tag looks upwards only if its element is open."""
    root = here = Element("#root", None)
    at, low, still_open = 0, None, Counter()
    while m := _TAG.search(page, at):
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        if m.group(3) is None:  # comment, declaration or instruction
            mark = "-->" if m.group(1) is None else ">"
            end = page.find(mark, at)
            at = len(page) if end < 0 else end + len(mark)
            continue
        tag = m.group(3).lower()
        if m.group(5) is None:  # the tag has no end before the next one
            end = re.compile("[<>]").search(page, at)
            at = len(page) if end is None else end.end() if end.group() == ">" else end.start()
        if m.group(2):
            if still_open[tag]:
                to = here
                while to.tag != tag:
                    to = to.parent
                here = _leave(here, to, still_open)
            continue
        if tag in BLOCKS and here.block.tag == "p":  # a block ends a paragraph, but not one outside the block it stands in
            here = _leave(here, here.block, still_open)
        if tag in _CLOSES and (ended := [here.opened[t] for t in _CLOSES[tag] if t in here.opened]):
            here = _leave(here, min(ended, key=lambda e: e.depth), still_open)
        element = Element(tag, here, *_boilerplate(tag, m.group(4)))
        here.children.append(element)
        if tag in RAW:
            low = low if low is not None else page.lower() if len(page.lower()) == len(page) else _ascii_lower(page)
            end = low.find("</" + tag, at)
            element.children.append(page[at : len(page) if end < 0 else end])
            element.dropped, element.named = True, False
            at = len(page) if end < 0 else end
        elif tag not in VOID and not m.group(4).rstrip().endswith("/"):
            here = element
            still_open[tag] += 1
    if at < len(page):
        here.children.append(page[at:])
    _restore(root)
    return root


def _ascii_lower(page: str) -> str:
    return page.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def _leave(here: Element, last: Element, still_open: Counter[str]) -> Element:
    """The place after the end of ``last`` and of all open elements in it."""
    while here is not last:
        still_open[here.tag] -= 1
        here = here.parent
    still_open[last.tag] -= 1
    return last.parent


def _kept(element: Element) -> Iterator[Element]:
    """The element and those below it that may be content, each before its children."""
    todo = [element]
    while todo:
        at = todo.pop()
        if not at.dropped and not _page_header(at):
            yield at
            todo += [c for c in reversed(at.children) if isinstance(c, Element)]


def _page_header(element: Element) -> bool:
    return element.tag == "header" and not element.in_main


def _score(root: Element) -> list[Element]:
    elements = list(_kept(root))
    for e in reversed(elements):
        for child in e.children:
            if isinstance(child, str):
                e.chars += len(child.strip())
                e.commas += child.count(",")
            elif not child.dropped and not _page_header(child):
                e.chars += child.chars
                e.commas += child.commas
                e.link_chars += child.link_chars
                e.holds_block = e.holds_block or child.holds_block
                e.holds_main = e.holds_main or child.holds_main
        if e.tag == "a":
            e.link_chars = e.chars
    for e in elements:
        if e.tag in SCORED and e.chars >= LEAST_CHARS:
            _pass_points(e.chars, e.commas if e.tag != "li" else 0, e.ancestors())
    for holder, chars, commas in _runs(root):
        _pass_points(chars, commas, (holder, *islice(holder.ancestors(), 2)))
    return elements


def _pass_points(chars: int, commas: int, above: Iterable[Element]) -> None:
    points = BASE_POINTS + COMMA_POINTS * commas + min(chars / CHARS_PER_POINT, MOST_LENGTH_POINTS)
    for share, e in zip((1.0, 0.5, 1 / 3), above):
        e.points += points * share


def _runs(root: Element) -> Iterator[tuple[Element, int, int]]:
    """(block, characters, commas) of the texts that stand directly in a block of ``RUNS``, each up to the
    next block or br. What lies in links does not count, and a text that is mostly links is none."""
    chars = link_chars = commas = 0
    todo: list = [(root, root, False)]  # (element, text or None at the end of a block; the block around; in a link)
    while todo:
        at, block, linked = todo.pop()
        if isinstance(at, str):
            n = len(at.strip())
            chars, link_chars, commas = chars + n, link_chars + n * linked, commas + at.count(",") * (not linked)
            continue
        inner = at is not None and at.tag in BLOCKS
        if at is None or inner or at.tag == "br":
            if block.tag in RUNS and chars - link_chars >= LEAST_CHARS and link_chars * 2 < chars:
                yield block, chars - link_chars, commas
            chars = link_chars = commas = 0
        if at is not None and not at.dropped and not _page_header(at):
            if inner or at is root:
                todo.append((None, at, False))
            todo += [(c, at if inner else block, linked or at.tag == "a") for c in reversed(at.children)]


def _density(element: Element) -> float:
    return element.link_chars / element.chars if element.chars else 0.0


def _worth(element: Element) -> float:
    return element.points * (1 - _density(element))


def best_parts(root: Element) -> list[Element]:
    """The page without what does not belong to the container with the best score.

    The container is taken whole, as is an ``article`` or ``main`` around it. Around the container only what
    is mostly links goes; around the outermost article or main, all but others of these and what scores well
    enough. If nothing scores, the largest article, else the body, else the whole page."""
    elements = _score(root)
    holders = [e for e in elements if e.tag not in SCORED or e.tag in ("td", "blockquote", "li")]
    best = max(holders, key=_worth, default=root)
    if best.points <= 0:
        named = [e for e in elements if e.tag in MAIN] or [e for e in elements if e.tag == "body"]
        return [max(named, key=lambda e: e.chars) if named else root]
    around = [e for e in (best, *best.ancestors()) if e.tag in MAIN]
    best = around[0] if around else best
    least = max(SIBLING_POINTS, SIBLING_SHARE * _worth(best))
    at, outside = best, False
    while at.parent is not None:
        outside = outside or bool(around) and at is around[-1]
        if outside:
            at.parent.children = [e for e in at.parent.children if e is at or isinstance(e, Element) and _beside_main(e, least)]
        else:
            _leave_links_out(at.parent, at, headings=at is best)
        at = at.parent
    return [root]


def _beside_main(element: Element, least: float) -> bool:
    return _density(element) < 0.5 and (_worth(element) >= least or element.holds_main)


def _leave_links_out(element: Element, inner: Element, headings: bool) -> None:
    """Takes from ``element`` the blocks, and the texts between them, that are mostly links, but not from
    ``inner``. A block that is mostly links loses only those of its parts that are; with ``headings``, the
    first ones of ``element`` itself stay in any case."""
    todo = [element]
    while todo:
        at = todo.pop()
        kept: list[Element | str] = []
        run: list[Element | str] = []
        for e in (*at.children, None):
            if isinstance(e, str) or e is not None and e is not inner and e.tag != "br" and not e.holds_block:
                run.append(e)
                continue
            chars = sum(len(x.strip()) if isinstance(x, str) else x.chars for x in run)
            if sum(x.link_chars for x in run if isinstance(x, Element)) * 2 <= chars - (chars > 0):
                kept += run
            run = []
            if e is None:
                break
            if e is inner or _density(e) < 0.5 or headings and at is element and e.tag in ("h1", "h2"):
                kept.append(e)
            elif e.tag != "a":
                kept.append(e)
                todo.append(e)
        at.children = kept


def blocks(parts: list[Element]) -> Iterator[str]:
    """Texts of the blocks in page order, white space as one space."""
    inline: list[str] = []

    def flush() -> Iterator[str]:
        text = " ".join(html.unescape("".join(inline)).split())
        inline.clear()
        if text:
            yield text

    todo: list = list(reversed(parts))
    while todo:
        at = todo.pop()
        if at is None:  # the end of a block
            yield from flush()
        elif isinstance(at, str):
            inline.append(at)
        elif at.tag == "br":
            inline.append(" ")
        elif not at.dropped and not _page_header(at):
            block = at.tag in BLOCKS
            if block:
                yield from flush()
                todo.append(None)
            todo += reversed(at.children)
    yield from flush()


def main_text(page: str | None) -> str:
    return "\n".join(blocks(best_parts(parse(page)))) if page else ""


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"
_PA_EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    The text is that of the best container and of what stands around it without being mostly links: blocks in
    page order joined by newlines, white space inside a block as one space, character references decoded. Around
    the outermost article or main, only others of these and what scores well is kept. Elements for navigation, notices, adverts, forms,
    scripts, sidebars, comments and the like are left out by their names, roles and classes, unless they
    hold what the page is about.

    No shuffle; one page at a time. A null or empty page, or one without content, gives an empty text;
    broken markup is read as far as it goes; null or repeated ids are rows like any other; an empty table
    gives no rows; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [main_text(page) for page in rows.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=_PA_EXTRACTED,
            )

    return map_batches(pages.select("page_id", "url", "html"), run, EXTRACTED)
