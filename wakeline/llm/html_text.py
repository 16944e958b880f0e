"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.batches import slices, texts_of

# Rules of the first pass. A block scores points for and against being text; 0 is undecided.
LINK_DENSITY = 0.5  # more of its characters in links: LINKS
STOP_DENSITY = 0.2  # so many stop words, and at least ...
LONG = 60  # ... so many characters: 1
RUNNING = 200  # ... so many characters: 2
LINKS = -4
RIGHTS = -3  # starts with a copyright sign
# Further evidence: what the page says of the elements around the block.
IN_MAIN, OUTSIDE_MAIN = 3, -3  # in an article; not in one although the page has one
LEFT_OUT_ELEMENT = -4  # navigation, footers, forms, comments, what is hidden
HINTED, HALF_HINTED = -2, -1  # all words of a class are hints; some are
TITLE = 2  # a heading of the first level
ASIDE_OF_TEXT = -1  # not below the element that directly holds most of the text

# The commonest function words of four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on as with was be by at this are from or an not which have has had
    der die das und in zu den von mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    le la les de des du et en un une que qui dans pour par sur au aux est pas plus se ne ce il elle avec son sa
    el los las y del que en una por con para se su lo al es no como más pero sus ha o este""".split()
)

# Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())  # their content is no markup
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video map datalist".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td
    tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BY_HEADER = "header"  # left out, as in an article's header, but for headings
# A start tag of the first closes an open element of the second, within the third.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"}),
}
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notification alert popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation
    breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments disqus reply replies respond
    share sharing social related recommended recommendations trending widget login search copyright disclaimer paywall""".split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
WORD = re.compile(r"[^\W\d_]+")
NAME_PART = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    left_out: bool  # by the elements around it
    hint: int  # HINTED, HALF_HINTED or 0, by class words between the block and its article
    main: bool  # in an article or main element
    title: bool  # in a heading of the first level
    holder: int  # number of the element that holds its paragraph


def _hidden_or_hinted(tag: str, attributes: str) -> tuple[bool, int]:
    """What an element's attributes say against it: left out for certain, and points by its class words."""
    if not attributes or tag in ("html", "body"):
        return False, 0
    hint = 0
    for name, *values, bare in ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True, 0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0
        if name in ("class", "id"):
            for one in value.split():
                parts = set(NAME_PART.findall(one))
                if parts & COMMENTS:
                    return True, 0
                if tag not in MAIN and parts & HINTS:
                    hint = min(hint, HINTED if parts <= HINTS else HALF_HINTED)
    return False, hint


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The page's runs of text between block elements, in page order, white space as one space; and each holder's parent."""
    out: list[Block] = []
    parents = [0]
    # Open elements: name, left out, hint, inside main, inside a title, holder, inside a link.
    stack: list[tuple[str, bool | str, int, bool, bool, int, bool]] = [("", False, 0, False, False, 0, False)]
    parts: list[str] = []
    linked, at = 0, 0
    open_now: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                _, left_out, hint, main, title, holder, _ = stack[-1]
                out.append(Block(text, linked, bool(left_out), hint, main, title, holder))
            parts.clear()
        linked = 0

    def add(run: str) -> None:
        nonlocal linked
        if run:
            parts.append(run)
            if stack[-1][-1]:
                linked += len("".join(html.unescape(run).split()))

    def close(to: int) -> None:
        open_now.subtract(e[0] for e in stack[to:])
        del stack[to:]

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:  # a comment or declaration
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            if open_now[tag] > 0:
                found = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                if tag not in BLOCKS and any(e[0] in BLOCKS for e in stack[found:]):
                    continue  # an inline element does not close blocks
                close(found)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCKS:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in BLOCKS:
            flush()
            # An open paragraph ends here, and with it inline elements left open.
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in BLOCKS), 0)
            if found and stack[found][0] == "p":
                close(found)
        if tag in CLOSED_BY:
            closed, within = CLOSED_BY[tag]
            first = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in closed:
                    first = i
            if first:
                close(first)
        _, left_out, hint, main, title, holder, link = stack[-1]
        if tag in MAIN:
            main, hint = True, 0
        if left_out is BY_HEADER and tag in HEADINGS:
            left_out = False
        own, points = _hidden_or_hinted(tag, m[3])
        hint = min(hint, points)
        left_out = True if own or tag in LEFT_OUT else left_out or (tag == "header" and (BY_HEADER if main else True))
        if tag in BLOCKS and tag not in HEADINGS and tag != "p":
            parents.append(holder)
            holder = len(parents) - 1
        if not m[3].endswith("/") or tag in BLOCKS or tag == "a":
            stack.append((tag, left_out, hint, main, title or tag == "h1", holder, link or tag == "a"))
            open_now[tag] += 1
    add(page[at:])
    flush()
    return out, parents


def _by_rules(b: Block) -> int:
    """Points by link density, length and stop words."""
    if b.linked > LINK_DENSITY * len(b.text.replace(" ", "")):
        return LINKS
    if b.text.startswith(("\u00a9", "(c) ")):
        return RIGHTS
    if len(b.text) < LONG:
        return 0
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    return 0 if stops < STOP_DENSITY * len(words) else 2 if len(b.text) >= RUNNING else 1


def _by_elements(b: Block, has_main: bool, below_text: bool) -> int:
    """Points by the elements around the block."""
    if b.left_out:
        return LEFT_OUT_ELEMENT
    points = b.hint + (TITLE if b.title and b.hint else 0) + (0 if below_text or b.main else ASIDE_OF_TEXT)
    if has_main and not b.main:
        return points + OUTSIDE_MAIN
    return points + (IN_MAIN if b.main and b.hint != HINTED else 0)


def _first_pass(found: list[Block], parents: list[int]) -> list[bool | None]:
    """Text, boilerplate, or undecided, for each block."""
    has_main = any(b.main and not b.left_out for b in found)
    rules = [_by_rules(b) for b in found]
    held: Counter[int] = Counter()
    for b, points in zip(found, rules):
        if points > 0 and not b.left_out:
            held[b.holder] += len(b.text)
    most = max(held, key=lambda h: (held[h], -h), default=0)
    below = [h == most for h in range(len(parents))]
    for h in range(1, len(parents)):  # parents come before their children
        below[h] = below[h] or below[parents[h]]
    points = [r + _by_elements(b, has_main, below[b.holder]) for b, r in zip(found, rules)]
    # A title or short block beside the text has no sign against it but its place.
    return [None if x == 0 or x == ASIDE_OF_TEXT and r == 0 and not b.hint else x > 0 for b, r, x in zip(found, rules, points)]


def _inherited(labels: list[bool | None], default: bool) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one; text wins a tie."""
    n = len(labels)
    near: list[tuple[int, bool] | None] = [None] * n
    for order in (range(n), range(n - 1, -1, -1)):
        last = None
        for i in order:
            if labels[i] is not None:
                last = i
            elif last is not None:
                found = (abs(i - last), not labels[last])
                if near[i] is None or found < near[i]:
                    near[i] = found
    return [near[i] is not None and not near[i][1] or near[i] is None and default if x is None else x for i, x in enumerate(labels)]


def main_text(page: str) -> str:
    """The page's text blocks, two line ends between them.

    First pass: link density, length and density of stop words give points, and
    the elements around a block further ones; a block with points left on one
    side is decided. Second pass: the others (short, without stop words, or with
    signs both ways) take the label of the nearest decided block, whichever it
    is; text wins a tie. A page without any decided block is text. Class words
    alone take no long block of running text out, except those of comments.
    """
    found, parents = blocks(page)
    kept = _inherited(_first_pass(found, parents), default=True)
    return "\n\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page has an empty text. Every row gives one row, repeated
    ones and those without page_id or url too; further columns are ignored, and
    an empty table gives an empty one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(p) for p in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
