"""Main text of web pages by line-block distribution.

1. Markup is stripped: comments, scripts, styles and elements that by name,
   role, class or id are menus, headers, footers, sidebars, notices, adverts,
   forms or reader comments go; block elements end a line; references are
   decoded and white space in a line becomes one space.
2. Every line counts by its length, less link text where links are half of it
   or more; a page's own headline (h1) counts ``LEAST`` at the least. If the page marks
   an article and that holds at least half of this text, the mark is a weight: links
   inside count in full, lines outside count a quarter. A smaller one (a teaser card,
   a comment) is text like any other.
3. Lengths are summed over sliding windows of ``LINES`` lines, which do not reach
   over the border of a marked article. The text surges where a window's sum leaves zero
   and dives where it is back at zero; inside a marked article it surges once and dives
   once, lines without weight between stay. Stretches between surge and dive are kept if
   their highest window reaches ``LEAST``, or the page's highest if that is less.

A page is parsed by one task in one pass, linear in its length; there is no
shuffle.

Defined cases: null html is empty; pages without text give the empty string;
an element that is never closed ends with the body (a dropped one also where an
article begins; one that is closed goes whole, articles in it included); ids and urls are passed on as they are, nulls and repeats
included; an empty table gives an empty table; further columns are left alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, load

LINES, LEAST = 3, 80
#: a line outside a marked article counts its length divided by this
OUTSIDE = 4

# Names of HTML elements by what they are.
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
search section summary table tbody tfoot thead tr ul""".split())
_DROPPED = frozenset("nav footer aside form button select dialog menu head object iframe audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MARKED = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
# Words that name something beside the article where a class or id is one, begins or ends with one ...
_WORDS = r"""(?:ads?|advert(?:s|isement|isements|ising)?|sponsor(?:ed|s)?|promo(?:s|tion)?|banner
|cookies?|consent|gdpr|notices?|popup|modal|overlay|alert|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|aside
|footer|header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing
|social|newsletter|subscribe|signup|login|search|widget|pagination|pager|skip)"""
_BESIDE = re.compile(rf"{_WORDS}(?:[_-].*)?|.*[_-]{_WORDS}", re.I | re.X | re.S)
# ... unless it says what a wrapper has, what an article is filed under, or names the article's own head.
_WITHIN = re.compile(r"""(?:.*[_-])?(?:has|no|with|without)[_-].*|(?:category|tag|type|status|format)-.*
|(?:entry|article|post)[_-](?:header|masthead).*""", re.I | re.X | re.S)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
|<(?P<raw>script|style|noscript|template|textarea|title|svg|math)\b[^>]*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)
|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>
|<[!?/][^>]*>""", re.I | re.S | re.X)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def _beside(tag: str, rest: str, in_article: bool) -> bool:
    """Whether an element is something beside the article."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if not rest or tag in ("body", "html", "main"):
        return False
    for m in _NAMED.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and any(_BESIDE.fullmatch(v) and not _WITHIN.fullmatch(v) for v in value.split()):
            return True
    return False


def _ends(tokens: list[re.Match]) -> tuple[dict[int, int], dict[str, int]]:
    """The token that ends each element, by the token that begins it; the first element left open of each name.

    A paragraph also ends where a block begins or ends, an item at the next one of its list and with the list,
    a list with the block around it.
    """
    found: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    items: list[list[int]] = [[]]  # the open items of each open list
    lists: list[int] = [-1]
    for k, m in enumerate(tokens):
        if m["tag"] is None:
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        if tag in _BLOCKS and (tag != "p" or not end):
            for p in begun.pop("p", ()):
                found[p] = k
        if tag in ("ul", "ol", "menu"):
            if not end:
                items.append([]), lists.append(k)
            elif len(items) > 1:
                lists.pop()
                for i in items.pop():
                    found[i] = k
        own = items[-1] if tag == "li" else begun.setdefault(tag, [])
        if end:
            if own:
                first = own.pop()
                found[first] = k
                while tag in _BLOCKS and tag != "p" and lists[-1] > first:
                    lists.pop()
                    for i in items.pop():
                        found[i] = k
        elif tag not in _VOID and not m["rest"].endswith("/"):
            if tag == "li" and own:
                found[own.pop()] = k
            own.append(k)
    return found, {tag: those[0] for tag, those in begun.items() if those}


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """The page's lines: (text, characters of links in it, inside an article, a headline)."""
    out: list[tuple[str, int, bool, bool]] = []
    runs: list[str] = []
    linked: list[str] = []
    marked, links, headline = 0, 0, False
    drop, stop, closed = "", None, False  # the element that is being dropped, the token that ends it
    at = 0
    tokens = [*_TOKEN.finditer(page)]
    ends, left_open = _ends(tokens)

    def close() -> None:
        text = " ".join("".join(runs).split())
        if text:
            out.append((text, len(" ".join("".join(linked).split())), marked > 0, headline))
        runs.clear(), linked.clear()

    def say(text: str) -> None:
        if text and not drop:
            text = html.unescape(text) if "&" in text else text
            runs.append(text)
            if links:
                linked.append(text)

    for k, m in enumerate(tokens):
        say(page[at:m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, end, rest = m["tag"].lower(), bool(m["end"]), m["rest"]
        if drop:
            # Only what is never closed, or by an end tag that may be another's, ends where an article begins.
            over = k == stop or end and tag == "body" or not end and (
                not closed and tag in _MARKED and drop not in _MARKED
                or stop is None and drop == "li" and tag in _BLOCKS)
            if not over:
                continue
            own, drop, stop = end and tag == drop, "", None
            if own:
                continue
        if tag in _BLOCKS or tag == "body":
            close()
            headline = tag == "h1" and not end
        elif tag in ("br", "td", "th"):
            say(" ")
        if not end and tag not in _VOID and not rest.endswith("/") and _beside(tag, rest, marked > 0):
            drop, stop = tag, ends.get(k)
            closed = stop is not None and left_open.get(tag, k) >= k
        elif tag in _MARKED:
            marked = max(0, marked + (-1 if end else 1))
        elif tag == "a":
            links = 0 if end else 1
    say(page[at:])
    close()
    return out


def _stretches(size: list[int], joined: bool) -> list[tuple[int, int, int]]:
    """(first, end, highest window) of the lines between each surge and dive, ``joined`` to one."""
    total = [0]
    for n in size:
        total.append(total[-1] + n)
    block = [total[min(i + LINES, len(size))] - total[i] for i in range(len(size))]
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(block):
        surge = i
        while i < len(block) and block[i] > 0:
            i += 1
        if i > surge:
            # Windows reach over what is before the stretch; lines within it stay, links or not.
            full = [k for k in range(surge, i) if size[k] > 0]
            out.append((full[0], full[-1] + 1, max(block[surge:i])))
        i += 1
    if joined and out:
        out = [(out[0][0], out[-1][1], max(high for _, _, high in out))]
    return out


def main_text(page: str) -> str:
    """The main text: its lines joined by blank lines."""
    lines = lines_of(page)
    size = [0 if 2 * link >= len(t) else len(t) - link for t, link, _, _ in lines]
    within = sum(n for n, (_, _, inside, _) in zip(size, lines) if inside)
    marked = any(inside for _, _, inside, _ in lines) and 2 * within >= sum(size)
    size = [max(n, LEAST) if n and head else n for n, (_, _, _, head) in zip(size, lines)]
    if marked:
        size = [max(n, len(t)) if inside else n // OUTSIDE for n, (t, _, inside, _) in zip(size, lines)]
    found: list[tuple[int, int, int]] = []
    low = 0
    for high in range(1, len(lines) + 1):
        if high == len(lines) or marked and lines[high][2] != lines[low][2]:
            inside = marked and lines[low][2]
            found += [(low + a, low + b, top) for a, b, top in _stretches(size[low:high], inside)]
            low = high
    least = min(LEAST, max((top for _, _, top in found), default=0))
    return "\n\n".join(lines[k][0] for a, b, top in found if top >= least for k in range(a, b))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        yield pa.record_batch([*batch.columns[:-1], pa.array(text, pa.string()),
                               pa.array([len(t) for t in text], pa.int64())],
                              names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(col(pages, "page_id").cast("long").alias("page_id"), col(pages, "url").cast("string").alias("url"),
                        F.coalesce(col(pages, "html"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the main text of every page."""
    return extract(load(spark, sf_dir, "pages"))
