"""Main text of web pages by line-block distribution.

The markup is stripped into lines: each piece of text between block-level tags is a line. Where a container begins or ends (``div``,
``section``, ``article``, a cell and the like) stand as many empty lines as the window has; a list, table or quotation begins and ends with
one. An element that is never article text is one empty line: scripts, styles, forms, menus, page headers and footers,
sidebars and dialogs by their element or role, and what its class or id calls an advert, notice, comment or the like.

The length of a line counts its text less that of its links, twice. Sums over a sliding window of lines make the distribution. Text
dives where a window has nothing, and surges where one reaches the bar, a fifth of the highest sum (80 to 200 characters). The lines from
dive to dive with a surge among them are a run; short lines between two runs that are close stay, and so do links there. Menus,
adverts, footers and short comments between the containers have no surge, whatever they are called. Of the runs joined so, the
heaviest is the text, and any others of a quarter of its weight; a heading right before goes with it. A page without a
surge keeps the heaviest lines from dive to dive.

Null or empty html gives empty text. A tag cut off at the end of the page is dropped. An element that is never closed
is dropped only up to the next block-level tag. Character references are decoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2
#: The bar of a surge: a share of the highest window, within these bounds.
SHARE, SURGE, MOST = 0.2, 80, 200
#: Lines of text between two runs that stay, and the weight of another text against the main one.
GAP, OTHER = 8, 0.25

# Names of HTML elements, by what they do to the text.
RAW = "script style noscript template textarea iframe svg math object canvas audio video title".split()
NEVER = "head nav footer aside form button select dialog menu header".split()
BLOCK = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
ROLES = "navigation banner contentinfo complementary search form alert dialog menu menubar".split()
WORDS = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup "
    "promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
).split()
BOXES = (
    "area areas bar block body bottom box button buttons col column container content feed form group header heading icons inner item items left link links "
    "list main module panel posts right row section slot space thread title top unit widget wrap wrapper zone"
).split()
CONTAINERS = "article aside body center dd details dialog div dt fieldset footer form header hr main nav section td th".split()
GROUPS = "blockquote dl figure menu ol pre table ul".split()
HEADINGS = "h1 h2 h3".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NEVER, _BLOCK, _VOID, _ROLES, _WORDS, _BOXES, _HEADINGS = map(frozenset, (NEVER, BLOCK, VOID, ROLES, WORDS, BOXES, HEADINGS))
_EMPTY = {**dict.fromkeys(GROUPS, 1), **dict.fromkeys(CONTAINERS, 0)}
_ARTICLE = frozenset(("article", "main"))


def telling(name: str) -> bool:
    """Does a class or id say that it is no article text? Its last word does, or its first does and the last is only a box."""
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    return bool(parts) and (parts[-1] in _WORDS or parts[0] in _WORDS and parts[-1] in _BOXES)


def _aside(name: str, attrs: str, inside: bool) -> bool:
    """Is this element never article text? A header inside an article belongs to it."""
    if name in _NEVER:
        return not (name == "header" and inside)
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, value in _ATTR.findall(attrs):
        names = value.strip("\"'").split()
        if any(n.lower() in _ROLES for n in names) if key.lower() == "role" else any(map(telling, names)):
            return True
    return False


@dataclass(frozen=True)
class Line:
    """Text between block-level tags, the length of its link text, and whether it is a heading. Empty: a boundary or a dropped element."""

    text: str = ""
    link: int = 0
    heading: bool = False

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - 2 * self.link)


def lines(html: str, window: int = WINDOW) -> list[Line]:
    tokens = []
    for m in _TOKEN.finditer(html):
        tokens.append((m.start(), m.end(), m[2] == "/", (m[3] or "").lower(), m[4] or ""))
    closed: dict[int, int] = {}  # start tag to its end tag, for elements that may be dropped
    open_at: dict[str, list[int]] = {}
    for k, (_, _, end, name, attrs) in enumerate(tokens):
        if not name or name in _VOID or attrs.endswith("/"):
            continue
        if not end:
            open_at.setdefault(name, []).append(k)
        elif open_at.get(name):
            closed[open_at[name].pop()] = k
    out: list[Line] = []
    buf: list[str] = []
    link = depth = at = k = 0
    in_link = heading = False
    none = Line()

    def flush() -> None:
        nonlocal link
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            if text:
                out.append(Line(text, min(link, len(text)), heading))
            buf.clear()
        link = 0

    def empty(n: int) -> None:
        while any(x.text for x in out[-n:]):
            out.append(none)

    while k < len(tokens):
        start, stop, end, name, attrs = tokens[k]
        if start > at:
            buf.append(html[at:start])
            link += (start - at) * in_link
        at, k = stop, k + 1
        if name in _BLOCK:
            flush()
            heading = name in _HEADINGS and not end
        elif name == "br":
            buf.append(" ")
        elif name == "a":
            in_link = not end
        aside = not end and bool(name) and name not in _VOID and _aside(name, attrs, depth > 0)
        if aside:
            flush()
            empty(1)
            last = closed.get(k - 1)
            if last is None:  # never closed
                last = next((j for j in range(k, len(tokens)) if tokens[j][3] in _BLOCK), len(tokens)) - 1
                at = tokens[last + 1][0] if last + 1 < len(tokens) else len(html)
            else:
                at = tokens[last][1]
            k, in_link, heading = last + 1, False, False
            continue
        if name in _ARTICLE:
            depth = max(0, depth + (-1 if end else 1))
        if name in _EMPTY and not (name == "header" and depth):
            empty(_EMPTY[name] or window)
    if at < len(html):
        buf.append(html[at:])
    flush()
    return out


def segments(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Lines ``[i, j)`` from dive to dive: they begin and end with a length, and no ``window`` of them in a row have none."""
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(lengths).tolist():
        if found and i - found[-1][1] < window:
            found[-1] = (found[-1][0], i + 1)
        else:
            found.append((i, i + 1))
    return found


def spans(page: list[Line], window: int = WINDOW, share: float = SHARE, surge: int = SURGE, most: int = MOST) -> list[tuple[int, int]]:
    """The lines ``[i, j)`` that are the text."""
    lengths = np.array([x.plain for x in page], np.int64)
    n = len(lengths)
    parts = segments(lengths, window)
    if not parts:
        return []
    total = np.concatenate([[0], np.cumsum(lengths)])
    block = total[np.minimum(np.arange(n) + window, n)] - total[:-1]
    top = int(block.max())
    weigh = lambda i, j: int(total[j] - total[i])
    if top < surge:
        runs = [max(parts, key=lambda r: (weigh(*r), -r[0]))]
    else:
        bar = min(max(surge, share * top), most)
        runs = [(i, j) for i, j in parts if block[i:j].max() >= bar]
    joined = [runs[0]]
    for i, j in runs[1:]:
        if sum(bool(x.text) for x in page[joined[-1][1] : i]) <= GAP:
            joined[-1] = (joined[-1][0], j)
        else:
            joined.append((i, j))
    heaviest = max(weigh(*r) for r in joined)
    kept = []
    for i, j in joined:
        if weigh(i, j) >= OTHER * heaviest:
            before = max((k for k in range(i) if page[k].text), default=-1)
            lead = before >= (kept[-1][1] if kept else 0) and page[before].heading and i - before <= 2 * window + 1 and not page[before].link
            kept.append((before if lead else i, j))
    return kept


def main_text(html: str | None, window: int = WINDOW, share: float = SHARE, surge: int = SURGE, most: int = MOST) -> str:
    page = lines(html, window) if html else []
    return "\n\n".join(page[k].text for i, j in spans(page, window, share, surge, most) for k in range(i, j) if page[k].text)


def extract(pages: DataFrame, html_col: str = "html", window: int = WINDOW, share: float = SHARE, surge: int = SURGE, most: int = MOST) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; a narrow step without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), window, share, surge, most) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
