"""Main text of web pages by two passes over blocks.

Markup that never holds an article (menus, headers, footers, asides, forms, scripts, what
is hidden) is passed over by element and role. The first pass decides each remaining
block by link density, length and the density of stop-words, and leaves ambiguous ones
open. A class or id that speaks of an advert, a sidebar, a notice or reader comments is
evidence against its container, weighed after that pass: a container that holds the
better part of the page's prose under an ambiguous name, or all of the page's text, stays.
The second pass gives open blocks the label of the nearest decided neighbours of their
article, in one sweep from either side.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import ship

STOP = frozenset(
    "a an and are as at be by for from has have he his in is it its not of on or that the their they this to was were which with you "
    "au aux avec ce dans de des du en est et il la le les leur mais ne ou par pas pour que qui sa se son sur un une "
    "al como con del el ella es fue ha las lo los más no para pero por su sus y "
    "auf aus bei das dem den der die durch ein eine einem einen einer für ich im ist mit nach nicht noch sich sie sind und vom von war wie zu zum zur".split()
)
_QUOTED = r"""(?:"[^"<>]*"|'[^'<>]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^<>"'])*"""
#: Comments, elements whose text is none, tags (with balanced quotes, else up to the first bracket), declarations, a tag cut off, text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|title|iframe|svg|math|textarea|select|object|canvas|audio|video)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_QUOTED})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>|<(?=[a-zA-Z/!?])[^<>]*\Z|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DROP = frozenset("nav header footer aside form button dialog menu head fieldset label input applet embed frameset notice".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDS = _BLOCK - frozenset("hr p h1 h2 h3 h4 h5 h6".split()) | {"head", "button", "label"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of containers, by how surely they hold no main text.
_COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[_-])", re.I)
_SURE = re.compile(r"(?:^|[_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|sidebar|side-bar|menus?|nav\w*|breadcrumbs?|newsletter|footer|masthead|topbar|pagination|outbrain|taboola)(?:$|[_-])", re.I)
_MAYBE = re.compile(r"(?:^|[_-])(?:banner|promo\w*|notices?|alert|share|sharing|social|related|recommend\w*|subscribe|subscription|popup|modal|overlay|widgets?|pager|login|signup|search|toolbar|skip|teaser)(?:$|[_-])", re.I)
#: A name that says what a page has or lacks, and one that says main text.
_STATE = re.compile(r"(?:has|no|not|with|without|hide|hides|show|shows)[_-]", re.I)
_CONTENT = re.compile(r"(?:^|[_-])(?:content|article|post|entry|story|main|body|page|text)(?:$|[_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form note".split())
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")


def _judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """(True if the element never holds main text, what its names say: comments, sure, maybe or nothing)."""
    if tag in _DROP and not (tag == "header" and in_article):
        return True, ""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, ""
    names: list[str] = []
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            names += [x for x in value.split() if not _STATE.match(x)]
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
    if any(map(_COMMENTS.search, names)):
        return False, "comments"
    if any(map(_SURE.search, names)):
        return False, "maybe" if any(map(_CONTENT.search, names)) else "sure"
    return False, "maybe" if any(map(_MAYBE.search, names)) else ""


class _Block:
    __slots__ = ("parts", "linked", "article", "heading", "hint", "label", "text")

    def __init__(self, article: int, heading: bool, hint: int):
        self.parts, self.linked, self.article, self.heading, self.hint, self.label, self.text = [], 0, article, heading, hint, None, ""


def blocks(page: str) -> tuple[list[_Block], list[tuple[int, str]]]:
    """The blocks of a page outside dropped markup, in page order, and its hinted containers.

    article: number of the article a block stands in, or 0; hint: number of the innermost
    hinted container, or 0. Containers are (number of the one around it, kind) from 1 on.
    """
    out: list[_Block] = []
    hints: list[tuple[int, str]] = [(0, "")]
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # open containers: tag, dropped here or above, article, hint
    opened: Counter = Counter()
    now, links, articles, heading, breaks = None, 0, 0, False, 0

    def enter(tag: str, attributes: str, dropped: bool, article: int) -> None:
        drop, kind = _judged(tag, attributes, bool(article))
        hint = stack[-1][3]
        if kind and not drop:
            hints.append((hint, kind))
            hint = len(hints) - 1
        stack.append((tag, dropped or drop, article, hint))
        opened[tag] += 1

    for m in _TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            token = m[0]
            if m[1] or token[0] == "<" and len(token) > 1:
                continue
            if stack[-1][1]:
                continue
            if now is None:
                now = _Block(stack[-1][2], heading, stack[-1][3])
                out.append(now)
            now.parts.append(token)
            if links:
                now.linked += len(token.strip())
            if token.strip():
                breaks = 0
            continue
        tag, closing, attributes = tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "br":
            breaks += 1
            if now is not None:
                now.parts.append(" ")
                if breaks > 1:
                    now = None
            continue
        if tag == "a":
            links = 0 if closing else 1
        _, dropped, article, hint = stack[-1]
        if tag in _BLOCK or tag in _HOLDS:
            now, breaks = None, 0
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag != "hr"
            if tag not in _HOLDS or tag in _VOID:
                continue
            links = 0
            if closing:
                while opened[tag]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                continue
            if tag == "body":
                dropped = False
                if opened["head"]:
                    stack[1:] = [x for x in stack[1:] if x[0] != "head"]
                    opened["head"] = 0
            if tag in ("article", "main") and not dropped:
                articles += 1
                article = article or articles
            enter(tag, attributes, dropped, article)
        elif not closing and tag not in _VOID and tag not in ("a", "b", "i", "em", "strong", "span", "u", "font", "small", "code"):
            drop, kind = _judged(tag, attributes, False)
            if drop or kind:
                now = None
                enter(tag, attributes, dropped, article)
        elif closing and len(stack) > 1 and stack[-1][0] == tag:
            stack.pop()
            opened[tag] -= 1
            now = None
    for b in out:
        b.text = _SPACES.sub(" ", _html.unescape("".join(b.parts))).strip()
    return [b for b in out if b.text], hints


def _first_pass(found: list[_Block]) -> None:
    """Label by link density, length and stop-word density; None where these leave it open."""
    seen = []
    for b in found:
        words = _WORDS.findall(b.text.lower())
        stop = sum(w in STOP for w in words) / len(words) if words else 0.0
        seen.append((len(b.text), words, stop, not b.text.isascii() and 2 * sum(c > "\u036f" for c in b.text if c.isalpha()) > sum(map(str.isalpha, b.text))))
    known = any(n >= 70 and stop >= 0.1 for n, _, stop, _ in seen)  # the page's language has listed stop-words
    for b, (n, words, stop, other_script) in zip(found, seen):
        if min(b.linked, n) / n > 0.33:
            b.label = False
        elif not words:
            b.label = None
        elif n >= 200 and stop >= 0.1 or n >= 70 and stop >= 0.2:
            b.label = True
        elif other_script or not known:  # stop-words say nothing: length alone
            b.label = True if n >= (60 if other_script else 140) else None
        elif n >= 140 and stop < 0.02 and not b.article:
            b.label = False


def _weigh(found: list[_Block], hints: list[tuple[int, str]]) -> list[_Block]:
    """The blocks outside hinted containers that hold no main text."""
    prose, text = [0] * len(hints), [0] * len(hints)  # characters in each container; 0 is the page
    for b in found:
        if b.label is not False:
            text[b.hint] += len(b.text)
            prose[b.hint] += len(b.text) * bool(b.label)
    for k in range(len(hints) - 1, 0, -1):  # a container comes after the one around it
        text[hints[k][0]] += text[k]
        prose[hints[k][0]] += prose[k]
    gone = [False] * len(hints)
    for k in range(1, len(hints)):
        around, kind = hints[k]
        most = 2 * prose[k] > prose[0] if prose[0] else 2 * text[k] > text[0]
        gone[k] = gone[around] or not (text[k] == text[0] or kind == "maybe" and most)
    return [b for b in found if not gone[b.hint]]


def _sweep(found: list[_Block], step: int) -> list[tuple[int, bool] | None]:
    """For each block the (place, label) of the nearest decided block before it in this direction: of its article if it has one."""
    out, last = [None] * len(found), {}
    for k in range(len(found))[::step]:
        b = found[k]
        out[k] = last.get(b.article)
        if b.label is not None:
            last[0] = (k, b.label)
            if b.article:
                last[b.article] = (k, b.label)
    return out


def classify(found: list[_Block], hints: list[tuple[int, str]]) -> list[_Block]:
    """Both passes; the blocks of the main text."""
    _first_pass(found)
    found = _weigh(found, hints)
    any_article = any(b.article for b in found)
    labels = []
    for k, (b, left, right) in enumerate(zip(found, _sweep(found, 1), _sweep(found, -1))):
        if b.label is not None:
            label = b.label
        elif left is None and right is None:
            label = bool(b.article) or not any_article
        elif left is None or right is None or left[1] == right[1]:
            label = (left or right)[1]
        elif b.heading:
            label = right[1]
        elif k - left[0] != right[0] - k:
            label = (left if k - left[0] < right[0] - k else right)[1]
        else:
            label = bool(b.article)
        labels.append(label)
    return [b for b, label in zip(found, labels) if label]


def main_text(page: str | None) -> str:
    """The main text; blocks are joined by an empty line."""
    return "\n\n".join(b.text for b in classify(*blocks(page or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; n_chars counts code points.

    A null or empty page, or one without main text, has an empty text. Rows are
    independent: no shuffle. Repeated rows and null ids pass through; an empty table
    gives an empty result; other columns are not read.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                text = [main_text(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
