"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element, in page order; what can't be text (scripts, styles, controls) makes no
lines. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments go as far as elements or words of
their class, id or role say so, but such a word is evidence only: an element that holds the page's article stays, and so does
one with more text than all that would be left, unless text surges there too (one called comments or nav goes as long as
there is an article beside it).

Over the lines that are left slides a window of ``WINDOW`` lines whose scores are summed. Text starts where the sum surges
above a threshold measured on the page, ends where it dives below, and all between is kept, short lines and links too. A
line's score is its number of characters outside of links. If the page marks an article, that is evidence in the scores:
lines inside get ``ENOUGH`` more, and those outside none. But first the windows decide whether to believe it: if one surge of
unmarked text beside the articles is more than twice as long as they are, they are teasers, and the evidence is turned round.

Edge cases: null and empty pages give an empty text; pages cut off in a tag, a reference or an open element are read as
far as they go; references are decoded once, after the markup is gone; a page of links only has no text, unless an article
is marked; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

WINDOW = 3
#: Text has surged where a window holds this share of the characters of the page's largest window, or that many.
SURGE, ENOUGH = 0.05, 80
#: Marked articles are teasers if one surge of unmarked text beside them has more than so many times their text.
TEASER = 2
#: A marked element with so many times the text beside it is no furniture, even if that surges.
WRAPPED = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "head", "menu", "select", "button", "svg", "iframe", "object", "audio", "video", "canvas", "input", "textarea", "title", "option", "datalist"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "dialog", "fieldset"}
# Words of class, id and role that mark page furniture.
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adsbygoogle", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "aside", "complementary", "rail", "widget", "footer", "contentinfo", "header", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "disclaimer", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "searchbox", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion", "pagination", "pager", "copyright", "legal", "skip", "outbrain", "taboola"}
#: Of these, and of the elements, those that are never an article's own wrapper if there is text beside them.
CERTAIN = {"nav", "footer", "aside", "navbar", "navigation", "sidebar", "contentinfo", "cookie", "cookies", "gdpr", "comment", "comments", "commentlist", "disqus", "respond", "replies"}
#: Words in front of a mark that say something of what is around it, as in has-sidebar.
ABOUT = {"has", "have", "no", "not", "with", "without", "is", "hide", "show", "above", "below", "after", "before"}
MAIN = {"article", "main"}


def _mark(name: str, attributes: str) -> str:
    """The word that makes an element furniture, or nothing; hidden, if it isn't shown."""
    found = name if name in FURNITURE else ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "hidden"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hidden"
        if key in ("class", "id", "role", "itemprop"):
            for token in references.unescape(value).split():
                words = [w for w in _SPLIT.split(_CAMEL.sub("-", token).lower()) if w]
                if words and words[0] not in ABOUT:
                    found = next((w for w in (words[0], words[-1]) if w in MARKS and (found not in CERTAIN or w in CERTAIN)), found)
    return found


class Line:
    """A block's text, its characters inside links, whether a marked article holds it, and its innermost mark."""

    __slots__ = ("text", "linked", "article", "mark")

    def __init__(self, text: str, linked: int, article: bool, mark: int):
        self.text, self.linked, self.article, self.mark = text, linked, article, mark


def lines(page: str) -> tuple[list[Line], list[list]]:
    """Non-empty lines in page order, and the marks: [word, the mark around it (-1: none), whether it holds a marked article]."""
    out: list[Line] = []
    marks: list[list] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # element; hidden, mark, article and link around it
    open_: Counter[str] = Counter()
    hidden = article = link = False
    mark = -1
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not hidden:
                out.append(Line(text, linked, article, mark))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = references.unescape(text)
            parts.append(text)
            if link:
                linked += len(text)

    def pop() -> str:
        nonlocal hidden, mark, article, link
        name, *around = stack.pop()
        open_[name] -= 1
        if around[:3] != [hidden, mark, article]:
            flush()
        hidden, mark, article, link = around
        return name

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if open_[name]:
                while pop() != name:
                    pass
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if stack and stack[-1][0] == name and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            pop()
        word = "" if name in ("html", "body") else _mark(name, m[3])
        if word == "header" == name and article:  # the header of an article holds its headline
            word = ""
        if word or name in HIDDEN or name in MAIN and not article:
            flush()
        stack.append((name, hidden, mark, article, link))
        open_[name] += 1
        hidden |= word == "hidden" or name in HIDDEN
        if name in MAIN and not hidden:
            article, k = True, mark
            while k >= 0 and not marks[k][2]:
                marks[k][2], k = True, marks[k][1]
        if word and word != "hidden":
            marks.append([word, mark, False])
            mark = len(marks) - 1
        link |= name == "a"
    flush()
    return out, marks


def unmarked(got: list[Line], marks: list[list]) -> list[Line]:
    """The lines without those of marked elements, as far as the marks hold."""
    size = [0] * len(marks)
    total = sum(len(x.text) for x in got)
    for x in got:
        if x.mark >= 0:
            size[x.mark] += len(x.text)
    begin, end = [len(got)] * len(marks), [0] * len(marks)  # a mark's lines follow one another
    for i, x in enumerate(got):
        if x.mark >= 0:
            begin[x.mark], end[x.mark] = min(begin[x.mark], i), i + 1
    for k in range(len(marks) - 1, -1, -1):  # a mark comes after the one around it
        around = marks[k][1]
        if around >= 0:
            size[around] += size[k]
            begin[around], end[around] = min(begin[around], begin[k]), max(end[around], end[k])
    # Text beside a large mark, that is in no other mark or only in larger ones: its best windows and totals, before and after each line.
    clear = [max(0, len(x.text) - x.linked) if x.mark < 0 or 2 * size[x.mark] > total else 0 for x in got]
    before, after = _best_windows(clear), _best_windows(clear[::-1])
    so_far = [0, *accumulate(clear)]
    gone: list[bool] = []
    for k, (word, around, holds) in enumerate(marks):
        rest = total - size[k]
        wrapper = holds or (rest == 0 if word in CERTAIN else size[k] > rest)
        if wrapper and not holds and word not in CERTAIN:
            beside = so_far[begin[k]] + so_far[-1] - so_far[end[k]]
            wrapper = max(before[begin[k]], after[len(got) - end[k]]) < ENOUGH or WRAPPED * beside < size[k]
        gone.append(around >= 0 and gone[around] or not wrapper)
    return [x for x in got if x.mark < 0 or not gone[x.mark]]


def _best_windows(lengths: list[int]) -> list[int]:
    """The largest window sum among the first n lines, for n from 0."""
    best, now = [0], 0
    for i, x in enumerate(lengths):
        now += x - (lengths[i - WINDOW] if i >= WINDOW else 0)
        best.append(max(best[-1], now))
    return best


def spans(lengths: list[int], threshold: float) -> list[tuple[int, int]]:
    """[surge, dive) line ranges: runs of lines that windows above the threshold cover, from their first to their last line that counts."""
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(max(1, n - WINDOW + 1))]
    found, i = [], 0
    while i < len(sums):
        if sums[i] < threshold:
            i += 1
            continue
        j = i  # surge
        while j < len(sums) and sums[j] >= threshold:
            j += 1
        covered = [k for k in range(i, min(n, j - 1 + WINDOW)) if lengths[k] > 0]  # dive: after the last window
        if found and covered[0] < found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], covered[-1] + 1))
        else:
            found.append((covered[0], covered[-1] + 1))
        i = j
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    got, marks = lines(page)
    inside = unmarked([x for x in got if x.article], marks)
    outside = unmarked([x for x in got if not x.article], [[word, around, False] for word, around, _ in marks])
    believed = bool(inside)
    if inside:
        plain = [max(0, len(x.text) - x.linked) if x.mark < 0 else 0 for x in got if not x.article]
        surge = max((sum(plain[i:j]) for i, j in spans(plain, threshold_of(plain))), default=0)
        believed = surge <= max(ENOUGH, TEASER * sum(len(x.text) for x in inside))
    got = inside if believed else outside
    lengths = [max(0, len(x.text) - x.linked) + (ENOUGH if believed else 0) for x in got]
    return "\n".join(got[k].text for i, j in spans(lengths, threshold_of(lengths)) for k in range(i, j))


def threshold_of(lengths: list[int]) -> float:
    """Window sum from which text has surged, measured on the page."""
    largest = max([sum(lengths[i : i + WINDOW]) for i in range(len(lengths))], default=0)
    return max(1.0, min(SURGE * largest, ENOUGH))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text``, the main text of the whole of ``html``; a column of that name is replaced, and ``html`` goes."""
    keep = [c for c in pages.columns if c not in (html, text)]
    renamed = pages.select(F.col(f"`{html}`").alias("html"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields[1:])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([main_text(x) for x in batch.column(0).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([made, *batch.columns[1:]], names=["made", *batch.schema.names[1:]])

    out = map_slices(renamed, fn, f"made string, {types}" if types else "made string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("made").alias(text))
