"""Main text of HTML pages by line-block distribution.

Mark-up is stripped to lines, one a block element. Lines that can't be main text (menus, forms,
adverts and the like, by their element, class or id; link lists; what lies outside the article if
the page marks one) weigh nothing. Sums of weights over sliding windows of lines then surge where
text begins and dive where it ends; what stands between a surge and its dive is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import map_batches, slices

# HTML element names and the words in class and id that mark page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
FURNITURE = {"aside", "button", "canvas", "dialog", "footer", "form", "head", "header", "menu", "nav", "object", "select", "svg", "math", "audio", "video", *RAW}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "disclaimer", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "commentlist", "respond",
    "replies", "disqus", "subscribe", "newsletter", "signup", "login", "share", "sharing", "social", "related", "recommended", "trending", "widget", "popup", "modal", "overlay", "toolbar", "pagination", "pager", "copyright",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element of the left that the start of one of the right ends.
ENDS = {"p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

ENDED_BY = {name: [x for x in ENDS if name in ENDS[x]] for name in set().union(*ENDS.values())}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Marks of elements that often hold articles of their own: comments and teasers.
OTHERS = {"comment", "comments", "commentlist", "respond", "replies", "disqus", "related", "recommended", "trending"}
#: Parts of a class or id that make it say a state, a layout or a subject instead of what the element is.
STATES = {"has", "no", "not", "non", "with", "without", "is", "js", "open", "opened", "closed", "active", "enabled", "disabled", "collapsed", "expanded", "visible", "hidden", "free", "layout", "category", "tag", "type", "topic", "subject"}
#: Parts beside which a header is the article's own.
OWN = {"article", "entry", "post", "story", "content", "text", "news"}
#: What an element is: no article, one (a page may have several), or the main body.
NONE, ARTICLE, BODY = range(3)


def _marks(value: str, allowed: set[str]) -> set[str]:
    """The marks of a class or id: whole parts of its tokens, unless another part of the token says a state or a layout.

    So ad-slot, user-comments and comment-list are marks; has-sidebar, nav-open and category-advertising are not, nor
    is post-header.
    """
    found: set[str] = set()
    for token in value.replace("_", "-").split():
        parts = {p for x in token.split("-") if (p := x.rstrip("0123456789"))}
        marks = parts & MARKS
        if marks & allowed and not parts & STATES and not (marks == {"header"} and parts & OWN):
            found |= marks
    return found


def _role(name: str, attributes: str, in_article: bool) -> tuple[bool, set[str], int]:
    """Whether an element is furniture whatever its class, the marks of its class and id, and which article it is."""
    kind = BODY if name == "main" else ARTICLE if name == "article" else NONE
    furniture = name in FURNITURE and not (name == "header" and in_article)
    marks: set[str] = set()
    if attributes and name not in ("html", "body"):
        allowed = MARKS - {"header"} if in_article or name in HEADINGS else MARKS
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                marks |= _marks(value, allowed)
            elif key == "role":
                furniture |= value in ROLES
                kind = max(kind, {"article": ARTICLE, "main": BODY}.get(value, NONE))
            elif key == "itemprop":
                kind = max(kind, BODY if value == "articlebody" else NONE)
            else:
                furniture |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value) is not None
    return furniture, marks, kind


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters of it in links without white space, in an article) of each block in page order, without furniture.

    Between links, what is neither letter nor digit counts as part of them.

    An element that is or holds the article isn't furniture by its class or id. Articles within an
    article, and those under marks of comments and teasers where the page has another, aren't the article.
    """
    holds: dict[int, int] = {}
    lines, again, free = _scan(page, holds, None)
    return _scan(page, holds, free)[0] if again else lines


def _scan(page: str, holds: dict[int, int], free: bool | None) -> tuple[list[tuple[str, int, bool]], bool, bool]:
    """The lines, whether marks fall on what is or holds an article, and whether one is free of comments and teasers.

    holds gets, for each start tag by its place, the articles that the element is or holds, as bits; where
    free is known from an earlier scan, holds is read instead and spares elements.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool, int, bool, bool, int, bool]] = []
    found_free = again = False
    hard, others, nested = 0, 0, 0
    parts: list[str] = []
    linked, between, skip, article, links = 0, 0, 0, 0, 0
    open_now: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked, between
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((text, linked and linked + between, article > 0))
            parts.clear()
        linked = between = 0

    def close(upto: int) -> None:
        nonlocal skip, article, links, hard, others, nested, again
        while len(stack) > upto:
            name, furniture, main, place, is_hard, is_other, kind, marked = stack.pop()
            open_now[name] -= 1
            hard -= is_hard
            others -= is_other
            nested -= kind == ARTICLE
            again |= marked and holds.get(place, 0) > 0
            if name not in INLINE:
                flush()
            skip -= furniture
            article -= main
            links -= name == "a"

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not skip:
            plain = html.unescape(text)
            parts.append(plain)
            if links:
                linked += len("".join(plain.split()))
            elif not any(map(str.isalnum, plain)):
                between += len("".join(plain.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if open_now[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            if any(open_now[x] for x in ENDED_BY.get(name, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if name in ENDS.get(stack[i][0], ()):
                        close(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
            flush()
        attributes = m[3] or m[6] or ""
        if name in VOID or attributes.endswith("/") and name in ("svg", "path", "iframe"):
            continue
        if name in RAW:
            found = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            continue
        is_hard, marks, kind = _role(name, attributes, article > 0)
        is_other = bool(marks & OTHERS)
        if free is None and kind:
            holds[m.start()] = holds.get(m.start(), 0) | 1 << kind
            for x in reversed(stack):
                if holds.get(x[3], 0) & 1 << kind:  # so have all around it
                    break
                holds[x[3]] = holds.get(x[3], 0) | 1 << kind
            found_free |= not (hard or is_hard or others or is_other)
        held = holds.get(m.start(), 0) if free is not None else 0
        spared = bool(held & 1 << BODY) or bool(held) and not nested and not (is_other and free)
        furniture = is_hard or bool(marks) and not spared
        main = kind != NONE
        stack.append((name, furniture, main, m.start(), is_hard, is_other, kind, bool(marks)))
        open_now[name] += 1
        hard += is_hard
        others += is_other
        nested += kind == ARTICLE
        skip += furniture
        article += main
        links += name == "a"
    flush()
    close(0)
    return out, again, found_free


def _weights(lines: list[tuple[str, int, bool]]) -> list[int]:
    """The length of each line that may be main text, else 0.

    Where the page marks an article, its lines alone have weight. Without one, a line of links alone has none, and
    one of which half or more is links has none if that holds of it together with the line before or after it, too.
    """
    if any(inside for _, _, inside in lines):
        return [len(text) if inside else 0 for text, _, inside in lines]
    size = [0, *(len(text.replace(" ", "")) for text, _, _ in lines), 0]
    linked = [0, *(n for _, n, _ in lines), 0]
    out = []
    for i, (text, n, _) in enumerate(lines):
        near = any(2 * sum(linked[j : j + 2]) >= sum(size[j : j + 2]) for j in (i, i + 1))
        out.append(0 if n >= size[i + 1] or 2 * n >= size[i + 1] and near else len(text))
    return out


def main_text(page: str | None, window: int = 3, surge: int = 60) -> str:
    """The main text of one page; blocks joined by a space. Empty for null and where nothing is kept.

    Any line of a marked article is a surge; without one, a surge needs `surge` characters in a window that begins
    with weight. The lines with weight right before a surge are kept with it, however short; a dive is a window of
    weightless lines. A page without a surge keeps every line that has weight.
    """
    lines = lines_of(page or "")
    weight = _weights(lines)
    total = [sum(weight[i : i + window]) for i in range(len(weight))]
    surges = any(w and t >= surge for w, t in zip(weight, total))
    need = surge if surges and not any(inside for _, _, inside in lines) else 1
    kept: list[str] = []
    before: list[str] = []
    inside = False
    for (text, _, _), w, t in zip(lines, weight, total):
        if inside and t == 0:
            inside = False
        if not inside and w and t >= need:
            inside = True
            kept += before
            before = []
        if inside and w:
            kept.append(text)
        elif w:
            before.append(text)
        else:
            before = []
    return " ".join(kept)


def extract(pages: DataFrame, window: int = 3, surge: int = 60) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages; null and empty html have empty text.

    n_chars counts code points. Repeated rows and null ids stay as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20):
            texts = [main_text(x, window, surge) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return map_batches(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
