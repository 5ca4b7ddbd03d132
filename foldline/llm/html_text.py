"""Main text of web pages: flat text blocks judged by a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldline.llm.common import rows

# Elements whose content is never text of the page; those of the second kind end with the page where they are not closed.
SILENT = set("script style noscript template svg math iframe object canvas title textarea select datalist audio video".split())
TO_THE_END = {"script", "style", "title", "textarea"}
DRAWN = {"svg", "math"}  # may close themselves
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>|<[a-z!?/][^>]*\Z",
    re.I | re.S,
)
CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}
BLOCKS = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = BLOCKS - {"p", "hr", "body", "html"} | {"a", "span"}
MAIN_TAGS, APART_TAGS = {"article", "main"}, set("aside button dialog footer form head menu nav".split())
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAMING = {"class", "id", "role", "aria-label"}
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Names that pages give to what stands beside the article, and words that may come before them.
BESIDE = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner sidebar side-bar menu nav navbar "
    "navigation breadcrumb breadcrumbs foot footer masthead site-header header cookie cookies consent notice notices alert gdpr popup modal overlay comment "
    "comments comment-list respond disqus reply replies reactions share sharing social related recommended newsletter subscribe signup login search widget "
    "widgets toolbar pagination pager complementary contentinfo skip skip-link".split()
)
PLACES = set("site page main primary secondary top bottom left right global sticky mobile the my js wp block".split())
OF_ARTICLE = set("article post entry story".split())
OWN_PARTS = set("header footer nav foot notice alert".split())  # after one of OF_ARTICLE these are the article's own
ARTICLE = set("article post entry story content main body-text bodytext article-body post-body entry-content post-content article-content story-body main-content".split())


def _parts(name: str) -> list[str]:
    return [x for x in re.split(r"[-_]+", name) if x]


def is_beside(name: str) -> bool:
    """Whether one whole class, id or role names something beside the article: by itself, by its first part, or after a place."""
    name = name.lower()
    parts = _parts(name)
    if not parts:
        return False
    if name in BESIDE or parts[0] in BESIDE:
        return True
    if parts[0] in OF_ARTICLE and len(parts) == 2:
        return parts[1] in BESIDE - OWN_PARTS
    return parts[0] in PLACES and len(parts) == 2 and parts[1] in BESIDE


def is_article(name: str) -> bool:
    name = name.lower()
    return name in ARTICLE or "-".join(_parts(name)) in ARTICLE


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes and attributes["hidden"].lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true" or bool(NO_DISPLAY.search(attributes.get("style", "")))


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "apart", "main_on_page", "heading")


@dataclass
class Holder:
    """An element that encloses blocks: what its tag, names and attributes say, and what it was found to hold."""

    tag: str
    main: bool
    apart: bool
    named: bool  # apart by its names or as a form, which an element around the article may be
    heading: bool
    words: int = 0
    holds_main: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    holders: list[Holder]

    @property
    def main(self) -> bool:
        return any(h.main for h in self.holders)

    @property
    def apart(self) -> bool:
        return any(h.apart for h in self.holders)

    @property
    def heading(self) -> bool:
        return any(h.heading for h in self.holders)


def _holder(tag: str, attr: str, inside: bool) -> Holder:
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attr)}
    names = [n for k in NAMING for n in found.get(k, "").split()]
    named = tag == "form" or any(map(is_beside, names))
    main = tag in MAIN_TAGS or (not named and any(map(is_article, names)))
    apart = named or tag in APART_TAGS or (tag == "header" and not inside) or is_hidden(found)
    return Holder(tag, main and not named, apart, named and not is_hidden(found) and (tag == "form" or tag not in APART_TAGS), tag in {"h1", "h2", "h3", "h4", "h5", "h6"})


def blocks(page: str) -> list[Block]:
    """Texts between block elements, in page order, with the words inside links and what encloses them.

    An element that is apart by its names, or a form, but holds the ``main``
    element or most of the page's words while none of its article stands
    elsewhere, is a frame around the article and not apart.
    """
    out: list[Block] = []
    holders: list[Holder] = []
    seen: list[Holder] = []
    open_ended: set[str] = set()  # tags of SILENT that are not closed any more
    parts: list[tuple[str, bool]] = []
    links = 0
    at = 0

    def close() -> None:
        if not parts:
            return
        words = html.unescape("".join(t for t, _ in parts)).split()
        if words:
            linked = sum(len(html.unescape(t).split()) for t, inside in parts if inside)
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), list(holders)))
            for h in holders:
                h.words += len(words)
        parts.clear()

    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SILENT:
            if m["close"] or tag in open_ended or (tag in DRAWN and m["attr"].endswith("/")):
                continue
            if end := CLOSING[tag].search(page, at):
                at = end.end()
            elif tag in TO_THE_END:
                at = len(page)
            else:
                open_ended.add(tag)
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in BLOCKS:
            close()
        if tag == "body":
            holders = [h for h in holders if h.tag != "head"]
        if tag not in HOLDERS:
            continue
        if not m["close"]:
            h = _holder(tag, m["attr"], any(h.main for h in holders))
            if tag == "main":
                for outer in holders:
                    outer.holds_main = True
            holders.append(h)
            seen.append(h)
            links += tag == "a"
        else:
            found = next((k for k in range(len(holders) - 1, -1, -1) if holders[k].tag == tag), None)
            if found is not None:
                gone = holders[found:] if tag in BLOCKS else holders[found : found + 1]
                holders = holders[:found] if tag in BLOCKS else holders[:found] + holders[found + 1 :]
                links -= sum(h.tag == "a" for h in gone)
    if at < len(page):
        parts.append((page[at:], links > 0))
    close()
    total = sum(b.words for b in out)
    for h in seen:
        if h.apart and h.named and (h.holds_main or 2 * h.words > total):
            elsewhere = any(b.main and not b.apart and h not in b.holders for b in out) if not h.holds_main else False
            h.apart = elsewhere
    return out


def block_features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; a page's ends count as empty neighbours."""
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / b.words for b in found], float)
    shift = lambda x, d: np.r_[0.0, x[:-1]] if d < 0 else np.r_[x[1:], 0.0]
    flags = np.array([(b.main, b.apart, b.heading) for b in found], float).reshape(-1, 3)
    some = np.full(len(found), float(flags[:, 0].any()) if len(found) else 0.0)
    return np.column_stack([words, links, shift(words, -1), shift(links, -1), shift(words, 1), shift(links, 1), flags[:, 0], flags[:, 1], some, flags[:, 2]])


@dataclass
class Node:
    """Rows with column <= cut go left; a leaf has a label."""

    column: int = -1
    cut: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None
    label: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """CART: the split with the lowest Gini impurity (ties: the first column, the lowest cut), until pure."""
    label = bool(2 * y.sum() >= len(y)) and bool(y.any())
    if depth == 0 or y.all() or not y.any():
        return Node(label=label)
    best = None
    for c in range(x.shape[1]):
        for low, high in zip(v := np.unique(x[:, c]), v[1:]):
            side = x[:, c] <= (low + high) / 2
            if min(side.sum(), (~side).sum()) < least:
                continue
            gini = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (side, ~side))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, c, (low + high) / 2, side)
    if best is None:
        return Node(label=label)
    _, c, cut, side = best
    return Node(c, float(cut), grow(x[side], y[side], depth - 1, least), grow(x[~side], y[~side], depth - 1, least))


def judge(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.left is None or tree.right is None:
        return np.full(len(x), tree.label)
    side = x[:, tree.column] <= tree.cut
    out = np.zeros(len(x), bool)
    out[side], out[~side] = judge(tree.left, x[side]), judge(tree.right, x[~side])
    return out


def _said(n: int) -> str:
    return " ".join(["word"] * n)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: blocks of a few page layouts, marked by hand as article (+) or not (-)."""
    para = lambda n, mark="+": f"<p>{mark} {_said(n)}</p>"
    link = lambda n: f"<li><a href='#'>- {_said(n)}</a></li>"
    menu, foot = f"<nav><ul>{link(1) * 5}</ul></nav>", f"<footer>- {_said(9)} <a href='#'>{_said(2)}</a></footer>"
    notice = f"<div class='cookie-notice'>- {_said(22)} <button>- ok</button></div>"
    side = f"<aside><h3>- more</h3>{para(30, '-')}<ul>{link(5) * 3}</ul></aside>"
    talk = f"<section id='comments'><h2>- two replies</h2>{para(25, '-') * 2}{para(2, '-')}</section>"
    form = f"<form><label>- {_said(2)}</label><input>{para(12, '-')}</form>"
    body = f"<h1>+ {_said(6)}</h1>{para(80)}{para(1)}{para(30)}<h2>+ {_said(2)}</h2>{para(3)}{para(60)}<ul><li>+ {_said(4)}</li><li>+ <a href='#'>{_said(3)}</a></li></ul>"
    frame = "<div class='layout has-sidebar'><div class='overflow-hidden' aria-hidden='false'>"
    pages = [
        f"<body>{menu}{frame}<article class='post category-social'><header class='entry-header'><h1>+ {_said(6)}</h1></header><svg/>{para(70)}{para(2)}</article></div>{side}</div>{foot}</body>",
        f"<body><form id='aspnetForm'>{menu}<div class='page-sidebar'>{para(30, '-')}</div><div id='main-content'>{body}</div>{notice}</form>{foot}</body>",
        f"<body>{menu}<div class='ad'>- {_said(10)}</div><article>{body}</article>{foot}</body>",
        f"<body><header>- {_said(4)}</header>{menu}<main>{body}{side}{form}</main>{talk}{foot}</body>",
        f"<body>{notice}<div id='content'>{body}<div class='share'>- {_said(3)}</div></div>{side}{talk}{foot}</body>",
        f"<body><article><header><h1>+ {_said(5)}</h1></header>{body}{form}{talk}</article><div>- {_said(40)}</div><p>- {_said(3)}</p></body>",
        # Short and linked paragraphs are text inside an article and not outside of one.
        f"<body>{menu}<article>{para(0) * 3}<p>+ <a href='#'>{_said(1)}</a></p><p><a href='#'>+ {_said(6)}</a></p>{para(0) * 2}</article>{foot}</body>",
        f"<body><main><p><a href='#'>+ {_said(2)}</a></p>{para(0)}<p><a href='#'>+ {_said(9)}</a></p>{para(150)}{para(0)}</main>{para(60, '-')}{para(0, '-')}{menu}</body>",
        f"<body><div class='post'>{para(0)}</div><div class='promo'>{para(120, '-') * 2}</div><p>- {_said(25)}</p>{para(70, '-')}{foot}</body>",
        f"<body><p>- {_said(33)}</p><article><h1>+ {_said(1)}</h1></article><p>- {_said(45)}</p>{side}</body>",
        # Layouts that name nothing: length and links of a block and its neighbours decide.
        f"<body><div>{link(1) * 4}</div><div>{para(70)}{para(40)}{para(6)}{para(55)}</div><div>{link(3) * 3}</div><div>- {_said(4)}</div></body>",
        f"<body><ul>{link(2) * 6}</ul><table><tr><td>{para(35)}{para(90)}<p>+ {_said(20)} <a href='#'>{_said(3)}</a></p>{para(45)}</td></tr></table><p>- {_said(2)}</p><p><a href='#'>- {_said(8)}</a></p></body>",
        f"<body>{menu}<form id='all'><div>{para(21) * 4}</div></form>{foot}</body>",
        f"<body><form id='all'><div>{para(24) * 3}{para(15)}</div></form></body>",
        f"<body>{menu}{para(50)}{para(18)}{para(4)}{para(28)}{foot}</body>",
    ]
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x.append(block_features(found))
        y += [b.text[0] == "+" for b in found]
    return np.concatenate(x), np.array(y)


def main_text(page: str | None, tree: Node) -> str:
    """Texts of the blocks that the tree takes for the article, one to a line; empty if there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, judge(tree, block_features(found))) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages, read once and not shuffled.

    The tree is grown from ``labelled()``. Null and empty pages have an empty
    text; null ids and urls stay null; repeated rows give repeated rows; broken
    markup is read as far as it goes.
    """
    tree = grow(*labelled())
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(p, tree) for p in b.column("html").to_pylist()]
            yield rows((b.column("page_id").to_pylist(), b.column("url").to_pylist(), found, [len(t) for t in found]), out)

    src = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
