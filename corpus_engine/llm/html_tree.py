"""Pages as trees of block elements: what the extraction model sees of the markup."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Element names of the format by their part in a page.
DROPPED = ["script", "style", "noscript", "template", "title", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "audio", "video"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
GROUPS = {
    "article": "main", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form", "fieldset": "form", "button": "form", "label": "form", "legend": "form", "dialog": "dialog",
    "div": "box", "section": "box", "center": "box", "details": "box", "summary": "box", "hgroup": "box",
    "p": "text", "blockquote": "text", "pre": "text", "address": "text", "figcaption": "text", "figure": "text",
    "h1": "title", "h2": "title", "h3": "title", "h4": "title", "h5": "title", "h6": "title",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell",
}
#: Elements that end when one of the listed begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
HINTS = [
    ("hidden", ["hidden", "visually", "sr"]),
    ("comment", ["comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "reviews"]),
    ("advert", ["ad", "ads", "advert", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "taboola", "outbrain"]),
    ("notice", ["cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "dialog", "toast"]),
    ("menu", ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "toolbar", "pagination", "pager", "toc", "search", "login", "skip"]),
    ("side", ["sidebar", "side", "aside", "widget", "complementary", "related", "recommended", "share", "sharing", "social", "tags", "popular", "trending", "more"]),
    ("edge", ["header", "footer", "masthead", "topbar", "bottom", "copyright", "contentinfo", "legal", "colophon", "site"]),
    ("body", ["article", "content", "post", "entry", "main", "story", "body", "text", "page"]),
]
HINT_OF = {word: hint for hint, words in reversed(HINTS) for word in words}
RANK = {hint: i for i, (hint, _) in enumerate(HINTS)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # A self-closed svg or math is empty; in a custom element as svg-icon the name goes on.
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    rf"|<(?P<raw>{'|'.join(DROPPED)})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-label|data-keep)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WHITE = re.compile(r"\s+")


@dataclass
class Block:
    """Text between two block boundaries: the node it stands in, its text, and how much of it is links."""

    node: int
    text: str
    linked: float


@dataclass
class Page:
    """Nodes in page order, parents before children: parent (-1: the page itself), group of the element, hint."""

    parent: list[int] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    hint: list[str] = field(default_factory=list)
    keep: list[int | None] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def hint_of(attrs: str) -> tuple[str, int | None]:
    """What class, id, role and label say of an element; and the label of a labelled page."""
    best, keep = "none", None
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "data-keep":
            keep = int(value)
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            best = "hidden"
        elif name != "style":
            for word in PART.findall(value):
                found = HINT_OF.get(word.lower())
                if found and (best == "none" or RANK[found] < RANK[best]):
                    best = found
    return best, keep


def parse(html: str) -> Page:
    """The tree of a page. Unclosed and stray tags are taken as a browser would take them, roughly."""
    page, stack, open_names = Page(), [], Counter()  # stack: (name, node)
    pieces: list[str] = []
    links, length, in_link, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal links, length
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append(Block(stack[-1][1] if stack else -1, text, links / max(length, 1)))
            pieces.clear()
        links = length = 0

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            open_names[top] -= 1
            if top == name:
                break

    def add(text: str) -> None:
        nonlocal links, length
        if text:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            length += len(text)
            links += len(text) if in_link else 0

    for m in TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, ends = name.lower(), bool(m["end"])
        group = GROUPS.get(name)
        if group is None:
            if name == "a":
                in_link = 0 if ends else 1
            elif name in ("br", "hr", "img"):
                pieces.append(" ")
            continue
        flush()
        if ends:
            if open_names[name]:
                close(name)
            continue
        if open_names["p"] and group not in ("form",):
            close("p")
        for other, starts in ENDED_BY.items():
            if name in starts and stack and stack[-1][0] == other:
                close(other)
        hint, keep = hint_of(m["attrs"]) if m["attrs"] else ("none", None)
        page.parent.append(stack[-1][1] if stack else -1)
        page.group.append(group)
        page.hint.append(hint)
        page.keep.append(keep)
        stack.append((name, len(page.parent) - 1))
        open_names[name] += 1
    add(html[at:])
    flush()
    return page
