"""Text blocks of an HTML page with their place in the document tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "select", "object", "canvas")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr "
                    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt "
                    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split())
#: Elements that the head may hold; any other ends it.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: An element's start ends an open one of these kinds.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    names: str = ""  # class, id and role, in lower case
    depth: int = 0
    hidden: bool = False


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    linked: int  # characters inside links


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    title: str = ""
    links: list[tuple[str, str]] = field(default_factory=list)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def read(page: str) -> Page:
    """Blocks in page order; scripts, styles, comments, hidden elements and the head give none."""
    out = Page()
    root = node = Node("", None)
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    href = ""

    def flush(at: Node) -> None:
        nonlocal parts, linked
        if parts:
            text = squeeze("".join(parts))
            if text:
                out.blocks.append(Block(text, at, len(squeeze("".join(linked)))))
        parts, linked = [], []

    def say(raw: str) -> None:
        nonlocal node
        if node.tag == "head" and raw.strip():
            node = node.parent
        if raw and not node.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    def container() -> Node:
        at = node
        while at.tag in _INLINE and at.parent is not None:
            at = at.parent
        return at

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                if tag not in _INLINE:
                    flush(container())
                if tag == "a" and in_link:
                    in_link -= 1
                node = up.parent
            elif tag == "p":
                flush(container())
            continue
        if node.tag == "head" and tag not in _IN_HEAD:
            node = node.parent
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3].strip(" /\t\r\n") else {}
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush(container())
            drop = _CLOSES.get(tag) or ({"p"} if tag not in _VOID or tag == "hr" else set())
            up = node
            while up is not root and (up.tag in _INLINE or up.tag in drop):
                if up.tag in drop:
                    node = up.parent
                    if up.tag == "p":
                        break
                up = up.parent
            in_link = sum(1 for _ in _links(node))
        if tag == "a":
            href = attrs.get("href", "")
            if href:
                out.links.append((href, ""))
        if tag in _VOID:
            continue
        raw = _RAW.get(tag)
        if raw is not None and not m[3].rstrip().endswith("/"):
            close = raw.search(page, at)
            if tag == "title" and not out.title:
                out.title = squeeze(html.unescape(page[at:close.start() if close else end]))
            at = page.find(">", close.end()) + 1 if close else end
            at = at or end
            continue
        names = " ".join(attrs[k] for k in ("class", "id", "role") if attrs.get(k)).lower()
        hidden = node.hidden or tag == "head" or "hidden" in attrs or bool(_HIDDEN.search(attrs.get("style", "")))
        if tag == "body":
            hidden = "hidden" in attrs
        node = Node(tag, node, names, node.depth + 1, hidden)
        if tag == "a":
            in_link += 1
    flush(container())
    return out


def _links(node: Node):
    while node is not None:
        if node.tag == "a":
            yield node
        node = node.parent
