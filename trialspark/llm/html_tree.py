"""Trees of blocks from HTML, for any input: no markup is an error.

A node is a structural element that holds text, or a leaf: the text between two block
boundaries, without inline markup, character references decoded, runs of white space
(``br`` included) one space each, trimmed. Elements whose text is never prose (scripts,
styles, form controls, ...) have no leaves; comments, declarations and a tag cut off by
the end of the page vanish. End tags may be missing: blocks end an open paragraph, items
end items, cells end cells; an end tag without a start tag is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style textarea title iframe noembed noframes template noscript select option datalist button svg math object canvas audio video map input".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption address summary legend".split())
CONTAINERS = frozenset("body html div section article main ul ol dl table tbody thead tfoot tr figure center fieldset details hgroup search".split())
CHROME = frozenset("nav aside header footer form menu dialog".split())
BLOCKS = PARAGRAPHS | CONTAINERS | CHROME
ENDS_PARAGRAPH = BLOCKS - frozenset("td th tr tbody thead tfoot caption body html li dt dd legend".split()) | {"hr"}
#: What a start tag ends of the elements still open, up to one of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WALLS = frozenset("td th caption table".split())
TABLE = frozenset("table tr td th tbody thead tfoot caption".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.S,
)
HINT = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
SPACE = re.compile(r"\s+")


@dataclass
class Tree:
    """Nodes in page order, parents before children; the root is node 0.

    ``words``: parts of class, id and role of elements; ``text``: of leaves, else None;
    ``linked``: characters of a leaf that are inside links."""

    tag: list[str] = field(default_factory=lambda: ["body"])
    parent: list[int] = field(default_factory=lambda: [-1])
    words: list[list[str]] = field(default_factory=lambda: [[]])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, words: list[str], text: str | None, linked: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def hints(rest: str) -> list[str]:
    found = []
    for m in HINT.finditer(rest):
        found += [w.lower() for w in PART.findall(m[2] or m[3] or m[4] or "")]
    if "hidden" in rest.lower() or "none" in rest.lower():
        found += ["hidden"] * bool(HIDDEN.search(rest))
    return found


def _clean(parts: list[tuple[str, bool]]) -> tuple[str, int]:
    text = SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
    return text, min(len(text), sum(len(SPACE.sub(" ", p)) for p, link in parts if link))


def parse(html: str) -> Tree:
    """The tree of a page; the root alone if it has no text."""
    tree, at = Tree(), 0
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements and their nodes
    opened: Counter[str] = Counter(body=1)
    parts: list[tuple[str, bool]] = []
    links = 0  # how many elements were open when the open link began
    muted: list[str] = []  # open elements without prose, and blocks open inside them
    end_of: dict[str, re.Pattern] = {}

    def cut() -> None:
        nonlocal parts
        if parts:
            text, linked = _clean(parts)
            if text:
                tree.add("#text", stack[-1][1], [], text, linked)
            parts = []

    def pop() -> None:
        nonlocal links
        opened[stack.pop()[0]] -= 1
        if len(stack) < links:
            links = 0

    def close(names: frozenset[str], walls: frozenset[str]) -> bool:
        """Ends the innermost open element of ``names`` that no wall is inside of."""
        if not any(opened[n] for n in names):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return True
            if stack[i][0] in walls:
                return False
        return False

    def say(raw: str, decode: bool = True) -> None:
        if raw and not muted:
            parts.append((unescape(raw) if decode and "&" in raw else raw, links > 0))

    n = len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"], False)
            continue
        name = m["name"] or m["name2"]
        if name is None or (at == n and html[-1] != ">"):  # no element, or a tag cut off
            continue
        name, rest, ends = name.lower(), m["rest"] or "", bool(m["end"] or m["end2"])
        if muted:
            if ends and name in BLOCKS and name not in muted and opened[name]:
                muted.clear()  # what was left open ends with the block around it
            elif ends:
                while name in muted and muted.pop() != name:
                    pass
                continue
            elif name in RAW:
                at = _past_raw(html, at, name, end_of)
                continue
            else:
                if (name in NEVER or name in BLOCKS) and name not in VOID and not rest.endswith("/"):
                    muted.append(name)
                continue
        if name in RAW and not ends:
            at = _past_raw(html, at, name, end_of)
        elif name in NEVER:
            if not ends and name not in VOID and not rest.endswith("/"):
                muted.append(name)
        elif name == "a":
            links = 0 if ends else len(stack)  # links don't nest
        elif name == "br":
            say(" ", False)
        elif name == "hr":
            cut()
            close(frozenset(["p"]), WALLS)
        elif name in ("html", "body"):
            if not ends:
                tree.words[0] += hints(rest)
        elif name in BLOCKS:
            cut()
            if ends:
                names = HEADINGS if name in HEADINGS else frozenset([name])
                close(names, frozenset(["table"]) - {name} if name in TABLE else WALLS | {"ul", "ol"} if name == "li" else WALLS)
                continue
            if name in ENDS_PARAGRAPH:
                close(frozenset(["p"]), WALLS)
            if name in HEADINGS and stack[-1][0] in HEADINGS:
                pop()
            if name in ENDS:
                close(*ENDS[name])
            stack.append((name, tree.add(name, stack[-1][1], hints(rest), None, 0)))
            opened[name] += 1
    cut()
    return tree


def _past_raw(html: str, at: int, name: str, known: dict[str, re.Pattern]) -> int:
    """Where a raw element that starts at ``at`` has ended."""
    if name not in known:
        known[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I)
    m = known[name].search(html, at)
    return m.end() if m else len(html)
