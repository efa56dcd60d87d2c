"""A small, forgiving DOM for feature extraction: elements, their text runs in page order, implied end tags."""

from __future__ import annotations

import html
import re

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head option legend summary tbody td tfoot th thead tr dd dt li".split())
#: tag -> (open tags that it ends, where the search for them stops)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "depth", "pieces", "text", "link_text", "order")

    def __init__(self, tag: str, words: frozenset, parent: Node | None, depth: int, order: int):
        self.tag, self.words, self.parent, self.depth, self.order = tag, words, parent, depth, order
        self.children: list[Node] = []
        self.text = self.link_text = 0  # characters of own text runs, and of those inside links


def parse(page: str) -> tuple[Node, list[tuple[Node, str | None]]]:
    """The root, and the page as a list of (block element, text run); None instead of a run marks a block's border."""
    root = Node("#root", frozenset(), None, 0, 0)
    stack, runs, order = [root], [], 0  # open block-level elements and others of structure
    inline: list[str] = []  # open links
    at = 0

    def close_to(k: int) -> None:
        del stack[k:]
        inline.clear()
        runs.append((stack[-1], None))

    def run(text: str) -> None:
        if text:
            node = stack[-1]
            n = len(text.strip())
            node.text += n
            if inline:
                node.link_text += n
            runs.append((node, text))

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            run(page[at:])
            break
        run(page[at : m.start()])
        at, tag = m.end(), m.group()
        if tag[1] in "!?":
            continue
        name = NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if name == "a":
                inline.clear()
            elif name in BLOCK:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name), 0)
                if k and name not in ("body", "html"):
                    close_to(k)
            continue
        if name in RAW and not tag.endswith("/>"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name not in ("button", "svg", "math", "select"):
                at = len(page)
            continue
        if name in VOID and name != "hr":
            run(" ")
            continue
        if name not in BLOCK:
            if name == "a":
                inline.append(name)
            continue
        if name in ("html", "body") and any(n.tag == name for n in stack):
            continue
        if name in CLOSES_P and stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and not (stack[-1].tag != "p" and name not in ("h1", "h2", "h3", "h4", "h5", "h6", "p")):
            close_to(len(stack) - 1)
        if name in ENDS:
            which, stops = ENDS[name]
            k = len(stack)
            while k > 1 and stack[k - 1].tag not in stops and stack[k - 1].tag in which | {"p"}:
                k -= 1
            if k < len(stack) and any(n.tag in which for n in stack[k:]):
                close_to(k)
        order += 1
        words = frozenset()
        if len(tag) > len(name) + 2:
            words = frozenset(w for key, *v in ATTRIBUTE.findall(tag[len(name) + 1 : -1]) if key.lower() in ("class", "id", "role", "itemprop", "aria-label") for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(v)).lower()))
        node = Node(name, words, stack[-1], stack[-1].depth + 1, order)
        stack[-1].children.append(node)
        inline.clear()
        runs.append((stack[-1], None))
        if name != "hr":
            stack.append(node)
    return root, runs


def blocks(runs: list[tuple[Node, str | None]], wanted: set[int]) -> str:
    """Text of the runs whose element is wanted (by order): references decoded, white space folded, joined by blank lines."""
    out, now = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    for node, text in runs:
        if text is None:
            close()
        elif node.order in wanted:
            now.append(text)
    close()
    return "\n\n".join(out)
