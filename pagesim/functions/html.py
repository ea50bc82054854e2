"""HTML tokens to nested-set nodes: the row-level helper behind ``parse_html``.

Only the element structure is kept. A node is an interval: its position in
document order and the position just past its last descendant.
"""

from __future__ import annotations

import re
from collections import defaultdict

# Fixed values ---------------------------------------------------------------
VOID_TAGS = frozenset(
    "area base basefont br col embed frame hr img input isindex link meta param "
    "source track wbr".split()
)
HEAD_TAGS = frozenset("base link meta script style title".split())
PAGE_TAGS = frozenset(("html", "head", "body"))
FRAME_TAGS = frozenset("frame frameset noframes".split())
# Tags that make a multi-element fragment a "div" rather than a "span".
BLOCK_TAGS = frozenset(
    "address article aside blockquote center dd dir div dl dt fieldset figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr isindex li menu nav "
    "noframes noscript ol p pre section table tbody td tfoot th thead tr ul".split()
)
# A start tag ends these open elements when nothing in SCOPE_TAGS lies between.
IMPLIED_ENDS = {
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "tr": {"td", "th", "tr", "p"},
    "thead": {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "p"},
    "tbody": {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "p"},
    "tfoot": {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "p"},
}
PARAGRAPH_ENDERS = (
    "p address blockquote center dir div dl fieldset form frameset h1 h2 h3 h4 h5 "
    "h6 hr menu ol pre table ul"
).split()
SCOPE_TAGS = frozenset(
    "html body div table ul ol dl dir menu select form fieldset blockquote section "
    "article aside nav header footer main figure iframe object button center".split()
)
# An end tag cannot reach past an open element of higher rank (all others 100).
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}
# ----------------------------------------------------------------------------
for _tag in PARAGRAPH_ENDERS:
    IMPLIED_ENDS.setdefault(_tag, {"p"})

_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
       |<(?P<raw>script|style)(?=[\s/>])(?P<rawattrs>{_ATTRS})>(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*)
       |</(?P<end>[a-z][^\s/>]*)[^>]*>
       |<(?P<start>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})>
       |<[!?/][^>]*>""",
    re.X | re.I | re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WHOLE_DOCUMENT = re.compile(r"\s*<(?:html|!doctype)", re.I)


class Nodes:
    """Columns of the nodes of one page, in document order."""

    __slots__ = ("tag", "parent", "depth", "end", "attrs")

    def __init__(self):
        self.tag, self.parent, self.depth, self.end, self.attrs = [], [], [], [], []


class _Builder:
    def __init__(self, attr_names):
        self.nodes = Nodes()
        self.stack = []  # (tag, position) of open elements
        self.open = defaultdict(int)  # how many of each tag are open
        self.names = attr_names
        self.body = None
        self.body_text = False

    def add(self, tag, attrs="", leaf=False):
        nodes, pos = self.nodes, len(self.nodes.tag)
        nodes.tag.append(tag)
        nodes.parent.append(self.stack[-1][1] if self.stack else -1)
        nodes.depth.append(len(self.stack))
        nodes.end.append(pos + 1)
        if self.names:
            nodes.attrs.append(_attributes(attrs, self.names))
        if not leaf:
            self.stack.append((tag, pos))
            self.open[tag] += 1
        return pos

    def cut(self, level):
        """Close every open element from stack index ``level`` up."""
        end = len(self.nodes.tag)
        for tag, pos in self.stack[level:]:
            self.nodes.end[pos] = end
            self.open[tag] -= 1
        del self.stack[level:]

    def imply(self, tag):
        """Open the html, head or body that ``tag`` needs; False drops the tag."""
        stack = self.stack
        if not stack and tag != "html":
            self.add("html")
        if tag == "html":
            return not stack
        if self.body is not None:
            return tag not in ("body", "head")
        in_head = len(stack) > 1 and stack[1][0] == "head"
        if tag == "head":
            return not in_head
        if tag in HEAD_TAGS:
            if len(stack) == 1:
                self.add("head")
            return True
        if in_head and (len(stack) == 2 or tag == "body"):
            self.cut(1)
        if len(self.stack) == 1 and tag not in FRAME_TAGS:
            self.body = len(self.nodes.tag)
            if tag != "body":
                self.add("body")
        return True

    def text(self):
        """Visible text right inside html, head or body."""
        level = len(self.stack)
        if self.body is None and (level < 2 or (level == 2 and self.stack[1][0] == "head")):
            self.imply("p")
            self.add("p")
        elif level == 2:
            self.body_text = True

    def start(self, tag, attrs, closed):
        if (self.body is None or tag in PAGE_TAGS) and not self.imply(tag):
            return
        ends, left = IMPLIED_ENDS.get(tag, ()), 0
        for name in ends:
            left += self.open[name]
        if left:
            level = None
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.stack[i][0]
                if name in ends:
                    level, left = i, left - 1
                    if not left:
                        break
                elif name in SCOPE_TAGS:
                    break
            if level is not None:
                self.cut(level)
        self.add(tag, attrs, leaf=closed or tag in VOID_TAGS)

    def finish(self, tag):
        # Content after the end of html or body still belongs to the body.
        if tag in ("html", "body") or not self.open[tag]:
            return
        rank = END_RANK.get(tag, 100)
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                self.cut(i)
                return
            if END_RANK.get(name, 100) > rank:
                return


def _attributes(text, names):
    found = {}
    for name, *values in _ATTR.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return [(n, found[n]) for n in names if found.get(n)]


def parse(html: str, attr_names=()) -> Nodes:
    """Nodes of a page; no nodes when the document is empty."""
    page = _Builder(attr_names)
    stack, start, finish = page.stack, page.start, page.finish
    last = 0
    # No tag ends after the last ">", so no match needs to look further.
    for m in _TOKEN.finditer(html, 0, html.rfind(">") + 1):
        begin, end = m.span()
        if len(stack) < 3 and begin > last and not html[last:begin].isspace():
            page.text()
        last = end
        kind = m.lastgroup
        if kind == "attrs":
            tag, attrs = m.group("start", "attrs")
            start(tag.lower(), attrs, attrs.endswith("/"))
        elif kind == "end":
            finish(m["end"].lower())
        elif m["raw"]:
            page.start(m["raw"].lower(), m["rawattrs"], True)
        elif stack and html.startswith("<!--", begin):
            page.add("#comment", leaf=True)
    if html[last:].strip() and len(page.stack) < 3:
        page.text()
    page.cut(0)
    nodes = page.nodes
    if nodes.tag and not _WHOLE_DOCUMENT.match(html):
        nodes = _fragment(nodes, page.body, page.body_text)
    return nodes


def _fragment(nodes: Nodes, body, body_text) -> Nodes:
    """A fragment's root: its only element, or its body renamed to div or span."""
    if body is None or body != 1:
        return nodes
    tags, children = nodes.tag, [i for i, p in enumerate(nodes.parent) if p == body]
    root = body
    if len(children) == 1 and not body_text:
        root = children[0]
    else:
        block = any(t in BLOCK_TAGS for t in tags[body + 1:nodes.end[body]])
        tags[body] = "div" if block else "span"
    out, base = Nodes(), nodes.depth[root]
    span = slice(root, nodes.end[root])
    out.tag = tags[span]
    out.parent = [p - root for p in nodes.parent[span]]
    out.parent[0] = -1
    out.depth = [d - base for d in nodes.depth[span]]
    out.end = [e - root for e in nodes.end[span]]
    out.attrs = nodes.attrs[span]
    return out
