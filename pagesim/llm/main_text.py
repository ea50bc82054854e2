"""HTML extraction by tag-path ratios.

A page's leaves are its runs of text; the *tag path* of a leaf is the sequence of
tags (with their classes) from the root to it. Content leaves of a page share few
paths and are long and punctuated; menus, adverts and footers share other paths
and are short. Per path the operator aggregates text length, punctuation, linked
text and the number of leaves; two ratios per path,

* length ratio: mean text length per leaf, times the spread of the lengths,
* punctuation ratio: punctuation marks per leaf, times the spread of their counts,

are fused (geometric mean) and smoothed along the page with a Gaussian window.
A path's score is that of its leaves, weighed by their text, times the share of it
that is no link; an ``article`` or ``main`` raises it, class names that tell of
menus, adverts or comments lower it, and no name alone decides. The *main path*
has the greatest score times log of its text. Paths whose score is at least
``THRESHOLD`` of the main path's are content, and so is what stands beside its
leaves in the same container, unless lowered or mostly links. Text inside parts
that are no article by their tag (navigation, forms, footers) is never content.

One narrow pass over whole pages; tokens are found with one regular expression,
paths are numbered by parent and step, and a page costs time and memory in
proportion to its length, however deep or broken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

THRESHOLD = 0.5  # of the main path's score
RAISED, LOWERED = 2.0, 0.25  # by an article element; by a name
SMOOTHING = 1  # leaves on each side

# HTML elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg math iframe object head title select option button textarea".split())
RAW = set("script style noscript template textarea title iframe".split())
HOLLOW = set("svg math object select".split())  # what is inside is no text of the page, but the page goes on when it is left open
INLINE = set(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small
    span strike strong sub sup time tt u var wbr""".split()
)
ASIDE = set("nav footer aside form menu dialog fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names that parts around an article have.
NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|header|"
    r"masthead|comments?|reply|replies|disqus|related|recommend\w*|share|social|newsletter|subscribe|signup|login|"
    r"cookies?|consent|notice\w*|popup|modal|legal|copyright|tags?|pagination|pager|toolbar|widget\w*"
)
#: Words that articles have in their names.
OWN_NAMES = set("article entry post story hentry".split())
WIDE_NAMES = set("content main".split())
#: An opening tag closes an open element of these names (and what is inside it).
CLOSED_BY = {
    "p": set(
        """address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
        header hr main menu nav ol p pre section table ul""".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
CLOSES = {tag: [own for own, by in CLOSED_BY.items() if tag in by] for tag in set().union(*CLOSED_BY.values())}
#: An opening tag of these ends an svg, math or select that was left open.
BREAKS_OUT = CLOSED_BY["p"] | {"p", "body", "li", "dl", "dt", "dd", "center"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_MARKS = re.compile(r"[.,;:!?…。、，！？؛،]")
_SPACES = re.compile(r"\s+")


@lru_cache(4096)
def lowers(names: str) -> bool:
    """Whether class and id names tell of a part around an article.

    The last word of a compound counts most: ``tags-post`` is a post, ``post-tags``
    are not. One name of an article outweighs all others.
    """
    bad = False
    for name in names.split():
        words = re.split("[_-]+", name)
        doubted = any(NAMES.fullmatch(w) for w in words)
        if words[-1] in OWN_NAMES or not doubted and not WIDE_NAMES.union(OWN_NAMES).isdisjoint(words):
            return False
        bad |= doubted
    return bad


class Paths:
    """Tag paths as numbers: each is its parent's and a step; number 0 is the empty one."""

    def __init__(self):
        self.steps: dict[tuple[int, str], int] = {}
        self.parents = [0]
        self.wide = [True]  # the whole page

    def step(self, parent: int, tag: str, names: str) -> int:
        found = self.steps.setdefault((parent, f"{tag}.{names}" if names else tag), len(self.parents))
        if found == len(self.parents):
            self.parents.append(parent)
            self.wide.append(tag in ("html", "body"))
        return found


class Leaf:
    """A run of text of one block: its path, its block number and what is known of its place."""

    __slots__ = ("barred", "block", "factor", "heading", "linked", "path", "text")

    def __init__(self, path: int, block: int, text: str, barred: bool, factor: float, heading: bool, linked: bool):
        self.path, self.block, self.text, self.barred = path, block, text, barred
        self.factor, self.heading, self.linked = factor, heading, linked


class Open:
    """An open element."""

    __slots__ = ("article", "barred", "lowered", "path", "tag")

    def __init__(self, tag: str, path: int, barred: bool, lowered: bool, article: bool):
        self.tag, self.path, self.barred, self.lowered, self.article = tag, path, barred, lowered, article


_ROOT = Open("", 0, False, False, False)


def leaves(page: str, paths: Paths) -> list[Leaf]:
    """The text leaves of a page in order; what is hidden has none."""
    stack: list[Open] = []
    out: list[Leaf] = []
    counts: dict[str, int] = {}  # open elements by tag
    block = at = 0

    def text(upto: int) -> None:
        raw = page[at:upto] if counts.keys().isdisjoint(HOLLOW) else ""
        if raw and not raw.isspace():
            last = stack[-1] if stack else _ROOT
            factor = (RAISED if last.article else 1.0) * (LOWERED if last.lowered else 1.0)
            out.append(Leaf(last.path, block, html.unescape(raw), last.barred, factor, any(h in counts for h in HEADINGS), "a" in counts))
        elif raw and out and out[-1].block == block:
            out[-1].text += " "

    def pop() -> str:
        tag = stack.pop().tag
        counts[tag] -= 1
        if not counts[tag]:
            del counts[tag]
        return tag

    found = _TOKEN.search(page)
    while found:
        text(found.start())
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            pass
        elif found[1]:
            block += tag not in INLINE
            if tag in counts:
                while pop() != tag:
                    pass
        else:
            block += tag not in INLINE or tag == "br"
            for open_tag in CLOSES.get(tag, ()):
                if open_tag in counts:
                    if not (open_tag == "li" and _nested(stack, "li", ("ul", "ol", "menu"))) and not (
                        open_tag in ("td", "th", "tr") and _nested(stack, open_tag, ("table",))
                    ):
                        while pop() != open_tag:
                            pass
            if tag in BREAKS_OUT:
                for open_tag in ("svg", "math", "select"):
                    if open_tag in counts and "foreignobject" not in counts:
                        while pop() != open_tag:
                            pass
            if tag in RAW and not (found[3].endswith("/") and ("svg" in counts or "math" in counts)):  # nothing inside is text of the page
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not found[3].endswith("/"):
                names = "" if tag in INLINE else " ".join(a or b or c for a, b, c in _NAMED.findall(found[3])).lower()
                last = stack[-1] if stack else _ROOT
                own = tag in HIDDEN or tag in ASIDE or tag == "header" and not last.article
                whole = tag in ("html", "body", "article", "main")
                path = last.path if tag in INLINE else paths.step(last.path, tag, names)
                lowered = last.lowered or bool(names) and tag not in ("html", "body") and lowers(names)
                stack.append(Open(tag, path, last.barred or own and not whole, lowered, last.article or tag in ("article", "main")))
                counts[tag] = counts.get(tag, 0) + 1
        found = _TOKEN.search(page, at)
    text(len(page))
    return out


def _nested(stack: list[Open], tag: str, parents: tuple[str, ...]) -> bool:
    """Whether a parent element was opened inside the last open ``tag``."""
    for element in reversed(stack):
        if element.tag == tag:
            return False
        if element.tag in parents:
            return True
    return False


def path_scores(lengths: np.ndarray, marks: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """The fused ratio of each leaf's path, smoothed along the page."""
    count = np.bincount(paths)
    fused = np.ones(len(count))
    for values, least in ((lengths, 0), (marks, 1)):  # text without marks still has its length
        mean = np.bincount(paths, weights=values) / count
        spread = np.sqrt(np.maximum(np.bincount(paths, weights=values * values) / count - mean * mean, 0))
        fused *= least + np.log1p(mean * (1 + spread))
    scores = np.sqrt(fused)[paths]
    reach = np.arange(-SMOOTHING, SMOOTHING + 1)
    weights = np.exp(-(reach**2) / 2.0)
    padded = np.pad(scores, SMOOTHING, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def main_text(page: str | None) -> str:
    """The article text of a page; empty for null, empty and text-free pages."""
    if not page:
        return ""
    tree = Paths()
    blocks: list[list[Leaf]] = []
    for leaf in leaves(page, tree):
        if blocks and blocks[-1][0].block == leaf.block:
            blocks[-1].append(leaf)
        else:
            blocks.append([leaf])
    rows = []
    for own in blocks:
        text = _SPACES.sub(" ", "".join(leaf.text for leaf in own)).strip()
        if text:
            rows.append((own[0], text, sum(len(leaf.text.strip()) for leaf in own if leaf.linked)))
    barred = np.array([leaf.barred for leaf, _, _ in rows], dtype=bool)
    if barred.all():
        return ""
    numbers, paths = np.unique([leaf.path for leaf, _, _ in rows], return_inverse=True)
    lengths = np.array([len(text) for _, text, _ in rows], dtype=float)
    marks = np.array([len(_MARKS.findall(text)) for _, text, _ in rows], dtype=float)
    links = np.minimum([linked for _, _, linked in rows], lengths)
    factors = np.array([leaf.factor for leaf, _, _ in rows]) * ~barred
    sizes = np.bincount(paths, weights=lengths)
    linked = np.bincount(paths, weights=links) / sizes
    smooth = np.bincount(paths, weights=lengths * factors * path_scores(lengths, marks, paths)) / sizes
    score = smooth * np.maximum(1 - linked, 0.1)
    main = int((score * np.log1p(sizes)).argmax())
    keep = (score >= THRESHOLD * score[main])[paths] & ~barred
    # what stands beside the main path's leaves, in their container
    around = tree.parents[numbers[main]]
    inside = np.zeros(len(tree.parents), dtype=bool)
    for number in range(1, len(inside)):  # parents come first
        inside[number] = number != around and (tree.parents[number] == around or inside[tree.parents[number]])
    inside[around] = True
    beside = inside[numbers][paths] & (factors >= factors[paths == main].max()) & (links < lengths / 2)
    if tree.wide[around]:  # of the whole page only what stands between them
        span = np.flatnonzero(keep & (paths == main))
        beside[: span[0]] = beside[span[-1] :] = False
    keep |= beside & ~barred
    # a heading between or right before kept leaves belongs to them
    heading = np.array([leaf.heading for leaf, _, _ in rows]) & ~barred
    for i in range(len(rows) - 2, -1, -1):
        if heading[i] and keep[i + 1]:
            keep[i] = True
    return " ".join(text for (_, text, _), k in zip(rows, keep) if k)


def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def article(page: Column) -> Column:
    """The main text of a column of whole HTML pages."""
    return F.pandas_udf(_extract, "string")(page)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key, url, text`` of every page, by a pass without a shuffle.

    Character references are decoded, white space inside a block is one blank,
    blocks are joined by a blank in page order. Null and empty pages, and pages
    without text, give an empty text. Repeated rows are answered each for
    itself; further columns are not read.
    """
    return pages.select(F.col(key), F.col("url"), article(F.col(page)).alias("text"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
