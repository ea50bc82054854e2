"""The ready-made stages from extracted pages to features."""

from __future__ import annotations

from ..functions.vocabulary import REFERENCE, Vocabulary
from ..operators import dom, records, tree
from .stage import Stage

# Labels of the ready-made stages.
EXTRACT, PARSE, REDUCE, STRING, GRAMS = (
    records.EXTRACT, "html_parse", "tree_parse", "tree_stringify", "tree_to_matrix",
)


class HtmlExtract(Stage):
    """Archive records to pages."""

    def __init__(self, min_length: int = records.MIN_LENGTH):
        self.min_length = min_length

    def transform(self, df):
        return records.extract_html(df, self.min_length)


class HtmlParse(Stage):
    """Pages to DOM nodes."""

    requirements, label = (EXTRACT,), PARSE

    def __init__(self, html: str = "html", keep=None):
        self.html, self.keep = html, keep

    def transform(self, df):
        return dom.parse_html(df, self.html, keep=self.keep).drop(self.html)


class TreeReduce(Stage):
    """DOM nodes to structural nodes."""

    requirements, label = (EXTRACT, PARSE), REDUCE

    def __init__(self, vocab: Vocabulary = REFERENCE):
        self.vocab = vocab

    def transform(self, df):
        return tree.structural_nodes(df, self.vocab)


class TreeString(Stage):
    """Structural nodes to the preorder string."""

    requirements, label = (EXTRACT, PARSE, REDUCE), STRING

    def transform(self, df):
        return tree.preorder_string(df)


class TreeGrams(Stage):
    """Structural nodes to the 3-gram set and count vector."""

    requirements, label = (EXTRACT, PARSE, REDUCE), GRAMS

    def __init__(self, vocab: Vocabulary = REFERENCE):
        self.vocab = vocab

    def transform(self, df):
        grams = tree.structural_grams(tree.binary_tree(df))
        out = tree.gram_vector(tree.gram_set(grams), self.vocab.size)
        return out.drop("tree", "binary", "gram_list")


def feature_stages(vocab: Vocabulary = REFERENCE) -> list[Stage]:
    return [HtmlParse(keep=list(vocab.ids)), TreeReduce(vocab), TreeGrams(vocab)]
