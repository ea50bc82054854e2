"""The stages as ``pyspark.ml`` transformers: with params, in pipelines, saved and loaded.

A chain of them is a ``PipelineModel``; ``write().save(path)`` stores its params
and ``PipelineModel.load(path)`` brings it back in another session. Preconditions
and lineage are those of the stages. For a stage of one's own, subclass
:class:`StageTransformer`, declare its params and define ``stage``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from ..functions.vocabulary import REFERENCE, Vocabulary
from ..operators import records, sketches
from .stage import Stage
from .stages import EXTRACT, GRAMS, PARSE, REDUCE, HtmlExtract, HtmlParse, TreeGrams, TreeReduce, TreeString


class StageTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose settings are params; ``stage`` makes it from their values."""

    def stage(self) -> Stage:
        raise NotImplementedError("a transformer defines its stage")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.transform(self.stage())


class _HasVocabulary(Params):
    tags = Param(Params._dummy(), "tags", "structural tags in order", TypeConverters.toListString)
    excluded = Param(Params._dummy(), "excluded", "tags that are left out", TypeConverters.toListString)
    firstId = Param(Params._dummy(), "firstId", "id of the first tag", TypeConverters.toInt)

    def setVocabulary(self, vocab: Vocabulary):
        return self._set(tags=list(vocab.tags), excluded=sorted(vocab.excluded), firstId=vocab.first_id)

    def getVocabulary(self) -> Vocabulary:
        get = self.getOrDefault
        return Vocabulary(tuple(get(self.tags)), frozenset(get(self.excluded)), get(self.firstId))


class HtmlExtractor(StageTransformer):
    """Archive records to pages."""

    minLength = Param(Params._dummy(), "minLength", "records up to so many bytes are dropped", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, minLength=None):
        super().__init__()
        self._setDefault(minLength=records.MIN_LENGTH)
        self._set(**self._input_kwargs)

    def stage(self):
        return HtmlExtract(self.getOrDefault(self.minLength))


class HtmlParser(StageTransformer):
    """Pages to DOM nodes, of all tags or of ``keep`` only."""

    htmlCol = Param(Params._dummy(), "htmlCol", "column of the page's text", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "tags whose nodes are kept; none for all", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, htmlCol=None, keep=None):
        super().__init__()
        self._setDefault(htmlCol="html", keep=[])
        self._set(**self._input_kwargs)

    def stage(self):
        return HtmlParse(self.getOrDefault(self.htmlCol), self.getOrDefault(self.keep) or None)


class TreeReducer(StageTransformer, _HasVocabulary):
    """DOM nodes to structural nodes."""

    def __init__(self, vocab: Vocabulary = REFERENCE):
        super().__init__()
        self.setVocabulary(vocab)

    def stage(self):
        return TreeReduce(self.getVocabulary())


class TreeStringifier(StageTransformer):
    """Structural nodes to the preorder string."""

    def stage(self):
        return TreeString()


class TreeToGrams(StageTransformer, _HasVocabulary):
    """Structural nodes to the 3-gram set and count vector."""

    def __init__(self, vocab: Vocabulary = REFERENCE):
        super().__init__()
        self.setVocabulary(vocab)

    def stage(self):
        return TreeGrams(self.getVocabulary())


class MinHasher(StageTransformer):
    """3-gram sets to MinHash signatures."""

    itemsCol = Param(Params._dummy(), "itemsCol", "column of the sorted set", TypeConverters.toString)
    numPerm = Param(Params._dummy(), "numPerm", "values of a signature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the permutations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, itemsCol=None, numPerm=None, seed=None):
        super().__init__()
        self._setDefault(itemsCol="grams", numPerm=128, seed=12)
        self._set(**self._input_kwargs)

    def stage(self):
        get = self.getOrDefault
        items, size, seed = get(self.itemsCol), get(self.numPerm), get(self.seed)
        return Stage.of("minhash", lambda df: sketches.minhash_sets(df, items, size, seed), (EXTRACT, PARSE, REDUCE, GRAMS))


def feature_pipeline(vocab: Vocabulary = REFERENCE) -> PipelineModel:
    """Extracted pages (``url, html`` and lineage) to 3-gram sets, vectors and signatures."""
    return PipelineModel([HtmlParser(keep=list(vocab.ids)), TreeReducer(vocab), TreeToGrams(vocab), MinHasher()])
