"""Tag vocabularies: which tags carry page structure, and the id of each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values ---------------------------------------------------------------
# Structural tags in vocabulary order; ids are positions in this order.
STRUCTURAL_TAGS = (
    "div header table html thead tbody tfoot ul ol nav iframe form input "
    "textarea button select optgroup option label fieldset section article aside"
).split()

# The wider structural list the active tags were chosen from, same order.
ALL_STRUCTURAL_TAGS = (
    "a div span header footer table html caption th tr td thead tbody tfoot ul "
    "ol li dir dl dt dd menu menuitem link nav canvas figure frame frameset "
    "iframe form input textarea button select optgroup option label fieldset "
    "legend datalist keygen output main section article aside details dialog "
    "summary figcaption"
).split()

# Tags that never carry structure (rows of the exclusion list).
EXCLUDED_TAGS = (
    "!DOCTYPE title body h1 h2 h3 h4 h5 h6 p br hr acronym abbr address b bdi "
    "bdo big blockquote center cite code data del dfn em font i ins kbd mark "
    "meter pre progress q rp rt ruby s samp small strike strong style sub sup "
    "time tt u var wbr head meta base basefont col colgroup audio source track "
    "video img map area figcaption noframes script noscript applet embed object "
    "param !--...--"
).split()
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Ordered structural tags.

    ``first_id`` is the id of the first tag. With ``first_id=0`` the first tag
    shares id 0 with "no child", so nodes with that tag are spliced out like
    unknown ones; with ``first_id=1`` every tag is visible.
    """

    tags: tuple[str, ...]
    excluded: frozenset[str] = field(default_factory=frozenset)
    first_id: int = 0

    @property
    def ids(self) -> dict[str, int]:
        return {
            tag: i
            for i, tag in enumerate(self.tags, self.first_id)
            if tag not in self.excluded
        }

    @property
    def size(self) -> int:
        """Edge length of the 3-gram count tensor: one axis cell per tag and one for "absent"."""
        return len(self.tags) + 1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.ids.items()), "tag string, tag_id int")


REFERENCE = Vocabulary(tuple(STRUCTURAL_TAGS), frozenset(EXCLUDED_TAGS))
FULL = Vocabulary(tuple(ALL_STRUCTURAL_TAGS), frozenset(), first_id=1)


def vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tag file in file order: ``line_no, token, tag``.

    The first line is a title. A row's tag is its first whitespace-separated
    token without the enclosing ``<`` and ``>``; ``<>`` rows give an empty tag.
    """
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    token = F.regexp_extract("line", r"^\s*(\S+)", 1)
    return (
        rows.filter((F.col("line_no") > 0) & (F.trim("line") != ""))
        .select("line_no", token.alias("token"))
        .withColumn("tag", F.expr("substring(token, 2, length(token) - 2)"))
    )


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``tag, tag_id`` from a tag file; a repeated tag keeps its last id.

    Whole-file read: a vocabulary is a hand-written list of a few dozen rows.
    """
    active = vocab_lines(spark, path).filter("tag <> ''")
    ids = active.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("line_no", "tag"))).alias("rows")
    )
    numbered = ids.select(F.posexplode("rows").alias("tag_id", "row"))
    return numbered.groupBy(F.col("row.tag").alias("tag")).agg(
        F.max("tag_id").cast("int").alias("tag_id")
    )


def load_excluded(spark: SparkSession, path: str) -> DataFrame:
    """``tag`` rows of an exclusion file, every row kept."""
    return vocab_lines(spark, path).select("tag")


def vocabulary_from_files(
    spark: SparkSession, path: str, excluded_path: str | None = None, first_id: int = 0
) -> Vocabulary:
    """Read tag files into a :class:`Vocabulary` (a few dozen names reach the driver)."""
    tags = [r.tag for r in load_vocab(spark, path).orderBy("tag_id").collect()]
    excluded = (
        [r.tag for r in load_excluded(spark, excluded_path).collect()]
        if excluded_path
        else []
    )
    return Vocabulary(tuple(tags), frozenset(excluded), first_id)
