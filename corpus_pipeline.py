"""A training-corpus pipeline: language, near-duplicates, leaks, personal data, mixture.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a table that is written and read again as the next one's ``docs``.
All but the last return the columns of ``docs``.

Empty tables, null texts, very long texts and extra columns pass through every
stage. Stages that drop rows tell these apart by ``doc_id`` and the digest of all
columns, so rows with a null or a repeated ``doc_id`` are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesim.llm import decontaminate, language, poisson_mix, simhash, surrogates
from pagesim.session import configure, materialize, ship

#: Least probability of a language that is accepted.
SURE = 0.5


def _shift():
    return F.lit(str(1 << 63)).cast("decimal(20,0)")


def _keyed(docs: DataFrame) -> DataFrame:
    """``row, id, key, words``: a key that sorts as ``doc_id`` does, null last, then by the row's digest."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    number = (F.col("doc_id").cast("decimal(20,0)") + _shift()).cast("string")  # not negative
    key = F.concat_ws(":", F.coalesce(F.lpad(number, 20, "0"), F.lit("null")), poisson_mix.row_digest(columns))
    return docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), key.alias("key"), F.col("text").alias("words"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not in the written table ``keys``.

    Where only one row has an id, the id is looked for, which is shorter than the key.
    """
    shared = materialize(keyed.groupBy("id").count().filter("count > 1").select("id"), "pipeline-shared")
    number = F.substring_index("key", ":", 1).try_cast("decimal(20,0)") - _shift()
    gone = materialize(keys.select("key").distinct().withColumn("id", number.cast("bigint")), "pipeline-gone")
    single = gone.filter("id is not null").select("id").join(shared, "id", "left_anti")
    several = gone.join(shared, "id", "left_semi").select("key").union(gone.filter("id is null").select("key"))
    left = keyed.join(materialize(single, "pipeline-single"), "id", "left_anti")
    return left.join(materialize(several, "pipeline-several"), "key", "left_anti")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with at least ``SURE``, go.

    The model learns from the labelled rows of ``docs``; where none is labelled
    no document can be rejected.
    """
    model = language.train(docs)
    if not model[0]:
        return docs
    predicted = language.predictor(spark, model)(F.col("text"))
    judged = docs.select(F.struct(*docs.columns).alias("row"), predicted.alias("is"))
    return judged.filter((F.col("is.lang_pred") != language.UNKNOWN) & (F.col("is.score") >= SURE)).select("row.*")


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the row with the smallest ``doc_id`` stays."""
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed, "key", "words")
    copies = materialize(found.filter("key <> component_id").select("key"), "pipeline-copies")
    kept = _without(keyed, copies).select("row", F.lit(None).cast("string").alias("source"), F.col("key").alias("digest"))
    return poisson_mix.numbered(kept).filter("number = 1").select("row.*")  # of equal rows the first


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    leaks = decontaminate.leaks(keyed.withColumnRenamed("words", "text"), benchmark, "key").select("key")
    return _without(keyed, materialize(leaks, "pipeline-leaks")).select("row.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; ``n_chars`` follows the text."""
    out = surrogates.replace_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    return poisson_mix.replicate(docs, poisson_mix.WEIGHTS)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_neardup", keep_one_of_copies),
    ("decontamination", drop_leaks),
    ("pii", replace_personal_data),
    ("source_mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one starts."""
    ship(configure(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, graph components and hashed windows have no SQL.
ORACLE_SQL = None
