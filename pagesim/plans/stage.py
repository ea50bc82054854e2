"""Stages with labelled preconditions, lineage and error accumulation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.dom import add_errors

LINEAGE = "transformations"
_LABELS = "labels"


def _known_labels(df: DataFrame) -> list[str] | None:
    """Labels every row is known to carry, from the lineage column's metadata."""
    if LINEAGE not in df.columns:
        return []
    return df.schema[LINEAGE].metadata.get(_LABELS)


def require(df: DataFrame, stage: str, labels: Iterable[str]) -> DataFrame:
    """Check that every row's lineage holds ``labels``.

    Fails while planning when the lineage is known or absent; otherwise the
    check runs with the data and the job fails on the first bad row.
    """
    labels = list(labels)
    known = _known_labels(df)
    if known is not None:
        for label in labels:
            if label not in known:
                raise RuntimeError(f"Requirement {label!r} not met for {stage}: {known}")
        return df
    lineage = F.col(LINEAGE)
    for label in labels:
        message = F.concat(
            F.lit(f"Requirement {label!r} not met for {stage}: "),
            F.array_join(F.coalesce(lineage, F.array()), ","),
        )
        ok = F.coalesce(F.array_contains(LINEAGE, label), F.lit(False))
        lineage = F.when(ok, lineage).otherwise(F.raise_error(message).cast("array<string>"))
    return df.withColumn(LINEAGE, lineage)


def with_stage(df: DataFrame, label: str, errors: Column | None = None) -> DataFrame:
    """Append a stage's label to the lineage and its messages to the errors."""
    known = _known_labels(df)
    before = F.col(LINEAGE) if LINEAGE in df.columns else F.array().cast("array<string>")
    lineage = F.array_append(before, F.lit(label))
    if known is not None:
        lineage = lineage.alias(LINEAGE, metadata={_LABELS: known + [label]})
    out = df.withColumn(LINEAGE, lineage)
    return out if errors is None else add_errors(out, errors)


class Stage:
    """A step of a chain of DataFrame transformations.

    Subclasses set ``requirements`` and ``label`` and define ``transform``; a
    plain function can be wrapped with :meth:`of`. Apply with
    ``df.transform(stage)``.
    """

    requirements: tuple[str, ...] = ()
    label: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError("a stage defines transform")

    def __call__(self, df: DataFrame) -> DataFrame:
        out = self.transform(require(df, type(self).__name__, self.requirements))
        return out if self.label is None else with_stage(out, self.label)

    @staticmethod
    def of(label: str, function: Callable[[DataFrame], DataFrame],
           requirements: Iterable[str] = ()) -> "Stage":
        stage = _FunctionStage()
        stage.label, stage.requirements = label, tuple(requirements)
        stage.transform = function
        return stage


class _FunctionStage(Stage):
    pass


def chain(df: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        df = df.transform(stage)
    return df
