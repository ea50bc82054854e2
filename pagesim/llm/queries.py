"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, ship
from . import (
    context_mix, decontaminate, embedding_graph, language, main_text, manifest, periodic_runs, poisson_mix, quality,
    secrets, simhash, surrogates, tokens,
)


def _ready(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(ship(configure(spark)), folder.rstrip("/"))


QUERIES = {
    query.__name__: _ready(query)
    for query in (
        context_mix.op1_context_mix,
        surrogates.op2_pii_surrogates,
        embedding_graph.op3_embedding_graph,
        poisson_mix.op4_poisson_mix,
        language.op5_language_id,
        decontaminate.op6_decontamination,
        tokens.op7_token_counts,
        main_text.op8_main_text,
        secrets.op9_secret_scan,
        simhash.op10_simhash_neardup,
        periodic_runs.op11_periodic_runs,
        manifest.op12_merkle_manifest,
        quality.op13_quality,
    )
}

ORACLE = {
    "op4_poisson_mix": poisson_mix.OP4_SQL.format(docs="documents"),
    "op12_merkle_manifest": manifest.OP12_SQL,
}
