"""The queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.audit import OP12_SQL, op12_filter_audit
from panelforge.llm.automaton_dedup import OP6_SQL, op6_automaton_dedup
from panelforge.llm.fingerprints import op8_weighted_fingerprints
from panelforge.llm.jaccard import OP10_SQL, op10_jaccard_join
from panelforge.llm.mixing import op1_temperature_mixing
from panelforge.llm.packing import op5_best_fit_packing
from panelforge.llm.quality import op4_quality_nbsvm
from panelforge.llm.rtree import OP13_SQL, op13_rtree_negatives
from panelforge.llm.sharding import op9_feistel_sharding
from panelforge.llm.suffix_dedup import OP3_SQL, op3_prefix_free_dedup
from panelforge.llm.token_files import op11_wavelet_token_files
from panelforge.llm.topk import OP7_SQL, op7_pivot_topk
from panelforge.llm.toxicity import op2_toxicity_ftrl
from panelforge.session import ship_package


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(ship_package(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _shipped(f) for f in (
    op1_temperature_mixing, op2_toxicity_ftrl, op3_prefix_free_dedup, op4_quality_nbsvm, op5_best_fit_packing, op6_automaton_dedup,
    op7_pivot_topk, op8_weighted_fingerprints, op9_feistel_sharding, op10_jaccard_join,
    op11_wavelet_token_files, op12_filter_audit, op13_rtree_negatives)}
ORACLE_SQL: dict[str, str] = {"op3_prefix_free_dedup": OP3_SQL, "op6_automaton_dedup": OP6_SQL, "op7_pivot_topk": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_rtree_negatives": OP13_SQL}
