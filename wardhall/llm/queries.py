"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op4_decontamination
from .jaccard import op1_jaccard_join
from .langid import op6_language_id
from .licenses import op10_license_scan
from .linededup import OP8_SQL, op8_line_dedup
from .lloyd import OP13_SQL, op13_centroid_clustering
from .oracles import OP1_SQL, OP4_SQL, OP5_SQL
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op7_packing
from .pii import op9_pii
from .quality import op3_quality_rules
from .suffixdedup import op5_suffix_dedup
from .toxicity import op2_toxicity
from .vafile import OP11_SQL, op11_topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_license_scan": op10_license_scan,
    "op11_topk_search": op11_topk_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_topk_search": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
