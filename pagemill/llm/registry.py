"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .boilerplate import op3_host_suffix_array
from .codebooks import OP11_SQL, op11_filtering_lloyd
from .infill import OP13_SQL, op13_distinct_text_index
from .packing import op2_harmonic_packing
from .personal import op12_anchor_expansion
from .planes import op1_bit_planes
from .quality import OP8_SQL, op8_rule_cascade
from .quotes import op4_quotation_links
from .secret_scan import op7_recursive_decoding
from .sharding import op6_stratified_shards
from .simhash import op10_simhash_tiles
from .warc import OP5_SQL, op5_index_merge
from .winnowing import OP9_SQL, op9_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bit_planes,
        op2_harmonic_packing,
        op3_host_suffix_array,
        op4_quotation_links,
        op5_index_merge,
        op6_stratified_shards,
        op7_recursive_decoding,
        op8_rule_cascade,
        op9_winnowing,
        op10_simhash_tiles,
        op11_filtering_lloyd,
        op12_anchor_expansion,
        op13_distinct_text_index,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_index_merge": OP5_SQL,
    "op8_rule_cascade": OP8_SQL,
    "op9_winnowing": OP9_SQL,
    "op11_filtering_lloyd": OP11_SQL,
    "op13_distinct_text_index": OP13_SQL,
}
