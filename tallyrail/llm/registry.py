"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op1_cross_polytope
from .lines import OP7_SQL, op7_site_line_dedup
from .minhash import op2_bbit_minhash
from .packing import op3_best_fit_packing
from .pieces import op10_piece_encoding
from .quotes import op4_quotation_linking
from .quality import op6_weak_label_quality
from .repeats import op8_column_wise_repeats
from .sharding import op9_rendezvous_sharding
from .tiff import op5_tiff_pages


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_cross_polytope, op2_bbit_minhash, op3_best_fit_packing, op4_quotation_linking, op5_tiff_pages, op6_weak_label_quality, op7_site_line_dedup, op8_column_wise_repeats, op9_rendezvous_sharding, op10_piece_encoding]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_site_line_dedup": OP7_SQL}
