"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP3_SQL, op3_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .language import op9_language
from .licenses import OP6_SQL, op6_licenses
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .multi_index import op4_neighbours
from .near_dedup import op1_near_dedup
from .packing import op2_packing
from .personal_data import op5_personal_data
from .pieces import op11_sentencepiece
from .sharding import op8_sharding
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_neighbours": op4_neighbours,
    "op5_personal_data": op5_personal_data,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_language": op9_language,
    "op10_line_dedup": op10_line_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op6_licenses": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
