"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .counts import op3_tokens
from .language import op4_language
from .lines import OP7_SQL, op7_lines
from .merkle import OP12_SQL, op12_merkle
from .neardup import OP8_SQL, op8_minhash
from .packing import op5_packing
from .pii import op11_pii
from .quality import OP9_SQL, op9_quality
from .repair import OP13_SQL, op13_repair
from .substring import op2_windows
from .suffix import OP1_SQL, op1_suffix
from .topk import OP10_SQL, op10_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix": op1_suffix, "op2_windows": op2_windows, "op3_tokens": op3_tokens, "op4_language": op4_language, "op5_packing": op5_packing, "op6_bpe": op6_bpe, "op7_lines": op7_lines, "op8_minhash": op8_minhash, "op9_quality": op9_quality, "op10_topk": op10_topk, "op11_pii": op11_pii, "op12_merkle": op12_merkle, "op13_repair": op13_repair}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix": OP1_SQL, "op7_lines": OP7_SQL, "op8_minhash": OP8_SQL, "op9_quality": OP9_SQL, "op10_topk": OP10_SQL, "op12_merkle": OP12_SQL, "op13_repair": OP13_SQL}
