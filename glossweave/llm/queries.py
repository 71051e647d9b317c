"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .crf import op1_html_extraction
from .imatch import OP10_SQL, op10_imatch
from .licenses import OP3_SQL, op3_license_scan
from .mixing import OP4_SQL, op4_mixing
from .packing import op6_packing
from .simhash import op2_simhash_near_dedup
from .substrings import op5_substring_dedup
from .topk import OP8_SQL, op8_exact_topk
from .toxicity import op7_toxicity
from .urls import op9_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_simhash_near_dedup, op3_license_scan, op4_mixing, op5_substring_dedup, op6_packing, op7_toxicity, op8_exact_topk, op9_url_filter, op10_imatch)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": OP3_SQL, "op4_mixing": OP4_SQL, "op8_exact_topk": OP8_SQL, "op10_imatch": OP10_SQL}
