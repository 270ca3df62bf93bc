"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, quality, secrets, simhash, substring, suffixarray, urls
from .decontaminate import op7_benchmark_decontamination
from .langid import op10_language_id
from .pieces import op2_sentencepiece
from .quality import op3_quality_rules, quality_base_columns
from .secrets import op1_secret_scan, secret_base_spans
from .simhash import op8_simhash
from .substring import op5_substring_dedup
from .suffixarray import op4_suffix_array_dedup
from .tokens import op6_token_file
from .urls import op9_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_sentencepiece,
        op3_quality_rules,
        op4_suffix_array_dedup,
        op5_substring_dedup,
        op6_token_file,
        op7_benchmark_decontamination,
        op8_simhash,
        op9_url_filters,
        op10_language_id,
        # those parts of operators without SQL that SQL can express
        secret_base_spans,
        quality_base_columns,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_array_dedup": suffixarray.ORACLE,
    "op5_substring_dedup": substring.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op8_simhash": simhash.ORACLE,
    "op9_url_filters": urls.oracle(),
    "secret_base_spans": secrets.BASE_ORACLE,
    "quality_base_columns": quality.BASE_ORACLE,
}
