"""The contract queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiver.llm import chat_format, phrases, url_filters, warc
from quiver.llm.chat_format import op7_chat_formatting
from quiver.llm.decontamination import op9_benchmark_decontamination
from quiver.llm.licenses import op1_license_scan
from quiver.llm.minhash_dedup import op8_minhash_near_dedup
from quiver.llm.mixing import op4_source_mixing
from quiver.llm.periodic_runs import op12_periodic_runs
from quiver.llm.phrases import op13_phrase_collocations
from quiver.llm.spotsigs import op10_document_fingerprints
from quiver.llm.substring_dedup import op3_substring_dedup
from quiver.llm.suffix_array_dedup import op6_suffix_array_dedup
from quiver.llm.toxicity import op2_toxicity
from quiver.llm.url_filters import op11_url_filters
from quiver.llm.warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_warc": op5_warc,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_url_filters": op11_url_filters,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: Operators without an entry here are tested against brute force or by round trips in tests/llm.
ORACLE: dict[str, str] = {
    "op5_warc": warc.ORACLE_SQL,
    "op7_chat_formatting": chat_format.ORACLE_SQL,
    "op11_url_filters": url_filters.ORACLE_SQL,
    "op13_phrase_collocations": phrases.ORACLE_SQL,
}
