"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inferweave.llm.fingerprints import op5_fingerprints
from inferweave.llm.html_extract import op4_html_extract
from inferweave.llm.line_dedup import OP7_ORACLE, op7_line_dedup
from inferweave.llm.media import op6_media
from inferweave.llm.mixing import OP8_ORACLE, op8_mixing
from inferweave.llm.near_dedup import OP9_ORACLE, op9_near_dedup
from inferweave.llm.sentencepiece_bpe import op1_sentencepiece
from inferweave.llm.sharding import op10_sharding
from inferweave.llm.toxicity import op3_toxicity
from inferweave.llm.warc import OP2_ORACLE, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_warc": op2_warc,
        "op3_toxicity": op3_toxicity,
        "op4_html_extract": op4_html_extract,
        "op5_fingerprints": op5_fingerprints,
        "op6_media": op6_media,
        "op7_line_dedup": op7_line_dedup,
        "op8_mixing": op8_mixing,
        "op9_near_dedup": op9_near_dedup,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_ORACLE, "op7_line_dedup": OP7_ORACLE, "op8_mixing": OP8_ORACLE, "op9_near_dedup": OP9_ORACLE}
