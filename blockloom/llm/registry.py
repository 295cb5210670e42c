"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.chat import ORACLE_SQL as CHAT_SQL
from blockloom.llm.chat import op9_chat
from blockloom.llm.fingerprints import op1_fingerprints
from blockloom.llm.html import op8_html
from blockloom.llm.jaccard import ORACLE_SQL as JACCARD_SQL
from blockloom.llm.jaccard import op6_jaccard
from blockloom.llm.licenses import op7_licenses
from blockloom.llm.media import op10_media
from blockloom.llm.packing import op5_packing
from blockloom.llm.pieces import op4_pieces
from blockloom.llm.quality import op3_quality
from blockloom.llm.repeats import ORACLE_SQL as REPEATS_SQL
from blockloom.llm.repeats import op2_repeats


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_repeats": op2_repeats,
        "op3_quality": op3_quality,
        "op4_pieces": op4_pieces,
        "op5_packing": op5_packing,
        "op6_jaccard": op6_jaccard,
        "op7_licenses": op7_licenses,
        "op8_html": op8_html,
        "op9_chat": op9_chat,
        "op10_media": op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_repeats": REPEATS_SQL, "op6_jaccard": JACCARD_SQL, "op9_chat": CHAT_SQL}
