"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm.byte_bpe import op1_byte_bpe
from folio.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from folio.llm.licenses import op5_licenses
from folio.llm.line_dedup import op4_line_dedup
from folio.llm.merkle import op3_merkle
from folio.llm.mixing import OP11_SQL, op11_mixing
from folio.llm.packing import op7_best_fit_packing
from folio.llm.pii import op9_pii
from folio.llm.quality import op2_quality
from folio.llm.simhash import op8_simhash
from folio.llm.spelling import OP13_SQL, op13_spelling
from folio.llm.toxicity import op6_toxicity
from folio.llm.warc_store import OP10_SQL, op10_warc_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_merkle": op3_merkle,
    "op4_line_dedup": op4_line_dedup,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_warc_store": op10_warc_store,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {"op10_warc_store": OP10_SQL, "op11_mixing": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling": OP13_SQL}
