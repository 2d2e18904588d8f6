"""The training-data queries by name and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .audit import op13_filter_audit
from .chat import op9_chat_formatting
from .html import op2_html_extraction
from .mixing import op3_mixing
from .ngrams import op6_ngram_jaccard
from .packing import op8_best_fit_packing
from .pieces import op12_pieces
from .quality import op1_quality_rules
from .toxicity import op10_toxicity
from .urls import op5_url_filters
from .variants import op11_spelling_variants
from .vectors import op7_embedding_near_dedup
from .warc import op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_html_extraction, op3_mixing, op4_warc, op5_url_filters, op6_ngram_jaccard, op7_embedding_near_dedup, op8_best_fit_packing, op9_chat_formatting, op10_toxicity, op11_spelling_variants, op12_pieces, op13_filter_audit]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The models, the mix, packing, extraction and propagation are no SQL; tests hold them against brute force."""
    return {"op4_warc": sql.OP4, "op6_ngram_jaccard": sql.OP6, "op7_embedding_near_dedup": sql.OP7, "op9_chat_formatting": sql.OP9, "op11_spelling_variants": sql.OP11, "op13_filter_audit": sql.OP13}
