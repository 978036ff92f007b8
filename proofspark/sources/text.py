"""Inline texts and the gate every text passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proofspark import constants as K
from proofspark.functions.text import is_blank, once


def _split(df: DataFrame, code, stage: str) -> tuple[DataFrame, DataFrame]:
    """Text and code are bound once: a filter on the code would be pushed below a derived text and derive it again."""
    kept = [c for c in df.columns if c != "text"]
    checked = once(df, kept, text=F.col("text"), error_code=code).select(*df.columns, "error_code")
    rejects = checked.where(F.col("error_code").isNotNull()).select(F.lit(stage).alias("stage"), "doc_id", "error_code")
    return checked.where(F.col("error_code").isNull()).drop("error_code"), rejects


def gate_documents(docs: DataFrame, max_chars: int = K.MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): too long, or nothing but white space."""
    code = F.when(F.length("text") > max_chars, "TEXT_TOO_LONG").when(
        is_blank(F.coalesce("text", F.lit(""))), "EXTRACTION_FAILED")
    return _split(docs, code, "gate")


def gate_chunkless(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rejects for documents that yielded no chunk."""
    return docs.join(chunks.select("doc_id").hint("merge"), "doc_id", "left_anti").select(
        F.lit("chunk").alias("stage"), "doc_id", F.lit("EXTRACTION_FAILED").alias("error_code"))


def ingest_text(df: DataFrame, max_chars: int = K.MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pasted texts as documents: blank ones and over-long ones are refused."""
    code = F.when(is_blank(F.coalesce("text", F.lit(""))), "CONFIGURATION_INVALID").when(
        F.length("text") > max_chars, "TEXT_TOO_LONG")
    ok, rejects = _split(df, code, "ingest_text")
    return ok.select(
        "*", F.length("text").alias("char_count"), F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.lit("粘贴文章.txt").alias("original_name"), F.lit("text/plain; charset=utf-8").alias("media_type"),
        F.lit("txt").alias("document_format")), rejects
