"""Model answers as tables: JSON retrieval and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.contracts import (
    ANALYSIS_FIELDS, ANALYSIS_PRIORITIES, ANALYSIS_RISK_LEVELS, CORRELATION_FIELDS,
)
from threatlake.functions.documents import document_text
from threatlake.operators.alerts import check_documents, codes, not_one_of, outside

ANALYSIS_DOCUMENT = (
    "risk_level string, confidence double, why_suspicious array<variant>, recommended_actions array<variant>, "
    "mitre_context map<string, variant>, investigation_priority string"
)
CORRELATION_DOCUMENT = "related boolean, confidence double"


def analysis_checks() -> Column:
    return codes(
        (not_one_of("risk_level", ANALYSIS_RISK_LEVELS), "risk_level"),
        (outside("confidence", 0.0, 1.0), "confidence"),
        *[(F.col(f"__doc.{f}").isNull(), f) for f in ("why_suspicious", "recommended_actions", "mitre_context")],
        (not_one_of("investigation_priority", ANALYSIS_PRIORITIES), "investigation_priority"),
    )


def correlation_checks() -> Column:
    return codes((F.col("__doc.related").isNull(), "related"), (outside("confidence", 0.0, 1.0), "confidence"))


def extract_documents(answers: DataFrame, text: str = "text") -> DataFrame:
    """Add ``document``: the JSON object found in each answer, NULL when there is none."""
    return answers.withColumn("document", document_text(F.col(text)))


def validate_analyses(answers: DataFrame, text: str = "text") -> DataFrame:
    found = extract_documents(answers, text)
    return check_documents(found, F.col("document"), ANALYSIS_DOCUMENT, ANALYSIS_FIELDS, analysis_checks())


def validate_correlations(answers: DataFrame, text: str = "text") -> DataFrame:
    found = extract_documents(answers, text)
    return check_documents(found, F.col("document"), CORRELATION_DOCUMENT, CORRELATION_FIELDS, correlation_checks())
