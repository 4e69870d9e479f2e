"""Question hygiene (op 5) and the rule-based query rewrite (op 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_query as _normalize


def valid_questions(questions: DataFrame, col: str = "question") -> DataFrame:
    """Drop null, empty and whitespace-only questions (narrow filter)."""
    return questions.filter(~is_blank(F.col(col)))


def normalize_query(questions: DataFrame, col: str = "question", out: str = "query") -> DataFrame:
    """Add the search query for each question (narrow projection)."""
    return questions.withColumn(out, _normalize(F.col(col)))
