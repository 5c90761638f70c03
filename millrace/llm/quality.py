"""Quality: a classifier from trusted good texts and unlabelled web text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.llm import positive_unlabelled as pu

PARTS, HELD_OUT = 4, 2
#: Strength of the pull of weights to 0.
DECAY = 1e-3


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; see ``positive_unlabelled.classify``."""
    return pu.classify(docs, labels, "quality", PARTS, HELD_OUT, DECAY)
