"""Toxicity: a classifier from confirmed toxic texts and unlabelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.llm import positive_unlabelled as pu

PARTS, HELD_OUT = 3, 1
#: Strength of the pull of weights to 0.
DECAY = 1e-3


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; see ``positive_unlabelled.classify``."""
    return pu.classify(docs, labels, "toxic", PARTS, HELD_OUT, DECAY)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic."""
    return pu.below(docs, labels, "toxic", PARTS, HELD_OUT, DECAY)
