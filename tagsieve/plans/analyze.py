"""The whole analysis: reports in, tagged chunks out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.operators import scoring, similarity
from tagsieve.session import stored

#: Adds a ``logits`` column to a frame of chunks.
Scorer = Callable[[DataFrame], DataFrame]


def find_candidates(
    reports: DataFrame, refs: similarity.References, threshold: float = config.SIMILARITY_THRESHOLD
) -> DataFrame:
    """Stage 1 for (doc_id, nome, texto)."""
    return similarity.candidates(reports, refs, threshold)


def analyze(
    reports: DataFrame,
    refs: similarity.References,
    scorer: Scorer,
    tags: list[str],
    similarity_threshold: float = config.SIMILARITY_THRESHOLD,
    classification_threshold: float = config.CLASSIFICATION_THRESHOLD,
    review_below: float = config.REVIEW_THRESHOLD,
) -> DataFrame:
    """Every candidate chunk with its prediction, unordered.

    Reports are scored independently, so several reports are simply several rows.
    Input without chunks or candidates gives an empty frame with the full schema.
    """
    found = find_candidates(reports, refs, similarity_threshold)
    return scoring.classify(scorer(found), tags, classification_threshold, review_below)


def linear_scorer(model: scoring.LinearModel) -> Scorer:
    return lambda rows: scoring.score_linear(rows, model)


def ordered(results: DataFrame) -> DataFrame:
    """Results by falling confidence; equal ones by report and chunk.

    A total order first samples its input, and the results are dear to compute, so they are stored before. Of the
    sample only the sort keys are read, and texts are exchanged once, into their range.
    """
    return stored(results).orderBy(F.desc("confianca"), "arquivo", "trecho_id")
