"""Human review: what to look at, what was accepted, and how it is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import text
from tagsieve.operators.labels import latest_by_quotation


def review_queue(
    results: DataFrame, taxonomy: Sequence[str], only_flagged: bool = True, ignore_case: bool = False
) -> DataFrame:
    """Rows to review, with the predicted tags that the taxonomy knows filled in.

    By default spelling must match exactly; with ``ignore_case`` the taxonomy's
    spelling is filled in.
    """
    rows = results.filter("revisar") if only_flagged else results
    known = F.array(*[F.lit(tag) for tag in taxonomy])
    predicted = text.split_predicted(F.col("tags_preditas"))
    if ignore_case:
        lowered = F.array(*[F.lit(tag.lower()) for tag in taxonomy])
        found = F.transform(predicted, lambda tag: F.array_position(lowered, F.lower(tag)).cast("int"))
        filled = F.transform(F.filter(found, lambda i: i > 0), lambda i: F.get(known, i - 1))
    else:
        filled = F.filter(predicted, lambda tag: F.array_contains(known, tag))
    return rows.select(
        "arquivo",
        "trecho",
        F.col("tags_preditas").alias("tag_prevista_pelo_modelo"),
        filled.alias("tags_corrigidas"),
        "confianca",
        F.lit(False).alias("incluir_no_treino"),
    )


def accepted_corrections(edited: DataFrame, reviewed_at: str) -> DataFrame:
    """(quotation, codes, data_revisao) of the rows marked for training that have a tag.

    ``reviewed_at`` is a timestamp text; it is stored to the minute.
    """
    stamp = F.date_format(F.lit(reviewed_at).cast("timestamp"), "yyyy-MM-dd HH:mm")
    chosen = edited.filter(F.col("incluir_no_treino") & (F.size("tags_corrigidas") > 0))
    return chosen.select(
        F.col("trecho").alias("quotation"),
        F.array_join("tags_corrigidas", config.TAG_SEPARATOR).alias("codes"),
        stamp.alias("data_revisao"),
    )


def append_reviews(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Stored reviews without blank rows, followed by the new ones (a bag)."""
    if stored is None:
        return new
    return stored.na.drop("all").unionByName(new, allowMissingColumns=True)


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """(seq, quotation, codes) of pairs (seq, trecho, tags) that have both a text and a tag."""
    good = pairs.filter(F.col("trecho").isNotNull() & (F.col("trecho") != "") & (F.size("tags") > 0))
    return good.select(
        "seq", F.col("trecho").alias("quotation"), F.array_join("tags", config.TAG_SEPARATOR).alias("codes")
    )


def upsert_reviews(stored: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """(quotation, codes, seq): stored reviews with the new pairs on top, latest per quotation.

    The number of saved rows is ``usable_pairs(pairs).count()``: repeats count.
    """
    new = usable_pairs(pairs).withColumn("source", F.lit(1))
    if stored is not None:
        new = stored.select("seq", "quotation", "codes", F.lit(0).alias("source")).unionByName(new)
    keyed = new.withColumn("order", F.col("seq"))
    return latest_by_quotation(keyed).select("quotation", "codes", F.col("order").alias("seq"))
