"""Reports to rows: paragraphs, chunks, terms.

A report is one row, so its pieces are cut and numbered inside that row: no
window and no shuffle is needed to number them. The explodes are outer ones with
a filter behind: for an inner explode the optimizer adds a "not empty" filter
below, which would cut every text a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import text


#: Parts that the reports of one split are dealt into, and the text that a part holds at most. Text makes some hundred
#: times its size of postings and pairs.
_PARTS_OF_A_SPLIT, _PART_BYTES = 32, 2 << 20


def dealt(reports: DataFrame) -> DataFrame:
    """(doc_id, nome, texto), dealt over the cluster by report.

    Cutting texts costs far more than moving them, and files may come in too few or too large
    splits. What reads them in the same way shares the exchange. What a task makes of a text is a hundred
    times as large, so parts are counted by the splits of the table and by the measured size of its texts, and stay as
    small when it grows: a table ten times as large may have as many splits. There are at least as many parts as the
    cluster has cores. Their number is always given: adaptive execution may merge parts up to its advisory size of texts in
    one task, and what a task makes of 64 MB of text does not fit its memory."""
    texts = reports.select("doc_id", "nome", "texto")
    cores = reports.sparkSession.sparkContext.defaultParallelism
    size = reports.agg(F.sum(F.octet_length("texto").cast("bigint"))).first()[0]
    parts = max(-(-(size or 0) // _PART_BYTES), cores)
    splits = texts.rdd.getNumPartitions()
    if splits >= cores:
        parts = max(parts, splits * _PARTS_OF_A_SPLIT)
    return texts.repartition(parts, "doc_id")


def spread(reports: DataFrame) -> DataFrame:
    """The same rows over at least as many tasks as the cluster has cores.

    For steps that group nothing by report. A large table has more splits than cores and stays as it
    is, without an exchange; only a table in a few splits, cut in fewer tasks than could work,
    is dealt out."""
    cores = reports.sparkSession.sparkContext.defaultParallelism
    return reports if reports.rdd.getNumPartitions() >= cores else reports.repartition(cores)


def report_paragraphs(reports: DataFrame) -> DataFrame:
    """(doc_id, para, paragraph), numbered from 1."""
    blocks = F.posexplode_outer(text.paragraphs(F.col("texto"))).alias("pos", "paragraph")
    return (
        reports.select("doc_id", blocks)
        .filter("paragraph is not null")
        .select("doc_id", (F.col("pos") + 1).alias("para"), "paragraph")
    )


def report_chunks(
    reports: DataFrame,
    max_chars: int = config.MAX_CHARS_CHUNK,
    min_chars: int = config.MIN_CHARS_CHUNK,
) -> DataFrame:
    """(doc_id, arquivo, trecho_id, trecho, n_trechos); numbers start at 1 in every report."""
    cut = reports.select(
        "doc_id",
        F.col("nome").alias("arquivo"),
        text.chunks(F.col("texto"), max_chars, min_chars).alias("pieces"),
    )
    pieces = F.posexplode_outer("pieces").alias("pos", "trecho")
    return (
        cut.select("doc_id", "arquivo", F.size("pieces").alias("n_trechos"), pieces)
        .filter("trecho is not null")
        .select("doc_id", "arquivo", (F.col("pos") + 1).alias("trecho_id"), "trecho", "n_trechos")
    )


def chunk_counts(reports: DataFrame) -> DataFrame:
    """(doc_id, arquivo, n_paragrafos, n_trechos), also for reports without any chunk."""
    # a projection of its own, so that texts are cut into paragraphs once
    cut = reports.select("doc_id", F.col("nome").alias("arquivo"), text.paragraphs(F.col("texto")).alias("_blocks"))
    return cut.select(
        "doc_id",
        "arquivo",
        F.coalesce(F.size("_blocks"), F.lit(0)).alias("n_paragrafos"),
        F.coalesce(F.size(text.pieces(F.col("_blocks"))), F.lit(0)).alias("n_trechos"),
    )


def term_counts(rows: DataFrame, keys: list[str], column: str, bigrams: bool = False) -> DataFrame:
    """(keys..., term, tf): how often every term occurs in a row's text.

    ``keys`` tell the rows apart, so terms are counted inside the row: nothing
    is shuffled. Each step is a projection of its own, as the next one reads the
    list several times.
    """
    listed = rows.select(*keys, text.tokens(F.col(column)).alias("_words"))
    terms = text.with_bigrams(F.col("_words")) if bigrams else F.col("_words")
    ordered = listed.select(*keys, F.sort_array(terms).alias("_words"))
    runs = ordered.select(*keys, "_words", text.run_starts(F.col("_words")).alias("_starts"))
    counts = text.run_counts(F.col("_words"), F.col("_starts"))
    exploded = runs.select(*keys, F.explode_outer(counts).alias("_run")).filter("_run is not null")
    return exploded.select(*keys, "_run.term", F.col("_run.tf").cast("bigint").alias("tf"))
