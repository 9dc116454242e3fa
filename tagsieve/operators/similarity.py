"""Stage 1: find the chunks that resemble an annotated quotation.

Term weights are smoothed TF-IDF fitted per report, over the reference
quotations plus that report's own chunks: with ``n`` texts and document
frequency ``df`` the weight is ``tf * (1 + ln((1 + n) / (1 + df)))``. A chunk's
score is the largest cosine with any quotation.

Expanding reports x quotation terms is avoided: writing ``idf = A - l`` with ``A = 1 + ln(1 + n)``
and ``l = ln(1 + df)``, the squared length of a quotation under reference-only frequencies is
``A^2*m0 - 2*A*m1 + m2`` with three per-quotation sums, and a report only corrects the
terms it shares with the quotation. The same joined rows give the dot products, so the
corpus is walked once.

One plan serves every size. Texts are dealt over the cluster by report, once. Every later
grouping is by report and something finer, so it stays in place. Quotations of a measured, small size are
broadcast whatever the session's threshold: with them in a sorted join all postings and all pairs would move. Joins
with larger ones are left to the optimizer, which splits a term or a quotation that most rows share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import text
from tagsieve.operators.chunks import dealt, report_chunks, spread, term_counts

KEYS = ["doc_id", "trecho_id"]


@dataclass(frozen=True)
class References:
    """Annotated quotations prepared for matching."""

    table: DataFrame  # ref_pos, quotation
    postings: DataFrame  # term, ref_pos, ref_tf
    frequencies: DataFrame  # term, df_ref
    moments: DataFrame  # ref_pos, m0, m1, m2
    count: int
    first: int | None  # position of the first quotation


def prepare_references(quotations: DataFrame) -> References:
    """Index (ref_pos, quotation); quotations without text are left out. One small job counts them.

    A posting takes at least four characters, and counts as six numbers, so quotations of a known size
    have a known index; of at most ``BROADCAST_CELLS`` numbers it is broadcast, any other is not."""
    table = quotations.filter(text.present(F.col("quotation"))).select("ref_pos", "quotation")
    length = F.sum(F.octet_length("quotation").cast("bigint") + 1)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.min("ref_pos").alias("first"), length.alias("length")).first()
    postings = term_counts(table, ["ref_pos"], "quotation").withColumnRenamed("tf", "ref_tf")
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df_ref"))
    log_df = F.log(1.0 + F.col("df_ref"))
    square = F.col("ref_tf") * F.col("ref_tf")
    moments = (
        postings.join(frequencies, "term")
        .groupBy("ref_pos")
        .agg(
            F.sum(square.cast("double")).alias("m0"),
            F.sum(square * log_df).alias("m1"),
            F.sum(square * log_df * log_df).alias("m2"),
        )
    )
    tables = [table, postings, frequencies, moments]
    if (size["length"] or 0) * 6 <= config.BROADCAST_CELLS * 4:
        tables = [F.broadcast(x) for x in tables]
    return References(*tables, size["n"], size["first"])


def term_idf(reports: DataFrame, refs: References) -> DataFrame:
    """(doc_id, trecho_id, term, tf, df_doc, df_ref, scale, idf): every chunk
    posting with its report's smoothed weight; ``scale`` is ``1 + ln(1 + n)``."""
    chunks = report_chunks(dealt(reports))
    postings = term_counts(chunks, ["doc_id", "arquivo", "n_trechos", "trecho_id"], "trecho")
    # The report's name adds nothing to the key. It makes this branch read the same
    # columns as the one that returns the texts, so both share one exchange of them.
    in_report = Window.partitionBy("doc_id", "term", "arquivo")
    counted = postings.withColumn("df_doc", F.count(F.lit(1)).over(in_report))
    joined = counted.join(refs.frequencies, "term", "left")
    df_ref = F.coalesce("df_ref", F.lit(0))
    scale = 1.0 + F.log(1.0 + refs.count + F.col("n_trechos"))
    return joined.select(
        *KEYS,
        "term",
        "tf",
        "df_doc",
        df_ref.alias("df_ref"),
        scale.alias("scale"),
        (scale - F.log(1.0 + F.col("df_doc") + df_ref)).alias("idf"),
    )


def chunk_norms(weighted: DataFrame) -> DataFrame:
    """(doc_id, trecho_id, norm): length of every chunk vector."""
    weight = F.col("tf") * F.col("idf")
    return weighted.groupBy(*KEYS).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def similarity_pairs(reports: DataFrame, refs: References, min_similarity: float = 0.0) -> DataFrame:
    """(doc_id, trecho_id, ref_pos, sim) for pairs that share a term and whose
    cosine, rounded to 12 decimals, reaches ``min_similarity``."""
    weight = F.col("tf") * F.col("idf")
    in_chunk = Window.partitionBy(*KEYS)
    weighted = (
        term_idf(reports, refs)
        .withColumn("chunk_norm", F.sqrt(F.sum(weight * weight).over(in_chunk)))
        .filter("df_ref > 0")
    )
    ref_only_idf = F.col("scale") - F.log(1.0 + F.col("df_ref"))
    ref_tf = F.col("ref_tf")
    idf = F.col("idf")
    pairs = (
        weighted.join(refs.postings, "term")
        .groupBy(*KEYS, "ref_pos", "scale", "chunk_norm")
        .agg(
            F.sum(weight * ref_tf * idf).alias("dot"),
            # A term's correction is shared out over the chunks that contain it.
            F.sum(ref_tf * ref_tf * (idf * idf - ref_only_idf * ref_only_idf) / F.col("df_doc")).alias("part"),
        )
    )
    in_report = Window.partitionBy("doc_id", "ref_pos")
    corrected = pairs.withColumn("correction", F.sum("part").over(in_report)).join(
        refs.moments, "ref_pos"
    )
    scale = F.col("scale")
    ref_norm = F.sqrt(
        scale * scale * F.col("m0") - 2.0 * scale * F.col("m1") + F.col("m2") + F.col("correction")
    )
    sim = F.rint(F.col("dot") / (F.col("chunk_norm") * ref_norm) * 1e12) / 1e12
    scored = corrected.select(*KEYS, "ref_pos", sim.alias("sim"))
    return scored.filter(F.col("sim") >= min_similarity) if min_similarity > 0 else scored


#: Positions, moved above zero by the offset, fit below 10^20.
_POSITIONS, _OFFSET = "100000000000000000000", "9223372036854775808"


def _best(pairs: DataFrame) -> DataFrame:
    """One quotation per chunk: highest similarity, then the first quotation. Both are packed into
    one number, so that the maximum is a hash aggregate."""
    units = F.rint(F.col("sim") * F.lit(1e12)).cast("decimal(15,0)")
    place = F.col("ref_pos").cast("decimal(20,0)") + F.expr(f"cast({_OFFSET} as decimal(20,0))")
    packed = (units * F.expr(f"cast('{_POSITIONS}' as decimal(21,0))") - place).cast("decimal(38,0)")
    best = pairs.groupBy(*KEYS).agg(F.max(packed).alias("best"))
    whole = F.expr(f"ceil(best / cast('{_POSITIONS}' as decimal(21,0)))").cast("decimal(17,0)")
    unpacked = best.select(*KEYS, "best", whole.alias("units"))
    position = (
        F.col("units") * F.expr(f"cast('{_POSITIONS}' as decimal(21,0))")
        - F.col("best")
        - F.expr(f"cast({_OFFSET} as decimal(20,0))")
    )
    return unpacked.select(*KEYS, (F.col("units").cast("double") / 1e12).alias("sim"), position.cast("bigint").alias("ref_pos"))


def nearest_reference(reports: DataFrame, refs: References) -> DataFrame:
    """(doc_id, trecho_id, sim, ref_pos) for every chunk; a chunk that shares no
    term with any quotation gets 0 and the first quotation. Only numbers of chunks meet: the texts of this
    branch are cut where they lie."""
    best = _best(similarity_pairs(reports, refs))
    first = F.lit(refs.first).cast("bigint")
    return (
        report_chunks(spread(reports.select("doc_id", "nome", "texto")))
        .select(*KEYS)
        .join(best, KEYS, "left")
        .select(*KEYS, F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("ref_pos", first).alias("ref_pos"))
    )


def chosen(reports: DataFrame, refs: References, threshold: float = config.SIMILARITY_THRESHOLD) -> DataFrame:
    """(doc_id, trecho_id, ref_pos, similaridade): chunks whose best similarity, rounded to four
    decimals, reaches the threshold, without their texts."""
    if refs.count == 0:
        raise ValueError("there is no reference quotation to compare with")
    similarity = text.round4(F.col("sim"))
    if threshold > 0:
        # Half a unit of the fourth decimal below the threshold can still round up to it.
        best = _best(similarity_pairs(reports, refs, max(threshold - 0.0001, 1e-9)))
        best = best.filter(similarity >= threshold)
    else:
        best = nearest_reference(reports, refs)
    return best.select(*KEYS, "ref_pos", similarity.alias("similaridade"))


def candidates(
    reports: DataFrame, refs: References, threshold: float = config.SIMILARITY_THRESHOLD
) -> DataFrame:
    """The ``chosen`` chunks with their texts.

    (doc_id, arquivo, trecho_id, trecho, similaridade, quotation_referencia)
    """
    # A list for each report meets the texts by report, as both lie; by report and chunk both would be dealt again.
    quoted = chosen(reports, refs, threshold).join(refs.table, "ref_pos")
    entry = F.struct("trecho_id", "similaridade", "quotation")
    found = quoted.groupBy("doc_id").agg(F.collect_list(entry).alias("found"))
    # Never null: else the optimizer would cut every text once more for a filter on its pieces below
    # the exchange, and the two branches would not share that.
    pieces = F.coalesce(text.chunks(F.col("texto")), F.array().cast("array<string>"))
    cut = dealt(reports).join(found, "doc_id").select("doc_id", F.col("nome").alias("arquivo"), pieces.alias("pieces"), "found")
    # a repeated report has the list of all its copies, and may have fewer chunks
    listed = cut.select("doc_id", "arquivo", "pieces", F.explode_outer("found").alias("q")).select(
        "doc_id",
        "arquivo",
        F.col("q.trecho_id").alias("trecho_id"),
        F.get("pieces", F.col("q.trecho_id") - 1).alias("trecho"),
        F.col("q.similaridade").alias("similaridade"),
        F.col("q.quotation").alias("quotation_referencia"),
    )
    return listed.filter("trecho is not null")
