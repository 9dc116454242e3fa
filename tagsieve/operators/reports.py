"""Tables over the results: filters, summaries, tag counts and the brief."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import text
from tagsieve.session import stored

REPORT = ["doc_id", "arquivo"]
TABLE_COLUMNS = ["arquivo", "trecho", "similaridade", "tags_preditas", "confianca", "numero_tags", "revisar"]


def results_table(results: DataFrame, arquivo: str | None = None, only_tagged: bool = True) -> DataFrame:
    """The displayed columns, for one report or all, with or without untagged chunks."""
    rows = results.select(*TABLE_COLUMNS)
    if arquivo is not None:
        rows = rows.filter(F.col("arquivo") == arquivo)
    return rows.filter("tags_preditas is not null") if only_tagged else rows


def report_names(results: DataFrame) -> DataFrame:
    return results.select("arquivo").distinct().orderBy("arquivo")


def result_summary(results: DataFrame) -> DataFrame:
    """(n_trechos, n_revisar, confianca_media); the mean is null without rows."""
    return results.agg(
        F.count(F.lit(1)).alias("n_trechos"),
        F.coalesce(F.sum(F.col("revisar").cast("bigint")), F.lit(0)).alias("n_revisar"),
        F.avg("confianca").alias("confianca_media"),
    )


def first_rows(results: DataFrame, n: int = config.SCREEN_ROWS) -> DataFrame:
    """The ``n`` most confident rows (a screenful)."""
    return results.orderBy(F.desc("confianca"), "arquivo", "trecho_id").limit(n)


def report_coverage(reports: DataFrame, results: DataFrame) -> DataFrame:
    """(n_com_resultado, n_relatorios, n_trechos)."""
    found = results.agg(
        F.countDistinct("arquivo").alias("n_com_resultado"), F.count(F.lit(1)).alias("n_trechos")
    )
    total = reports.agg(F.count(F.lit(1))).scalar()
    return found.select("n_com_resultado", total.alias("n_relatorios"), "n_trechos")


def report_status(chunk_counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, arquivo, n_trechos, n_candidatos, status) for every report."""
    found = candidates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_candidatos"))
    joined = chunk_counts.join(found, "doc_id", "left").withColumn(
        "n_candidatos", F.coalesce("n_candidatos", F.lit(0))
    )
    status = (
        F.when(F.col("n_trechos") == 0, "sem trechos")
        .when(F.col("n_candidatos") == 0, "sem candidatos")
        .otherwise("classificado")
    )
    return joined.select(*REPORT, "n_trechos", "n_candidatos", status.alias("status"))


def report_tag_counts(results: DataFrame, group: Sequence[str] = tuple(REPORT)) -> DataFrame:
    """(group..., tag, n): chunks per predicted tag."""
    tags = F.explode_outer(text.split_predicted(F.col("tags_preditas"))).alias("tag")
    rows = results.select(*group, tags).filter("tag is not null")
    return rows.groupBy(*group, "tag").agg(F.count(F.lit(1)).alias("n"))


def _absent(results: DataFrame, known: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., ausentes): known tags the group never uses, sorted, as one array.

    Each group gathers its distinct tags only, at most the label list.
    """
    everything = known.select(F.array_sort(F.collect_set("tag"))).scalar()
    used = results.select(*group, F.explode_outer(text.split_predicted(F.col("tags_preditas"))).alias("tag"))
    per_group = used.groupBy(*group).agg(F.collect_set("tag").alias("used"))
    return per_group.select(*group, F.array_except(everything, F.col("used")).alias("ausentes"))


def absent_tags(results: DataFrame, known: DataFrame, group: Sequence[str] = tuple(REPORT)) -> DataFrame:
    """(group..., tag): known tags that do not occur in the group."""
    rows = _absent(results, known, group).select(*group, F.explode_outer("ausentes").alias("tag"))
    return rows.filter("tag is not null")


def brief_evidence(
    results: DataFrame,
    group: Sequence[str] = tuple(REPORT),
    top: int = config.BRIEF_TOP_CHUNKS,
    max_chars: int = config.BRIEF_CHUNK_CHARS,
) -> DataFrame:
    """(group..., pos, trecho_id, trecho, tags_preditas, confianca, confianca_pct): the
    most confident tagged chunks of each group, texts cut to ``max_chars``."""
    ties = ["arquivo", "trecho_id"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("confianca"), *ties))
    tagged = results.filter("tags_preditas is not null").withColumn("pos", place).filter(F.col("pos") <= top)
    return tagged.select(
        *group,
        "pos",
        "trecho_id",
        F.substring("trecho", 1, max_chars).alias("trecho"),
        "tags_preditas",
        "confianca",
        text.percent_text(F.col("confianca")).alias("confianca_pct"),
    )


def brief_inputs(results: DataFrame, known: DataFrame, group: Sequence[str] = tuple(REPORT)) -> DataFrame:
    """One row per group: totals, tag counts, absent tags and evidence, as sorted arrays.

    An empty ``group`` takes all reports as one. Every array is short: tags are
    at most the label list, evidence at most the top chunks. Four steps read the
    results, so the needed columns are stored first.
    """
    group = list(group)
    needed = ["doc_id", "arquivo", "trecho_id", "trecho", "tags_preditas", "confianca", "revisar"]
    if not group:
        needed, group = [*needed, F.lit("todos").alias("grupo")], ["grupo"]
    results = stored(results.select(*needed))
    totals = results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.col("revisar").cast("bigint")).alias("n_revisar")
    )
    counted = report_tag_counts(results, group).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "tag"))).alias("tags")
    )
    counted = counted.select(
        *group, F.transform("tags", lambda t: F.struct(t.tag.alias("tag"), (-t.minus).alias("n"))).alias("tags")
    )
    evidence = brief_evidence(results, group).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("pos", "trecho", "tags_preditas", "confianca_pct"))).alias("evidencias")
    )
    return (
        totals.join(counted, group, "left")
        .join(_absent(results, known, group), group, "left")
        .join(evidence, group, "left")
    )


def _lines(items: Column, line, empty: str) -> Column:
    joined = F.array_join(F.transform(items, line), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, joined).otherwise(F.lit(empty))


def brief_text(inputs: DataFrame, title: Column) -> DataFrame:
    """Add ``texto``: the brief of each group as formatted text."""
    tags = _lines(
        F.col("tags"),
        lambda t: F.concat(F.lit("* "), t.tag, F.lit(" - "), t.n.cast("string"), F.lit(" chunk(s)")),
        "* no tag was found",
    )
    absent = _lines(F.col("ausentes"), lambda t: F.concat(F.lit("* "), t), "* every known tag occurs")
    evidence = _lines(
        F.col("evidencias"),
        lambda e: F.concat(
            F.lit('* "'), e.trecho, F.lit('"\n  '), e.tags_preditas, F.lit(" at "), e.confianca_pct
        ),
        "* no chunk was tagged",
    )
    return inputs.withColumn(
        "texto",
        F.concat(
            F.lit("Report: "),
            title,
            F.lit("\nChunks classified: "),
            F.col("n_total").cast("string"),
            F.lit("\nChunks to review: "),
            F.col("n_revisar").cast("string"),
            F.lit("\n\nTags found\n"),
            tags,
            F.lit("\n\nKnown tags that do not occur\n"),
            absent,
            F.lit("\n\nStrongest evidence\n"),
            evidence,
        ),
    )
