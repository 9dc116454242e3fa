"""The driver tables as inputs of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import text
from tagsieve.operators import chunks, scoring, similarity
from tagsieve.operators.chunks import term_counts
from tagsieve.plans import analyze
from tagsieve.sources import tables

#: Output labels of the fixed linear model. The last two are spelled differently
#: from the taxonomy, so corrections cannot be filled in for them.
LABELS = [
    *[tag for tag in tables.full_tags() if tag.startswith(("Áreas", "Nível"))],
    "Áreas de impacto: Econômica",
    "Categorias de impacto: Impacto Instrumental",
]
INTERCEPT = -2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("nome"),
        F.col("text").alias("texto"),
        "n_chars",
    )


def spaced_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports with every line break widened to a blank line."""
    return chunks.spread(reports(spark, sf_dir)).withColumn("texto", F.replace("texto", F.lit("\n"), F.lit("\n \n")))


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as reference quotations."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ref_pos"), F.col("text").alias("quotation")
    )


def references(spark: SparkSession, sf_dir: str) -> similarity.References:
    return similarity.prepare_references(quotations(spark, sf_dir))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as annotated quotations, codes with mixed separators and repeats."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    codes = F.concat(
        F.lit("quality "),
        F.col("quality").cast("string"),
        F.lit(" , toxic "),
        F.col("toxic").cast("string"),
        F.lit(";"),
        F.col("lang"),
        F.lit("\t| "),
        F.col("source"),
        F.lit(" ,"),
        F.col("lang"),
        F.lit(";"),
    )
    return tables.as_quotations(
        joined.select(F.col("doc_id").alias("ref_pos"), F.col("text").alias("quotation"), codes.alias("codes"))
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections for the toxic and the low-quality documents."""
    flagged = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0")
    joined = flagged.join(table(spark, sf_dir, "documents"), "doc_id")
    codes = F.when(F.col("toxic") == 1, F.lit("checked ; toxic 1")).otherwise(
        F.concat(F.lit("checked | low quality,"), F.col("lang"))
    )
    return joined.select(F.col("doc_id").alias("seq"), F.col("text").alias("quotation"), codes.alias("codes"))


def fixed_model(spark: SparkSession, sf_dir: str) -> scoring.LinearModel:
    """A linear model over the benchmark's vocabulary. Coefficients between -4 and 4
    come from a hash of term and label position, so SQL can state them too."""
    items = quotations(spark, sf_dir)
    counts = term_counts(items, ["ref_pos"], "quotation", bigrams=True)
    top = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
        .orderBy(F.desc("n"), "term")
        .limit(config.TFIDF_MAX_TERMS)
    )
    total = items.agg(F.count(F.lit(1))).scalar()

    def coefficient(i: int):
        digits = F.substring(F.md5(F.concat(F.col("term"), F.lit(f":{i}"))), 1, 4)
        return (F.conv(digits, 16, 10).cast("int") / 65535.0 - 0.5) * 8.0

    terms = top.select(
        "term",
        (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
        F.array(*[coefficient(i) for i in range(len(LABELS))]).alias("coefs"),
    )
    return scoring.LinearModel(LABELS, terms, [INTERCEPT] * len(LABELS), config.TFIDF_MAX_TERMS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of the documents with the fixed model."""
    return analyze.analyze(
        reports(spark, sf_dir),
        references(spark, sf_dir),
        analyze.linear_scorer(fixed_model(spark, sf_dir)),
        LABELS,
    )


def label_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's labels as known tags, without counts."""
    lines = spark.range(1).select(F.lit("\n".join(LABELS)).alias("value"))
    return tables.tag_frequencies(None, tables.label_lines(lines))


def vector_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, times 8, as logits of 64 tags: (doc_id, trecho_id, label, logits)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.lit(1).alias("trecho_id"),
        "label",
        F.transform("embedding", lambda x: x.cast("double") * 8.0).alias("logits"),
    )


VECTOR_TAGS = [f"tag {i:02d}" for i in range(64)]
