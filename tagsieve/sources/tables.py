"""Annotated quotations, corrections, labels, frequencies and the tag taxonomy."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.functions import text
from tagsieve.operators.labels import REVIEW_ORDER

QUOTATION_COLUMNS = ("quotation", "codes")

# The tag list offered for corrections, in display order.
TAXONOMY = {
    "Métodos de avaliação": [
        "Estudos de caso",
        "Entrevistas com stakeholders",
        "Pesquisas e questionários",
        "Análise de documentos",
        "Painéis de especialistas",
        "Análise bibliométrica",
        "Altmetria",
        "Métodos de avaliação econômica",
        "Avaliação participativa",
        "Escalas de pontuação e sistemas de classificação",
    ],
    "Categorias de Impacto": [
        "Impacto Instrumental",
        "Impacto Conceitual",
        "Impacto de Construção de Capacidade",
        "Impacto de Construção de Parcerias",
        "Impacto Intrauniversitário",
        "Impacto comunicacional",
        "Impacto Simbólico",
        "Impactos Relacionais/de Rede",
        "Impactos Culturais/Sistêmicos",
        "Efeitos Não Intencionais",
    ],
    "Áreas de Impacto": [
        "Produção Científica e de Conhecimento",
        "Econômica",
        "Ambiental",
        "Saúde e Bem-estar",
        "Política e Governança",
        "Social e Cultural",
        "Tecnologia e Inovação",
        "Organizacional",
        "Educacional",
    ],
    "Engajamento de Stakeholders": [
        "Identificação e Seleção de Stakeholders",
        "Interação Linear",
        "Interação Cíclica",
        "Coprodução",
        "Estratégias de Alinhamento",
        "Capacidade e Prontidão dos Stakeholders",
        "Priorização de Componentes de Avaliação",
        "Coleta de evidências",
        "Avaliação de impacto",
        "Validação e disseminação de resultados",
    ],
    "Nível de Influência Geográfica": [
        "Local",
        "Regional",
        "Nacional",
        "Internacional",
        "Todos os níveis",
    ],
}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV with a header where the path ends in ``.csv``.

    CSV columns are text unless a ``schema`` names their types; quoted cells may
    span lines.
    """
    if PurePosixPath(path).suffix.lower() == ".csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def require_columns(df: DataFrame, names: tuple[str, ...] = QUOTATION_COLUMNS) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def as_quotations(df: DataFrame, position: str = "ref_pos") -> DataFrame:
    """(ref_pos, quotation, codes); other columns are ignored.

    ``position`` names the column that gives the row order. A distributed table
    has no order of its own, so it has to be there.
    """
    require_columns(df, (*QUOTATION_COLUMNS, position))
    return df.select(F.col(position).cast("bigint").alias("ref_pos"), *QUOTATION_COLUMNS)


def as_reviews(df: DataFrame | None, position: str = "seq") -> DataFrame | None:
    """(quotation, codes) and what orders them, or None where there is no usable table of corrections.

    ``position`` names a number that orders the rows, kept as ``seq``; the columns that
    ``sinks.write_reviews`` stores are kept where they are there.
    """
    if df is None or not set(QUOTATION_COLUMNS) <= set(df.columns):
        return None
    stored = [name for name in REVIEW_ORDER if name != "seq" and name in df.columns]
    numbered = position in df.columns and position not in stored
    number = [F.col(position).cast("bigint").alias("seq")] if numbered else []
    return df.select(*number, *QUOTATION_COLUMNS, *stored)


def label_lines(content: DataFrame, column: str = "value") -> DataFrame:
    """(idx, tag): stripped non-blank lines of one text, order kept."""
    lines = F.filter(F.transform(F.split(column, r"\r\n|\n|\r"), text.strip), lambda line: line != "")
    return content.select(F.posexplode(lines).alias("idx", "tag"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label vocabulary from a text file with one tag per line."""
    return label_lines(spark.read.text(path, wholetext=True))


def tag_frequencies(frequencies: DataFrame | None, labels: DataFrame) -> DataFrame:
    """(tag, n) as stored, or the labels with unknown counts."""
    if frequencies is None:
        return labels.select("tag", F.lit(None).cast("bigint").alias("n"))
    return frequencies.select("tag", F.col("n").cast("bigint").alias("n"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(block_pos, block, tag_pos, tag, full_tag) in display order."""
    blocks = F.array(
        *[
            F.struct(F.lit(block).alias("block"), F.array(*[F.lit(tag) for tag in tags]).alias("tags"))
            for block, tags in TAXONOMY.items()
        ]
    )
    per_block = spark.range(1).select(F.posexplode(blocks).alias("block_pos", "entry"))
    return per_block.select(
        "block_pos", F.col("entry.block").alias("block"), F.posexplode("entry.tags").alias("tag_pos", "tag")
    ).withColumn("full_tag", F.concat("block", F.lit(": "), "tag"))


def full_tags() -> list[str]:
    return [f"{block}: {tag}" for block, tags in TAXONOMY.items() for tag in tags]
