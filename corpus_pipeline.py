"""Stages that turn documents into a training corpus.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame, which
is written and read again as the next one's docs. All but the last return the columns of docs.

1. quality classifier: rows scored below the threshold go;
2. SimHash near-duplicates: one document of each component stays, the one of the smallest id;
3. benchmark decontamination: rows that hold a window of a benchmark item go;
4. pseudonyms: personal values are replaced; n_chars, where there is one, follows the text;
5. BPE: columns n_tokens, ids (packed little-endian 32-bit) and round_trip (whether decoding
   gives the text back) are added, or replaced where docs has such names.

Null texts are scored, compared and encoded like empty ones and stay null. Rows without id
are kept like others. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.llm import bpe, decontam, pii, quality, queries, simhash
from tagsieve.llm.common import stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.quality_model(spark, docs, sf_dir)
    return docs.filter(quality.score(F.col("text"), model) >= queries.QUALITY_THRESHOLD)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontam.mark(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", out="__llm_hits")
    return marked.filter(F.size("__llm_hits.spans") == 0).select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = pii.pseudonymise(docs, "text", queries.DEMO_KEY)
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = queries.vocabulary_path()
    coded = bpe.encode_and_decode(docs, "text", path, "ids", "__llm_decoded")
    same = F.col("__llm_decoded") == F.coalesce("text", F.lit(""))
    return (
        coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
        .withColumn("round_trip", same)
        .drop("__llm_decoded")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("simhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("feistel pseudonyms", pseudonymise),
    ("bpe encoding and decoding", tokenise),
]

#: Classifier, SimHash groups, keyed pseudonyms and tokens are beyond SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other; steps between are stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
