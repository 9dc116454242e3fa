"""The operators of this package as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.llm import bpe, chat, decontam, linededup, maxent, mtree, negatives, phrases, pii, quality, shards, simhash, urls
from tagsieve.llm.common import held_out, table

#: For tests and examples; a production run passes its own secret.
DEMO_KEY = "example key, not a secret"

URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, "text", DEMO_KEY, "kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"))


#: Scores from here on count as good.
QUALITY_THRESHOLD = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Learned from the labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    return quality.fit(docs, "doc_id", "text", labels, "quality")


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, docs, sf_dir)
    scored = quality.classify(docs, "text", model, QUALITY_THRESHOLD)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, "url", rules).select("page_id", "host", "path", "rule", "verdict")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an event log, one event for each row, and conversation -1."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return rows.union(extra).select(
        "conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg"), F.lit("message").alias("kind"), "role", "text"
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(chat_log(spark, sf_dir))
    read = chats.select(
        "conv_id",
        "formatted",
        chat.parse(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    line = F.lit("\n")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mtree.points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.search(rows, rows.filter(F.col("id") % 50 == 0))


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark")
    found = decontam.mark(docs, "text", items, "item_id", "text")
    hit = F.aggregate("benchmark.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("benchmark.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("benchmark.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("benchmark.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op6_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return maxent.score(docs, "doc_id", "text", held_out(F.col("doc_id"), 7, 2))


def op7_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.link(docs, "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = bpe.encode_and_decode(docs, "text", path)
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_weighted_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.assign(docs, "doc_id", "text", shards.layout(24)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op11_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return phrases.collocations(docs, "text", "lang")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.rows_of(table(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id", "label", "embedding")
    return negatives.mine(rows, rows.filter(F.col("id") % 100 == 0))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated(docs, "doc_id", "text").select(
        "doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2(F.col("deduped.kept").cast("binary"), 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_additive_quality": op2_additive_quality,
    "op3_url_filter": op3_url_filter,
    "op4_mtree_search": op4_mtree_search,
    "op5_wu_manber": op5_wu_manber,
    "op6_hashed_maxent": op6_hashed_maxent,
    "op7_simhash_pigeonhole": op7_simhash_pigeonhole,
    "op8_prefix_bpe": op8_prefix_bpe,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_weighted_tree_shards": op10_weighted_tree_shards,
    "op11_phrase_graph": op11_phrase_graph,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
}
