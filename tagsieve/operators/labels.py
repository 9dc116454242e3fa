"""Annotated quotations to tags, vocabulary, frequencies and label matrix.

Tags are free text, so nothing is assumed about their number: rows meet tag tables in
joins, which the optimizer makes broadcasts where the tables are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.functions import text
from tagsieve.operators.ranks import numbered


#: What orders reviews, the strongest first: when they were made, when they were written, their
#: place in what was written, and a number given by the caller.
REVIEW_ORDER = ("data_revisao", "gravado_em", "linha", "seq")
_TYPES = dict(zip(REVIEW_ORDER, ("string", "bigint", "bigint", "bigint")))


def _empty() -> dict[str, Column]:
    """What stands for a missing value, before all others."""
    return {"data_revisao": F.lit(""), **{name: F.lit(-1).cast("bigint") for name in REVIEW_ORDER[1:]}}


def clean_quotations(rows: DataFrame, columns: tuple[str, ...] = ("quotation", "codes")) -> DataFrame:
    """Drop rows where one of the columns is missing, empty or the word "nan"."""
    for name in columns:
        rows = rows.filter(text.present(F.col(name)))
    return rows


def _written(order: dict[str, Column]) -> Column:
    return F.struct(*[value.alias(name) for name, value in order.items() if name != "seq"]).alias("written")


def _originals(quotations: DataFrame) -> DataFrame:
    return quotations.select(
        F.concat(F.lit("o"), F.col("ref_pos").cast("string")).alias("row_id"),
        F.lit(0).alias("source"),
        _written(_empty()),
        F.col("ref_pos").cast("bigint").alias("seq"),
        "quotation",
        "codes",
    )


def _corrections(reviews: DataFrame) -> DataFrame:
    order = {
        name: F.coalesce(F.col(name).cast(_TYPES[name]), value) if name in reviews.columns else value
        for name, value in _empty().items()
    }
    number = F.col("seq").cast("string") if "seq" in reviews.columns else F.lit(None).cast("string")
    unnumbered = F.hex(F.xxhash64("quotation", "codes", _written(order)))
    return reviews.select(
        F.concat(F.lit("r"), F.coalesce(number, unnumbered)).alias("row_id"),
        F.lit(1).alias("source"),
        _written(order),
        order["seq"].alias("seq"),
        "quotation",
        "codes",
    )


def usable_reviews(reviews: DataFrame | None) -> bool:
    return reviews is not None and {"quotation", "codes"} <= set(reviews.columns)


def training_base(quotations: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """(row_id, quotation, codes): annotations with corrections on top.

    ``quotations`` is (ref_pos, quotation, codes); ``reviews`` needs quotation and codes and may
    have any of ``REVIEW_ORDER``, which say what is later. Only when usable reviews are given,
    each quotation is kept once: its latest review, else its last annotation. A reviews table
    without quotation or codes is ignored, and then repeated quotations stay. Reviews that
    nothing orders are told apart by their codes, so the choice is repeatable.
    """
    merged = _originals(quotations)
    if usable_reviews(reviews):
        merged = latest_by_quotation(merged.unionByName(_corrections(reviews)), ("source", "written", "seq"))
    return clean_quotations(merged).select("row_id", "quotation", "codes")


def training_base_in_place(quotations: DataFrame, reviews: DataFrame) -> DataFrame:
    """``training_base`` for reviews that lie by quotation, as a bucketed table does.

    The latest review of each quotation is found where it lies, and the annotations come to it, so the reviews,
    which grow with every round, are never exchanged.
    """

    def last(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("quotation").agg(F.max(F.struct("written", "seq", "row_id", "codes")).alias(name))

    # a missing quotation joins nothing and is dropped at the end, as is an empty one
    both = last(_originals(quotations), "o").join(last(_corrections(reviews), "r"), "quotation", "full_outer")
    chosen = F.coalesce("r", "o")
    merged = both.select(chosen["row_id"].alias("row_id"), "quotation", chosen["codes"].alias("codes"))
    return clean_quotations(merged)


def latest_by_quotation(rows: DataFrame, order: tuple[str, ...] = ("source", "seq")) -> DataFrame:
    """One row per quotation, the last by ``order``.

    An aggregation rather than a window: copies of one text are reduced before the shuffle,
    however many there are. Groups are keyed by a hash first, so that different texts are told
    apart by eight bytes and only equal hashes compare texts.
    """
    rest = [name for name in rows.columns if name not in ("quotation", *order)]
    last = F.max(F.struct(*order, *rest)).alias("last")
    keyed = rows.groupBy(F.xxhash64("quotation").alias("_key"), "quotation").agg(last)
    return keyed.select("quotation", "last.*")


def with_tags(rows: DataFrame) -> DataFrame:
    """Add ``tags``, the list in ``codes`` without repeats."""
    return rows.withColumn("tags", text.split_tags(F.col("codes")))


def tag_frequency(rows: DataFrame) -> DataFrame:
    """(tag, n): number of rows that carry the tag."""
    tags = rows.select(F.explode_outer("tags").alias("tag")).filter("tag is not null")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def by_frequency(frequency: DataFrame) -> DataFrame:
    return frequency.orderBy(F.desc("n"), "tag")


def frequent_tags(frequency: DataFrame, min_count: int = config.MIN_TAG_COUNT) -> DataFrame:
    return frequency.filter(F.col("n") >= min_count)


def rare_tags(frequency: DataFrame, min_count: int = config.MIN_TAG_COUNT) -> DataFrame:
    return frequency.filter(F.col("n") < min_count)


def keep_tags(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Strip the tags that are not in ``kept``; a row, known by ``row_id``, may end with an empty list."""
    single = rows.select("row_id", F.posexplode("tags").alias("_pos", "tag"))
    staying = single.join(kept.select("tag"), "tag").groupBy("row_id")
    lists = staying.agg(F.array_sort(F.collect_list(F.struct("_pos", "tag"))).alias("_kept"))
    joined = rows.join(lists, "row_id", "left")
    tags = F.coalesce(F.col("_kept.tag"), F.array().cast("array<string>"))
    return joined.select(*[tags.alias(name) if name == "tags" else name for name in rows.columns])


def label_vocab(tags: DataFrame, parts: int | None = None) -> DataFrame:
    """(idx, tag) in code-point order, from 0. ``tags`` holds each tag once.

    Tags are numbered by ranges, so no task sees all tags, however alike they begin."""
    return numbered(tags.select("tag"), ["tag"], "idx", parts).select(F.col("idx").cast("int").alias("idx"), "tag")


def label_matrix(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row_id, idx) of the ones of the label matrix; unknown tags are ignored."""
    single = rows.select("row_id", F.explode("tags").alias("tag"))
    return single.join(vocab.select("idx", "tag"), "tag").select("row_id", "idx")


def label_counts(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(idx, tag, n, pos): rows in all and rows with the tag, also for unused tags."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return vocab.join(tag_frequency(rows).withColumnRenamed("n", "pos"), "tag", "left").select(
        "idx", "tag", total.alias("n"), F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos")
    )


def pos_weight(counts: DataFrame, cap: float = config.POS_WEIGHT_CAP) -> DataFrame:
    """Loss weight of positive rows: negatives per positive, between 1 and ``cap``."""
    ratio = (F.col("n") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1))
    weight = F.least(F.greatest(ratio, F.lit(1.0)), F.lit(cap))
    return counts.select("idx", "tag", "pos", (F.col("n") - F.col("pos")).alias("neg"), weight.alias("pos_weight"))


def class_weight(counts: DataFrame) -> DataFrame:
    """Balanced weights n / (2 * rows of the class); null for a class without rows."""
    negatives = F.col("n") - F.col("pos")

    def weight(rows):
        return F.when(rows > 0, F.col("n") / (2.0 * rows))

    return counts.select(
        "idx", "tag", weight(F.col("pos")).alias("weight_pos"), weight(negatives).alias("weight_neg")
    )


def untrained_tags(train_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tags of the vocabulary that no training row carries."""
    return vocab.join(tag_frequency(train_rows), "tag", "left_anti").select("idx", "tag")
