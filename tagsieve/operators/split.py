"""Train/test splits in a repeatable random order.

Rows are ordered by a keyed hash of their id, so membership does not depend on
partitioning and can be recomputed after a lost executor.

The tag-preserving split is a walk over the rows in that order, which moves a row to the
test set while every tag it carries keeps ``min_train`` training rows. Only the
last ``min_train`` rows of a tag can be refused: at any earlier row, enough rows
of the tag are still to come. All others are accepted at once, and the test set is the
first part of what was accepted.

Nobody walks, though. A row that may be refused demands, for each of its tags, that enough
rows before it were refused. With some decided, the refused ones before a row are the least
that number can be, and those with the undecided ones the most. A row whose demands the least
meets is accepted, one with a demand that the most misses is refused, and every
round decides all such rows of all tags at once, by sums per demand. The first undecided row is always among
them, so the rounds end with the walk's own result; they are as many as the longest chain of rows
that wait for each other, few unless tags are nested on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve import config
from tagsieve.session import stored


def order_hash(row_id: Column, seed: int = config.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def _cutoff(rows: DataFrame, target: int) -> tuple[str, str] | None:
    """(hash, row_id) of the ``target``-th row in hash order, of the last row if
    there are fewer, or None for none.

    The leading hash digits cut the order into ranges of about equal size. Counting
    them finds the range that holds the row, and only that range is ranked.
    """
    digits = len(f"{config.RANK_BUCKETS - 1:x}")
    bucketed = rows.select("row_id", "_hash", F.substring("_hash", 1, digits).alias("_bucket"))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_bucket"))
    last = F.sum("_n").over(Window.partitionBy())
    holding = (
        counts.select("_bucket", "_n", (F.least(F.lit(target), last) - (upto - F.col("_n"))).alias("_rank"))
        .filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n")))
        .first()
    )
    if holding is None:
        return None
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", "row_id"))
    ranked = bucketed.filter(F.col("_bucket") == holding["_bucket"]).withColumn("_place", place)
    row = ranked.filter(F.col("_place") == holding["_rank"]).first()
    return row["_hash"], row["row_id"]


def _upto(cutoff: tuple[str, str] | None) -> Column:
    if cutoff is None:
        return F.lit(False)
    return F.struct("_hash", "row_id") <= F.struct(*[F.lit(part) for part in cutoff])


def _test_size(rows: DataFrame, test_size: float) -> int:
    return round(rows.count() * test_size)


def random_split(rows: DataFrame, test_size: float = config.TEST_SIZE, seed: int = config.SEED) -> DataFrame:
    """``rows`` (with string ``row_id``) plus ``is_test``, with an exact test size."""
    hashed = rows.withColumn("_hash", order_hash(F.col("row_id"), seed))
    cutoff = _cutoff(hashed, _test_size(rows, test_size))
    return hashed.withColumn("is_test", _upto(cutoff)).drop("_hash")


_OPEN, _REFUSED, _ACCEPTED = 0, 1, 2


def _waiting_rows(hashed: DataFrame, min_train: int) -> DataFrame:
    """(row_id, place, tags, demands): the rows that may be refused, their place in the order, and for each tag
    with a demand how many rows with it must have been refused before."""
    tagged = hashed.select("row_id", "_hash", "tags", F.explode_outer("tags").alias("tag")).filter("tag is not null")
    # The limit on the rank is applied before the shuffle too, so a tag that
    # nearly every row carries sends only a few rows per task.
    from_end = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("_hash"), F.desc("row_id")))
    last = tagged.withColumn("_from_end", from_end).filter(F.col("_from_end") <= min_train)
    demand = F.struct("tag", (min_train + 1 - F.col("_from_end")).alias("needed"))
    rows = last.groupBy("_hash", "row_id", "tags").agg(F.collect_list(demand).alias("demands"))
    return rows.select("row_id", F.struct("_hash", "row_id").alias("place"), "tags", "demands")


def _round(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(row_id, state) of the waiting rows after one more round."""
    before = rows.join(states, "row_id").select(
        F.explode("tags").alias("_tag"), F.col("place").alias("_place"), F.col("state").alias("_state")
    )
    open_rows = rows.join(states.filter(F.col("state") == _OPEN), "row_id")
    demands = open_rows.select("row_id", "place", F.inline("demands"))
    # at most min_train demands meet the rows of a tag, and sums are combined before the shuffle
    earlier = demands.join(before, (F.col("tag") == F.col("_tag")) & (F.col("_place") < F.col("place")), "left")
    counted = earlier.groupBy("row_id", "tag", "needed").agg(
        F.count_if(F.col("_state") == _REFUSED).alias("least"),
        F.count_if(F.col("_state") <= _REFUSED).alias("most"),
    )
    decided = counted.groupBy("row_id").agg(
        F.when(F.bool_or(F.col("most") < F.col("needed")), _REFUSED)
        .when(F.bool_and(F.col("least") >= F.col("needed")), _ACCEPTED)
        .otherwise(_OPEN)
        .alias("state")
    )
    return states.filter(F.col("state") != _OPEN).unionByName(decided)


def _refused(hashed: DataFrame, min_train: int) -> DataFrame:
    """Rows the walk leaves in the training set to protect one of their tags. A refused row leaves one
    more training row to every tag it carries."""
    rows = stored(_waiting_rows(hashed, min_train))
    states = stored(_round(rows, rows.select("row_id", F.lit(_OPEN).alias("state"))))
    while not states.filter(F.col("state") == _OPEN).isEmpty():
        states = stored(_round(rows, states))
    return states.filter(F.col("state") == _REFUSED).select("row_id")


def tag_preserving_split(
    rows: DataFrame,
    test_size: float = config.TEST_SIZE,
    seed: int = config.SEED,
    min_train: int = config.MIN_TRAIN_PER_TAG,
) -> DataFrame:
    """``rows`` (with string ``row_id`` and ``tags``) plus ``is_test``. Rows without tags may always move."""
    hashed = rows.withColumn("_hash", order_hash(F.col("row_id"), seed))
    # every step below reads these, the texts only the last one
    slim = stored(hashed.select("row_id", "_hash", "tags"))
    refused = _refused(slim, min_train)
    accepted = slim.join(refused, "row_id", "left_anti")
    cutoff = _cutoff(accepted, _test_size(slim, test_size))
    flagged = hashed.join(refused.withColumn("_refused", F.lit(True)), "row_id", "left")
    is_test = F.col("_refused").isNull() & _upto(cutoff)
    return flagged.withColumn("is_test", is_test).select(*rows.columns, "is_test")
