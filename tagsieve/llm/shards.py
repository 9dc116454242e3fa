"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; a node weighs what its shards weigh together.
A row descends level by level: every child of the current node draws -ln(u) / weight from
a hash of the row's key and the child's name, and the smallest draw wins, so a child gets
rows in proportion to its weight. A draw depends on that child alone. When weights change,
a row moves only if a node on its path loses to a node whose weight changed: movement stays
within subtrees whose weights change. ``grow`` adds a shard as a region of its own, hence
rows move only into the new shard.

``slots`` numbers the rows of each shard from 0 without gaps. Repeated rows are counted
before the shuffle, groups are dealt by a hash into buckets of bounded size, and bucket
offsets come from running sums over the bucket counts; no task sees a whole shard.

Defined cases: a null key hashes like any other value and all null keys share a shard;
null texts have size 8 and the CRC of nothing; equal rows get different slots of the
same shard; an empty table gives no rows. Extra columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.llm.common import stored

#: Rows that a numbering task handles at a time, about.
BUCKET_ROWS = 1_000
#: Copies of one row that one output list may hold.
REPEAT_CHUNK = 10_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def layout(count: int, per_rack: int = 4, racks_per_region: int = 3) -> tuple[Shard, ...]:
    """Equal shards 0 to count - 1, filled rack by rack."""
    found = []
    for i in range(count):
        rack = i // per_rack
        found.append(Shard(i, f"region{rack // racks_per_region}", f"rack{rack}"))
    return tuple(found)


def grow(shards: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a new region."""
    number = max((s.number for s in shards), default=-1) + 1
    return (*shards, Shard(number, f"added{number}", f"added{number}", weight))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _nodes(children: list[tuple[str, float, int]]) -> str:
    parts = [f"named_struct('name', {_text(n)}, 'weight', {float(w)!r}D, 'number', {i})" for n, w, i in children]
    return f"array({', '.join(parts)})"


def _winner(key: Column, children: Column) -> Column:
    """The child with the smallest draw; equal draws go to the earlier child."""

    def draw(child: Column, place: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11)
        uniform = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct(
            (-F.log(uniform) / child["weight"]).alias("draw"), place.alias("place"), child["number"].alias("number")
        )

    return F.array_min(F.transform(children, draw))


def shard_of(df: DataFrame, key: str, shards: tuple[Shard, ...], name: str) -> DataFrame:
    """df with an int column ``name``: the shard of each row. Shards of weight 0 get none."""
    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    regions = sorted({s.region for s in live})
    racks = [sorted({s.rack for s in live if s.region == r}) for r in regions]
    leaves = [[[s for s in live if (s.region, s.rack) == (r, k)] for k in racks[i]] for i, r in enumerate(regions)]
    by_region = [(r, sum(s.weight for rack in leaves[i] for s in rack), i) for i, r in enumerate(regions)]
    by_rack = [
        [(f"{r}/{k}", sum(s.weight for s in leaves[i][j]), j) for j, k in enumerate(racks[i])]
        for i, r in enumerate(regions)
    ]
    by_shard = [[[(f"shard{s.number}", s.weight, s.number) for s in rack] for rack in region] for region in leaves]
    region, rack = f"__llm_region_{name}", f"__llm_rack_{name}"
    rack_table = F.expr(f"array({', '.join(_nodes(x) for x in by_rack)})")
    leaf_table = F.expr(f"array({', '.join('array(' + ', '.join(_nodes(x) for x in y) + ')' for y in by_shard)})")
    return (
        df.withColumn(region, _winner(F.col(key), F.expr(_nodes(by_region)))["number"])
        .withColumn(rack, _winner(F.col(key), rack_table[F.col(region)])["number"])
        .withColumn(name, _winner(F.col(key), leaf_table[F.col(region)][F.col(rack)])["number"].cast("int"))
        .drop(region, rack)
    )


def slots(rows: DataFrame, shard: str, shard_count: int) -> DataFrame:
    """rows with a column slot: 0 to n - 1 within each shard.

    rows are narrow: every column takes part in the order, and equal rows are counted
    before they move."""
    columns = rows.columns
    n = rows.count()
    buckets = max(1, -(-n // (shard_count * BUCKET_ROWS)))
    hashed = F.xxhash64(*[F.col(c) for c in columns])
    groups = (
        rows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("__llm_n"))
        .withColumn("__llm_hash", hashed)
        .withColumn("__llm_bucket", F.pmod(F.col("__llm_hash"), F.lit(buckets)))
    )
    place = [shard, "__llm_bucket"]
    counts = groups.groupBy(*place).agg(F.sum("__llm_n").alias("__llm_all"))
    order = Window.partitionBy(shard).orderBy("__llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(shard).alias("__llm_shard"),
        F.col("__llm_bucket").alias("__llm_at"),
        F.coalesce(F.sum("__llm_all").over(order), F.lit(0)).alias("__llm_offset"),
    )
    inner = (
        Window.partitionBy(*place).orderBy("__llm_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = groups.withColumn("__llm_start", F.coalesce(F.sum("__llm_n").over(inner), F.lit(0)))
    joined = numbered.join(
        offsets, (F.col(shard) == F.col("__llm_shard")) & (F.col("__llm_bucket") == F.col("__llm_at"))
    )
    start = F.col("__llm_offset") + F.col("__llm_start")
    last = F.col("__llm_n") - 1
    chunks = joined.select(
        *columns, start.alias("__llm_first"), last.alias("__llm_last"),
        F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(REPEAT_CHUNK).cast("long"))).alias("__llm_chunk"),
    )
    end = F.least(F.col("__llm_last"), F.col("__llm_chunk") + (REPEAT_CHUNK - 1))
    return chunks.select(
        *columns, "__llm_first", F.explode(F.sequence(F.col("__llm_chunk"), end)).alias("__llm_i")
    ).select(*columns, (F.col("__llm_first") + F.col("__llm_i")).alias("slot"))


def measured(df: DataFrame, text: str) -> DataFrame:
    """df with size (UTF-8 bytes of the text plus 8) and text_crc32 (unsigned)."""
    data = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("size", F.octet_length(data).cast("long") + 8).withColumn(
        "text_crc32", F.crc32(data.cast("binary"))
    )


def assign(df: DataFrame, key: str, text: str, shards: tuple[Shard, ...]) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row: the law is
    ``key``, and grown_shard is the shard after ``grow``."""
    rows = measured(df.select(F.col(key), F.col(text).alias("__llm_text")), "__llm_text").drop("__llm_text")
    rows = shard_of(rows, key, shards, "shard")
    rows = shard_of(rows, key, grow(shards), "grown_shard")
    # narrow rows, stored once for the three steps that number them
    numbered = slots(stored(rows), "shard", len(shards))
    return numbered.withColumn("law", F.lit("key"))
