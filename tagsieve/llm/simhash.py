"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: bit i is 1 if it is 1 in over half of the XXH64 hashes
(seed 42) of the text's three-word shingles, repeats included. Fingerprints that differ in
at most ``distance`` bits are linked, and documents reachable over links form a component.

Equal fingerprints collapse first; all that follows works on distinct ones. The bits are cut
into partitions, correlated bits together. If partition i has threshold t_i (-1: not probed)
and the sum of (t_i + 1) is distance + 1, every linked pair differs in at most t_i bits in
some partition i. Bit frequencies and correlations, counted over all fingerprints, estimate
how many candidates and probes a threshold costs in a partition, and dynamic programming
allocates the unequal thresholds of least cost. Fingerprints are then indexed by their bits in
each probed partition, probes with up to t_i flipped bits look them up, and candidates are
verified by their bit distance.

A crowded key (over ``CROWD`` fingerprints) is not paired out. Its members are linked exactly in
another way: two fingerprints differ in at most two bits if and only if they share a
neighbour that differs from each in at most one, so members emit themselves and their 64
one-bit neighbours, and all that emit the same value are linked to the smallest. A value
has at most 65 emitters, so the work stays linear however many share a key. (For another
distance the neighbourhoods have radius ceil(distance / 2) and links are verified.)

Components come from repeated minimum labels with pointer jumping over the links, each round
written to the shared folder.

Defined cases: texts without words, null ones included, have fingerprint 0 and are linked
like others; texts of fewer than three words are one shingle; null ids count as largest: a
component's id is null only if all its ids are null; repeated rows keep their rows in ``link``
and count as copies in ``keep_one``; an empty table gives no rows. ``keep_one`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.llm.common import released, stored

BITS = 64
SHINGLE = 3
DISTANCE = 2
#: Fingerprints under one key that are paired directly.
CROWD = 32
#: Partition counts that the allocation tries.
PARTITIONS = (1, 2, 3, 4)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    k = min(shingle, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - k + 1].tolist()
    ends = (ends[k - 1 :] - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        some = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in some), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit number."""

    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch), np.uint64, len(batch))
            yield pa.array(found.view(np.int64), pa.int64())

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(printed(batches))

    return simhash(text)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for every two bits, how many have both: 64 x 64 counts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(values), 1 << 15):
                bits = np.unpackbits(values[at : at + (1 << 15)], axis=1, bitorder="little").astype(np.float64)
                both += (bits.T @ bits).astype(np.int64)
            n += len(values)
        place = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(np.append(both.ravel(), n))], names=["place", "n"]
        )

    rows = prints.mapInArrow(partial, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1, np.int64)
    for row in rows:
        out[row.place] = row.n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each starts with the bit that correlates most with all that are
    free and grows by the bit that correlates most with the group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        first = max(free, key=lambda b: (related[b, list(free)].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _near(n: int, both: np.ndarray, group: list[int], t: int) -> float:
    """Estimated share of pairs that differ in at most t bits of the group: a binomial with as many
    independent bits as the variance of the distance tells."""
    x = 2 * both[np.ix_(group, group)].astype(float)
    p = np.diag(both)[group] / max(n, 1)
    sign = 1 - 2 * p
    moment = 1 - 2 * (p[:, None] + p[None, :]) + 2 * x / max(n, 1)
    mean = float(np.sum(2 * p * (1 - p)))
    variance = float(np.sum((moment**2 - np.outer(sign**2, sign**2)) / 4))
    share = mean / len(group)
    if mean <= 0 or share >= 1:
        return 1.0
    trials = min(float(len(group)), max(1.0, len(group) ** 2 * share * (1 - share) / max(variance, 1e-9)))
    limit = t * trials / len(group)
    total, term, k = 0.0, (1 - share) ** trials, 0
    while k <= limit + 1e-9:
        total += term
        term *= (trials - k) / (k + 1) * share / (1 - share)
        k += 1
    return min(1.0, max(total, 2.0 ** -len(group)))


def allocation(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The probed partitions and their thresholds, of least estimated cost: probes plus candidates.
    Dynamic programming over the partitions; the sum of (t + 1) is distance + 1."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in PARTITIONS:
        groups = grouped_bits(n, both, m)
        costs = {0: (0.0, [])}
        for group in groups:
            grown: dict[int, tuple[float, list]] = {}
            for spent, (cost, chosen) in costs.items():
                for t in range(-1, distance + 1):
                    if spent + t + 1 > distance + 1:
                        break
                    probes = 0 if t < 0 else sum(len(list(combinations(range(len(group)), k))) for k in range(t + 1))
                    extra = 0.0 if t < 0 else n * (1.0 + probes) + n * n / 2 * _near(n, both, group, t)
                    now = cost + extra, chosen + ([(group, t)] if t >= 0 else [])
                    if spent + t + 1 not in grown or now[0] < grown[spent + t + 1][0]:
                        grown[spent + t + 1] = now
            costs = grown
        cost, chosen = costs[distance + 1]
        if best is None or cost < best[0]:
            best = cost, chosen
    return best[1]


def _mask(bits: list[int]) -> int:
    """A signed 64-bit number with these bits."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _masks(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' if v >= -(2**63) + 1 else '(-9223372036854775807L - 1L)' for v in values)})")


def _flips(bits: list[int], t: int) -> list[int]:
    return [_mask(list(c)) for k in range(t + 1) for c in combinations(bits, k)]


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: links that connect every two distinct fingerprints within distance, directly
    or over others that are linked. prints: one column fp, distinct."""
    n, both = bit_statistics(prints)
    if n < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    probed = allocation(n, both, distance)
    indexed = probes = None
    for number, (bits, t) in enumerate(probed):
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        part = prints.select(F.lit(number).alias("part"), key.alias("key"), "fp")
        indexed = part if indexed is None else indexed.union(part)
        flipped = prints.select(
            F.lit(number).alias("part"),
            F.explode(F.transform(_masks(_flips(bits, t)), lambda m: key.bitwiseXOR(m))).alias("key"),
            F.col("fp").alias("probe"),
        )
        probes = flipped if probes is None else probes.union(flipped)
    place = ["part", "key"]
    crowded = stored(indexed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).drop("n"))
    quiet = indexed.join(crowded, place, "left_anti")
    near = (
        probes.join(quiet, place)
        .filter((F.col("probe") != F.col("fp")) & (_distance("probe", "fp") <= distance))
        .select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))
    )
    members = probes.join(crowded, place, "left_semi").select(F.col("probe").alias("fp")).distinct()
    return near.union(_crowd_links(members, distance)).distinct()


def _crowd_links(members: DataFrame, distance: int) -> DataFrame:
    """Links among the members over shared neighbours."""
    radius = -(-distance // 2)
    around = members.select(
        F.explode(F.transform(_masks(_flips(list(range(BITS)), radius)), lambda m: F.col("fp").bitwiseXOR(m))).alias("c"),
        "fp",
    )
    if distance == 2 * radius:
        lowest = around.groupBy("c").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
        found = lowest.filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))
        return found.filter(F.col("a") < F.col("b"))
    other = around.select("c", F.col("fp").alias("b"))
    pairs = around.select("c", F.col("fp").alias("a")).join(other, "c").filter(F.col("a") < F.col("b"))
    return pairs.filter(_distance("a", "b") <= distance).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each linked one reaches. edges: a < b."""
    edges = stored(edges)
    both = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "fp"))
    while True:
        seen = both.join(labels, both["a"] == labels["fp"]).select(F.col("b").alias("fp"), "root")
        lowest = labels.union(seen).groupBy("fp").agg(F.min("root").alias("root"))
        ahead = labels.select(F.col("fp").alias("__at"), F.col("root").alias("__ahead"))
        jumped = lowest.join(ahead, F.col("root") == F.col("__at"), "left").select(
            "fp", F.least("root", F.coalesce("__ahead", "root")).alias("root")
        )
        new = stored(jumped)
        before = labels.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"))
        changed = new.join(before, F.col("fp") == F.col("__fp")).filter(F.col("root") != F.col("__root"))
        labels = new
        if changed.isEmpty():
            return labels


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of distinct fingerprints that have a link, with the smallest id.
    prints: fp, id; distinct by fp, id the smallest of the copies."""
    found = components(links(prints.select("fp"), distance))
    joined = found.join(prints, "fp")
    lowest = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    return joined.join(lowest, "root").select("fp", "root", "component_id")


def _distinct(docs: DataFrame, key: str) -> DataFrame:
    return stored(docs.groupBy("__llm_fp").agg(F.min(key).alias("id")).withColumnRenamed("__llm_fp", "fp"))


def link(docs: DataFrame, key: str, text: str, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id) for every document; other columns are not used."""
    prints = stored(docs.select(F.col(key).alias("__llm_key"), fingerprints(F.col(text), shingle).alias("__llm_fp")))
    distinct = _distinct(prints, "__llm_key")
    linked = classes(distinct, distance).withColumnRenamed("fp", "__fp")
    owners = distinct.join(linked, F.col("fp") == F.col("__fp"), "left").select(
        "fp", F.coalesce("component_id", "id").alias("component_id")
    )
    joined = prints.join(owners, F.col("__llm_fp") == F.col("fp"))
    return joined.select(F.col("__llm_key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str, text: str, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: the one with the smallest id, with all its columns.

    Fingerprints are made once and stored with the id and a 128-bit hash of the row. Who stays is decided on
    these; texts meet only the hashes of rows that go, and equal rows, of which one stays, each other."""
    row = ["__llm_x", "__llm_y"]
    columns = [F.col(c) for c in docs.columns]
    named = docs.withColumn(row[0], F.xxhash64(*columns)).withColumn(row[1], F.xxhash64(F.lit(1), *columns))
    prints = stored(named.select(F.col(key).alias("__llm_key"), *row, fingerprints(F.col(text), shingle).alias("__llm_fp")))
    first_of = F.min(F.struct(F.col("__llm_key").isNull().alias("none"), "__llm_key", *row)).alias("first")
    firsts = stored(prints.groupBy(F.col("__llm_fp").alias("fp")).agg(first_of))
    linked = stored(classes(firsts.select("fp", F.col("first.__llm_key").alias("id")), distance))
    stays = linked.join(firsts, "fp").groupBy("root").agg(F.min(F.struct("first", "fp")).alias("best"))
    goes = linked.join(stays, "root").filter(F.col("fp") != F.col("best.fp")).select(F.col("fp").alias("__llm_out"))
    kept = firsts.join(goes, F.col("fp") == F.col("__llm_out"), "left_anti").select(
        F.col("first.__llm_x").alias("__kept_x"), F.col("first.__llm_y").alias("__kept_y")
    )
    going = prints.groupBy(*row).agg(F.count(F.lit(1)).alias("__llm_n"))
    going = going.join(kept, (F.col(row[0]) == F.col("__kept_x")) & (F.col(row[1]) == F.col("__kept_y")), "left")
    marked = stored(going.select(*row, F.col("__kept_x").isNotNull().alias("stays"), (F.col("__llm_n") > 1).alias("again")))
    left = named.join(marked.filter("not stays").select(*row), row, "left_anti")
    again = marked.filter("stays and again").select(*row)
    single, repeated = left.join(again, row, "left_anti"), left.join(again, row, "left_semi")
    return single.union(repeated.dropDuplicates(row)).select(*docs.columns)
