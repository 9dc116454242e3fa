"""URL filtering against a list of canonical URL prefixes.

A listed rule is a host and a path. It fits its host and all subdomains of it, for paths
that begin with its path. A URL is looked up by host first: under each suffix of its host whose number of
labels occurs in the list. Only suffixes that are listed hosts go on, each with the path lengths listed for
that host, so a URL meets the lengths of its own hosts and not those of the whole list.

Blocked Bloom filters over the listed hosts and over the listed canonical entries pass possible hits: an entry's
hash names one block of 256 bits, and eight bits of a second hash must all be set there.
A filter is a table of at most ``MAX_BLOCKS`` blocks, which bounds what is broadcast; a
larger list makes it less selective, never wrong. Possible hits go to an exact hash join
with the list, which removes false positives. The longest rule wins: by the length of host
and path together, then by the longer host.

The verdict depends on the URL alone, so each URL is looked up once, however many pages
carry it, and pages get it back by a join that Spark can split for a hot URL.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule;
an unlisted URL is allowed; a listed entry twice with different verdicts blocks; null rules
and rules without host are left out; an empty list allows all; repeated pages each return.
Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.llm.common import lower_ascii

BITS_PER_ENTRY = 16
BLOCK_BITS = 256
#: 2^17 blocks of four 64-bit words: 4 MB of bits.
MAX_BLOCKS = 1 << 17
PROBES = 8


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_of(frame: DataFrame) -> DataFrame:
    """(host, path, verdict) of rules written like ``example.org/en/1``; one row per entry.
    frame: rule, verdict."""
    cut = F.instr("rule", "/")
    host = F.when(cut > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))
    path = F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("/"))
    return (
        frame.select(lower_ascii(host).alias("host"), path.alias("path"), "verdict")
        .filter((F.col("host") != "") & F.col("verdict").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )


def _entry(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks)).cast("int")


def _masks(entry: Column) -> list[Column]:
    """The bits of an entry in the four words of its block."""
    second = F.xxhash64(entry, F.lit("bits"))
    words = []
    for w in range(BLOCK_BITS // 64):
        word = F.lit(0).cast("long")
        for i in range(PROBES):
            bit = F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(255)).cast("int")
            one = F.expr("1L")
            here = F.when(F.shiftright(bit, 6) == w, F.call_function("shiftleft", one, bit.bitwiseAND(F.lit(63))))
            word = word.bitwiseOR(here.otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom_filter(entries: DataFrame, entry: str, blocks: int) -> DataFrame:
    """(block, w0 to w3): one row for each block with a bit set."""
    masks = _masks(F.col(entry))
    rows = entries.select(_block(F.col(entry), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(masks))])


def possible(candidates: DataFrame, entry: str, blooms: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose bits are all set. The filter's blocks are broadcast: MAX_BLOCKS rows at most."""
    masks = _masks(F.col(entry))
    marked = candidates.withColumn("__llm_block", _block(F.col(entry), blocks))
    for i, mask in enumerate(masks):
        marked = marked.withColumn(f"__llm_m{i}", mask)
    fits = F.col("__llm_block") == F.col("block")
    for i in range(len(masks)):
        fits = fits & (F.col(f"w{i}").bitwiseAND(F.col(f"__llm_m{i}")) == F.col(f"__llm_m{i}"))
    return marked.join(F.broadcast(blooms), fits, "left_semi").select(*candidates.columns)


def _blocks(entries: int) -> int:
    return min(MAX_BLOCKS, max(1, -(-entries * BITS_PER_ENTRY // BLOCK_BITS)))


def _suffixes(urls: DataFrame, labels: list[int]) -> DataFrame:
    """(host, path, suffix): the ends of each host with these numbers of labels; urls: host, path."""
    parts = F.split(F.col("host"), r"\.", -1)
    each = urls.filter(F.col("host") != "").withColumn("__llm_labels", parts)
    each = each.withColumn("__llm_n", F.explode(F.expr(f"array({', '.join(map(str, labels))})")))
    n = F.col("__llm_n")
    suffix = F.array_join(F.slice("__llm_labels", -n, n), ".")
    return each.filter(F.size("__llm_labels") >= n).select("host", "path", suffix.alias("suffix"))


def _candidates(urls: DataFrame, hosts: DataFrame, labels: list[int], blocks: int) -> DataFrame:
    """(host, path, entry) under every listed host and each path length listed for it. hosts: listed, lengths."""
    known = possible(_suffixes(urls, labels), "suffix", bloom_filter(hosts, "listed", blocks), blocks)
    met = known.join(hosts, F.col("suffix") == F.col("listed"))
    fitting = F.filter("lengths", lambda chars: chars <= F.length("path"))
    each = met.select("host", "path", "suffix", F.explode(fitting).alias("chars"))
    prefix = F.substr(F.col("path"), F.lit(1), F.col("chars"))
    return each.select("host", "path", _entry(F.col("suffix"), prefix).alias("entry"))


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of those distinct (host, path) that a rule fits.

    rules: host, path, verdict, distinct by host and path."""
    listed = rules.select(
        _entry(F.col("host"), F.col("path")).alias("entry"),
        F.col("verdict"),
        F.length(F.col("host")).alias("host_chars"),
    )
    hosts = rules.groupBy(F.col("host").alias("listed")).agg(F.collect_set(F.length("path")).alias("lengths"))
    # host names have at most 127 labels
    labels = [r.n for r in hosts.select(F.size(F.split("listed", r"\.", -1)).alias("n")).distinct().collect()]
    if not labels:
        return urls.limit(0).select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    blocks = _blocks(listed.count())
    candidates = _candidates(urls.select("host", "path").distinct(), hosts, sorted(labels), _blocks(hosts.count()))
    passed = possible(candidates, "entry", bloom_filter(listed, "entry", blocks), blocks)
    hits = passed.join(listed.hint("shuffle_hash"), "entry")
    best = F.max(F.struct(F.length("entry"), "host_chars", "entry", "verdict"))
    return (
        hits.groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", F.col("best.entry").alias("rule"), F.col("best.verdict").alias("verdict"))
    )


def judge(pages: DataFrame, url: str, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule (null: none fits) and verdict, which replace columns of these names.
    rules: rule, verdict."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = verdicts(split.select("host", "path"), rules_of(rules)).select(
        F.col("host").alias("__llm_host"), F.col("path").alias("__llm_path"), "rule", "verdict"
    )
    fits = (F.col("host") == F.col("__llm_host")) & (F.col("path") == F.col("__llm_path"))
    return (
        split.join(found, fits, "left")
        .drop("__llm_host", "__llm_path")
        .withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
    )
