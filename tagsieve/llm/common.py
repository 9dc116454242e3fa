"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and their lower case; other letters are never folded.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Column names that the operators use beside the caller's own begin like this.
OWN = "__llm_"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


#: Removed when the process ends.
_local_folders: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder named in spark.checkpoint.dir. Where none is named, one
    process that is driver and executor at once takes a temporary folder, which goes with it; a cluster must
    name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_folders:
            _local_folders.append(tempfile.TemporaryDirectory(prefix="tagsieve-"))
        folder = _local_folders[0].name
    return f"{folder.rstrip('/')}/tagsieve-llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that lost executors
    cost no recomputation and branches share the work."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def released(results: Iterator) -> Iterator:
    """The same results; memory that Arrow keeps for later batches is given back at the end, as workers
    stay and other tasks follow."""
    try:
        yield from results
    finally:
        pa.default_memory_pool().release_unused()
