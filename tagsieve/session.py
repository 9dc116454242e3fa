"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


#: Settings the plans rely on: sizes measured at run time decide about parts, broadcasts and skew.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app_name: str = "tagsieve", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans rely on; a cluster's own settings are kept."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {**RUNTIME, "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Removed when the process ends.
_local_scratch: list[tempfile.TemporaryDirectory] = []


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir`` and clears it. Only where that is unset
    and Spark runs in local mode is a temporary folder made, which goes with the process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.TemporaryDirectory(prefix="tagsieve-"))
    return _local_scratch[0].name


def fresh_folder(spark: SparkSession) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{scratch_dir(spark)}/run-{uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back.

    Cuts the lineage of a frame that several later steps read; unlike a cache, it
    outlives lost executors, and later reads take only the columns they need.
    """
    path = fresh_folder(rows.sparkSession)
    rows.write.parquet(path)
    # with the schema given, no job looks for it in the files
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
