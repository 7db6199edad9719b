"""Session settings used by tests, checks and the benchmark. On a cluster the caller brings the session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lotlens", cpus: int | str | None = None, partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    n = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{n}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(partitions or 8))
             .config("spark.sql.adaptive.enabled", "true")
             # Rule packs compile to wide expressions; above this size the JVM would interpret the fused method.
             .config("spark.sql.codegen.hugeMethodLimit", "8000")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names and all executors share; a local session without one gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lotlens-")


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several consumers read, and go on from the written table.

    Lost executors then re-read files instead of repeating the item-level pass.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lotlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
