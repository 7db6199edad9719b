"""Tables that count every batch once, whatever is retried.

A batch is written to a folder of its own and enters the table when its manifest entry does; readers go by the manifest
alone. A batch number that has an entry is not written again, and what a failed attempt left behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "batch string, folder string, rows long"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, a row per committed batch; a path without one is an empty table."""
    try:
        return spark.read.schema(ENTRY).option("recursiveFileLookup", True).json(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ENTRY)
        raise


def commit(batch: DataFrame, path: str, number: int | str, partition_by: Sequence[str] = ()) -> bool:
    """Write a numbered batch into the table at ``path`` unless it is there; True if this call wrote it.

    Rows are written first, then the entry that names their folder: one small file, moved into place by Spark's own job
    commit. A call that ends in between leaves an unnamed folder, and the next call with that number writes it again.
    One writer per table at a time, and one ``partition_by`` for all its batches.
    """
    spark, path = batch.sparkSession, path.rstrip("/")
    if not _entries(spark, path).where(F.col("batch") == str(number)).isEmpty():
        return False
    folder = f"data/batch={number}/attempt={uuid.uuid4().hex}"
    batch.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    n = spark.read.schema(batch.schema).parquet(f"{path}/{folder}").count()  # from the footers
    spark.createDataFrame([(str(number), folder, n)], ENTRY).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{number}")
    return True


def committed(spark: SparkSession, path: str, schema: StructType, with_batch: bool = False) -> DataFrame:
    """The table's rows as its manifest names them; with_batch adds the number they came with."""
    path = path.rstrip("/")
    whole = StructType(schema.fields).add("batch", "string").add("attempt", "string")
    folders = [e.folder for e in _entries(spark, path).where("rows > 0").select("folder").collect()]  # one per batch
    rows = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], whole)
    return rows.select(*schema.names, *(["batch"] if with_batch else []))
