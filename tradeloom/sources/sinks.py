"""A sink that a repeated run leaves as it was: one partition a run, replaced whole, with the schema checked first."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SchemaChanged(ValueError):
    pass


def plain(schema) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Write `rows` as the partition `run_id` of the table at `path`. A run that is written again replaces its own rows
    and no others, so a job may be started again after any failure; rows of another shape than the table's are refused
    before anything is written. An empty run leaves no rows, of an earlier attempt neither."""
    if not run_id or "run_id" in rows.columns:
        raise ValueError("a run needs an id, and its rows no column run_id")
    try:
        held = plain(rows.sparkSession.read.parquet(path).schema)
    except AnalysisException:
        held = None  # nothing is written yet
    if held is not None and {k: v for k, v in held.items() if k != "run_id"} != plain(rows.schema):
        raise SchemaChanged(f"{path} holds {held}, not {plain(rows.schema)}")
    # Spark replaces exactly this folder; a run's partition is the whole of what it writes
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def runs(spark, path: str) -> DataFrame:
    """The table with its run ids as text."""
    return spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
