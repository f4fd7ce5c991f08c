"""Small shared helpers: tables, the shared scratch folder, Arrow text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a fresh one only in local mode with none configured (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one job in the shared folder, each under a name; what is dropped or written anew frees its space.

    A dropped table is overwritten by an empty one, so that any store that Spark writes to will do.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            self.spark.range(0).write.mode("overwrite").parquet(path)

    def keep(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. For what stays; else Scratch."""
    return Scratch(df.sparkSession).write(name, df)


def text_of(column: str = "text") -> Column:
    """A text column as a string, null as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, d, t, text): all columns of `docs` in one struct, so that no name of theirs meets one of ours (`row.*` is
    docs again); d and t, never null, tell a text of an id, and null ids come first."""
    no_id = F.col("doc_id").isNull()
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), d.alias("d"), F.xxhash64(text_of(), no_id).alias("t"), text_of().alias("text"))


def by_key(keys: DataFrame) -> DataFrame:
    """Keys that whole texts or their runs are joined with: they grow with the texts, so they are merged at every size,
    never sent to every task."""
    return keys.hint("merge")


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id's decimal text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into slices of about `most` text bytes (one document at least).

    Yields (slice, bytes of all texts end to end as uint8, offsets of length rows + 1). A null text has no bytes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            j = min(j, len(col))
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
