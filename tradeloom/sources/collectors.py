"""Collectors by name: landed files of JSON lines become observations of one shape.

`landed` is a Spark data source: one partition a file, read line by line through pyarrow's file systems, so that local
folders and remote stores will do and no file is held whole. A collector says how its payloads are parsed and which
profile reads their fields; a name that nobody registered is refused before anything is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import payloads
from .payloads import FILER_FIELDS, REGISTRY_FIELDS

SCHEMA = "file string, line bigint, body string"


class UnknownCollector(ValueError):
    pass


@dataclass(frozen=True)
class Collector:
    """parse: rows (body) -> (external_id, content map<string, string>, content_hash); profile: how its fields are read."""

    name: str
    parse: Callable[[DataFrame], DataFrame]
    profile: str | None = None


def hashed(content: Column) -> Column:
    return payloads.content_hash(F.to_json(content, {"ignoreNullFields": "false"}))


def fields_map(names: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))


def registry(rows: DataFrame) -> DataFrame:
    found = payloads.registry(rows.select(F.monotonically_increasing_id().alias("page_id"), "body"))
    return found.select(F.col("cin").alias("external_id"), fields_map([*REGISTRY_FIELDS]).alias("content"), hashed(F.struct(*REGISTRY_FIELDS)).alias("content_hash"))


def filer(rows: DataFrame) -> DataFrame:
    return payloads.submissions(rows).select("external_id", fields_map(["cik", *FILER_FIELDS]).alias("content"), "content_hash")


def census(rows: DataFrame) -> DataFrame:
    return payloads.pattern_rows(rows, 2021).select("external_id", F.col("m").alias("content"), hashed(F.col("m")).alias("content_hash"))


def trade(rows: DataFrame) -> DataFrame:
    """A report's query stands beside its body: {"query": ..., "report": ...}."""
    report = rows.select(F.get_json_object("body", "$.query").alias("query"), F.get_json_object("body", "$.report").alias("body"))
    return payloads.trade_tables(report).select("external_id", F.col("cells").alias("content"), hashed(F.col("cells")).alias("content_hash"))


def manual(rows: DataFrame) -> DataFrame:
    content = rows.select(F.from_json("body", "MAP<STRING, STRING>").alias("content"))
    parts = content.select("content", *[F.try_element_at("content", F.lit(k)).alias(k) for k in ("company_name", "entered_by", "evidence_url")])
    return payloads.manual(parts).select("external_id", "content", hashed(F.col("content")).alias("content_hash"))


def mock(rows: DataFrame) -> DataFrame:
    content = rows.select(F.from_json("body", "MAP<STRING, STRING>").alias("content"))
    return content.select(F.try_element_at("content", F.lit("id")).alias("external_id"), "content", hashed(F.col("content")).alias("content_hash"))


COLLECTORS = {c.name: c for c in (Collector("registry", registry, "registry"), Collector("filer", filer, "filer"), Collector("census", census), Collector("trade", trade), Collector("manual", manual, "manual"), Collector("mock", mock, "mock"))}


def collector(name: str) -> Collector:
    if name not in COLLECTORS:
        raise UnknownCollector(f"no collector is named {name!r}; known are {', '.join(sorted(COLLECTORS))}")
    return COLLECTORS[name]


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LandedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File) -> Iterator[tuple]:
        import io

        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.path) as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as lines:
            for i, line in enumerate(lines):
                if line.strip():
                    yield partition.path, i, line.rstrip("\n")


class Landed(DataSource):
    """Options: path (a URI or an absolute path) and collector."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        collector(self.options.get("collector", ""))
        path = self.options["path"]
        return LandedReader(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_landed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(collector, profile, external_id, content, content_hash) of what a collector landed under `path`."""
    which = collector(name)
    spark.dataSource.register(Landed)
    rows = spark.read.format("landed").option("collector", name).option("path", path).load()
    return which.parse(rows.select("body")).select(F.lit(name).alias("collector"), F.lit(which.profile).alias("profile"), "external_id", "content", "content_hash")
