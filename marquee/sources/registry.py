"""Named extractors and a Python data source for calendar files."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTRACTORS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}


def source(name: str, region: str = "westside"):
    """Register a DataFrame -> DataFrame extractor under a source name."""

    def register(extract: Callable[[DataFrame], DataFrame]):
        EXTRACTORS[name] = (extract, region)
        return extract

    return register


def run_source(name: str, payloads: DataFrame) -> DataFrame:
    """Rows of one source, tagged with its name and region."""
    extract, region = EXTRACTORS[name]
    return extract(payloads).withColumn("source", F.lit(name)).withColumn("region", F.lit(region))


class IcsFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class IcsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(f"{self.path}/*.ics"))
        return [IcsFile(p) for p in found] or [IcsFile("")]

    def read(self, partition: IcsFile) -> Iterator[tuple[str, str]]:
        if partition.path:
            with open(partition.path, encoding="utf-8", newline="") as f:
                yield partition.path, f.read()


class IcsDataSource(DataSource):
    """spark.read.format("ics"): (feed, value) of calendar files on a mounted folder.

    One partition per file; feeds.ics_entries turns the texts into entries.
    """

    @classmethod
    def name(cls) -> str:
        return "ics"

    def schema(self) -> str:
        return "feed string, value string"

    def reader(self, schema) -> DataSourceReader:
        return IcsReader(self.options["path"])
