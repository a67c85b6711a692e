"""A sink for reply streams with two phases: Spark data source ``replies``.

Tasks write parquet files nobody looks for. When all tasks of a batch are done, the names of their files become the
manifest of that batch, written under another name first and then renamed. Readers take the files of the manifests. So a
task that was killed after writing, a second attempt of it, or a batch that runs again after its commit leave files but
no second copy.

``path`` is a folder that pyarrow's file systems can open from all machines.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from relaylog.sources.connections import opened


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class ReplyWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        writer, name, rows = None, f"{uuid.uuid4().hex}.parquet", 0
        try:
            for batch in iterator:
                if writer is None:
                    system.create_dir(f"{root}/data", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=system)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else None, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, root = opened(self.path)
        target = f"{root}/manifest/{batchId}.json"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            return  # The batch was committed before; this attempt's files stay unread.
        system.create_dir(f"{root}/manifest", recursive=True)
        names = [m.name for m in messages if m and m.name]
        with system.open_output_stream(f"{root}/manifest/_{batchId}.json") as f:
            f.write(json.dumps({"files": names, "rows": sum(m.rows for m in messages if m)}).encode())
        system.move(f"{root}/manifest/_{batchId}.json", target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Without a manifest nothing of the batch is read."""


class Replies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replies"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return ReplyWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``writeStream`` know the format ``replies``."""
    spark.dataSource.register(Replies)


def committed_files(path: str) -> list[str]:
    """Files of all committed batches."""
    system, root = opened(path)
    if system.get_file_info(f"{root}/manifest").type == fs.FileType.NotFound:
        return []
    names = []
    for info in system.get_file_info(fs.FileSelector(f"{root}/manifest")):
        if not info.base_name.startswith("_"):
            with system.open_input_file(info.path) as f:
                names += json.loads(f.read())["files"]
    return [f"{path.rstrip('/')}/data/{name}" for name in sorted(names)]


def read_replies(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of committed batches."""
    files = committed_files(path)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
