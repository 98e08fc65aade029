"""CSV exports in an order, as a data source that appears as a whole or not at all.

Spark sorts into ranges; each task writes its range as a part of its own, and the commit puts a part with the byte-order
mark and the header before them and moves the finished folder into place. Parts joined in the order of their names are the
file that one writer would have written. A failed or aborted write leaves nothing behind.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BOM = b"\xef\xbb\xbf"
NAME = "ordered_csv"


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def encoded(rows: Iterator[Sequence[str]]) -> bytes:
    """Rows as CSV in UTF-8 with CRLF, quoted where they must be."""
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    return out.getvalue().encode()


class OrderedCsvWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite = path.rstrip("/"), columns, overwrite
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        # an attempt writes to a file of its own; only the commit's parts are kept
        store, name = _opened(f"{self.staged}/{context.partitionId():08d}-{context.taskAttemptId()}")
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        rows = 0
        with store.open_output_stream(name) as out:
            for b in iterator:
                columns = [["" if v is None else v for v in c.to_pylist()] for c in b.columns]
                out.write(encoded(zip(*columns, strict=True)))
                rows += b.num_rows
        return Part(context.partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, staged = _opened(self.staged)
        _, final = _opened(self.path)
        store.create_dir(staged, recursive=True)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        keep = {m.path for m in parts if m.rows}
        for found in store.get_file_info(fs.FileSelector(staged)):
            if found.path not in keep:
                store.delete_file(found.path)
        for i, m in enumerate((m for m in parts if m.rows), start=1):
            store.move(m.path, f"{staged}/part-{i:08d}.csv")
        with store.open_output_stream(f"{staged}/part-{0:08d}.csv") as out:
            out.write(BOM + encoded([self.columns]))
        if store.get_file_info(final).type != fs.FileType.NotFound:
            if not self.overwrite:
                store.delete_dir(staged)
                raise FileExistsError(self.path)
            store.delete_dir(final)
        store.move(staged, final)

    def abort(self, messages: list[Part | None]) -> None:
        store, staged = _opened(self.staged)
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class OrderedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> OrderedCsvWriter:
        return OrderedCsvWriter(self.options["path"], schema.names, overwrite)


def write(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence[str | Column], overwrite: bool = False) -> None:
    """A folder of parts: ``columns`` of ``rows`` as text, nulls as '', in ``order`` (make it total to get the same bytes each time)."""
    rows.sparkSession.dataSource.register(OrderedCsv)
    sorted_ = rows.orderBy(*order).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    sorted_.write.format(NAME).option("path", path).mode("overwrite" if overwrite else "append").save()
