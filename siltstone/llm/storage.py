"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: For intermediate tables. Either name of the first, as releases differ: removes a query's shuffle files when the query
#: has ended. Whole texts go to Python in batches of some megabytes.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset: a new one if Spark runs in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scope:
    """A folder for tables that are removed together.

    The folder is a database's, as dropping a database removes its folder wherever Spark can write.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.name, self.folder = spark, f"scratch_{uuid.uuid4().hex[:12]}", None

    def path(self, name: str) -> str:
        if not self.folder:
            self.folder = f"{shared_dir(self.spark)}/{self.name}"
            self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{self.folder}'")
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"

    def remove(self) -> None:
        if self.folder:
            self.spark.sql(f"DROP DATABASE {self.name} CASCADE")
            self.folder = None


_scopes: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables written inside are removed at the end, but for those written with ``outlive``, which belong to the scope around it."""
    own = Scope(spark)
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield own
    finally:
        _scopes.reset(token)
        own.remove()


def new_path(spark: SparkSession, name: str, *, outlive: bool = False) -> str:
    open_ = _scopes.get()[: -1 if outlive else None]
    return open_[-1].path(name) if open_ else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *, outlive: bool = False, into: Scope | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors.

    batch_bytes: of rows that go to Python together, about; unset, as the session has it.
    """
    spark = df.sparkSession
    path = into.path(name) if into else new_path(spark, name, outlive=outlive)
    settings = _SETTINGS | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
