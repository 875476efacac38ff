"""Helpers shared by the corpus operators: tables, and intermediate results in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Frees a query's shuffle files when the query ends instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch while intermediate tables are written: texts and sets are long, and a batch is held whole.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Joins of a loop's small tables: each table that Spark broadcasts by its size takes megabytes of the driver's heap and a
#: thread, however few its rows.
_SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="loomline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one (local runs only)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder(spark.sparkContext.applicationId)}"


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch, for plans that run after this package has returned them."""
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str, shuffled: bool = False):
        """shuffled: while its tables are written, joins shuffle both sides unless a hint says otherwise."""
        self.spark = spark
        self.settings = {_CLEANUP: "true", _BATCH: str(BATCH_ROWS)} | (_SHUFFLED if shuffled else {})
        self.root = f"{shared_folder(spark)}/loomline/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, light: bool = False) -> DataFrame:
        """Writes df as Parquet and reads it again. Light tables, which hold a few bytes for some of the rows that they
        come from, are written by an eighth of the usual tasks: files and tasks cost more than what is in them."""
        path = f"{self.root}/{name}"
        if light:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        with _set(self.spark, self.settings):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame) -> DataFrame:
        """Saves a result and deletes all the tables that led to it."""
        self.root, before = f"{self.root}-result", self.root
        out = self.save(df, "rows")
        self._delete(before)
        return out

    def drop(self, name: str = "") -> None:
        """Deletes a table that no later step reads, or all of them."""
        self._delete(f"{self.root}/{name}".rstrip("/"))

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Gives memory that is free again back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, which at its end gives memory that is free again back to the system: Python workers
    live on from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def sliced(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values of one binary or string column take at most so many bytes together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = size = 0
    for row, length in enumerate(lengths):
        if size + length > most and row > at:
            yield batch.slice(at, row - at)
            at, size = row, 0
        size += length
    if len(lengths) > at:
        yield batch.slice(at)


def map_column(df: DataFrame, column: str, keep: list[str], added: str, start: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """The columns of `keep`, as they are, and those of the DDL `added`, computed from one column's values.

    start() is called once a task and gives a function from a batch's values to the added columns' values; a kept
    column that it gives too (by name in `added`) is replaced in its place. Batches stay in Arrow, so that other
    columns pass unchanged, whatever their types and nulls.
    """
    new = StructType.fromDDL(added)
    names = {f.name for f in new}
    schema = StructType([*(f if f.name not in names else new[f.name] for f in (df.schema[k] for k in keep)), *(f for f in new if f.name not in keep)])
    arrow = to_arrow_schema(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in (p for whole in batches for p in sliced(whole, whole.num_columns - 1)):
            values = dict(zip((f.name for f in new), compute(batch.column(batch.num_columns - 1).to_pylist())))
            columns = [pa.array(values[f.name], type=f.type) if f.name in values else batch.column(i).cast(f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    _small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{column}`").alias("_value")).mapInArrow(tidy(mapped), schema)


def filter_column(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows, unchanged, whose value of one column passes a test that start() gives once a task."""
    place = df.columns.index(column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = start()
        for batch in (p for whole in batches for p in sliced(whole, place)):
            yield batch.filter(pa.array(test(batch.column(place).to_pylist()), type=pa.bool_()))

    _small_batches(df.sparkSession)
    return df.mapInArrow(tidy(kept), df.schema)
