"""What several of the corpus operators share: inputs made safe, and tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters, for trim() and translate().
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: not to be broadcast, however small it is here."""
    return df.hint("merge")


#: Keys that are taken out of a join at most, and rows of a key up to which it stays.
HUBS, HUB_ROWS = 1 << 16, 1024


def join_keys(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` (in all `total`) with the columns of `keyed`, which has one row for each key and in `n` how many
    rows have the key. Keys that more than a HUBS-th of all rows have, so no more than HUBS of them, are broadcast;
    the others are shuffled, and none fills a task."""
    limit = max(HUB_ROWS, total // HUBS)
    columns = [c for c in keyed.columns if c not in (key, "n")]
    hubs = keyed.where(F.col("n") > limit).select(key, *columns, F.lit(True).alias("__hub"))
    known = rows.join(F.broadcast(hubs), key, "left")
    rest = known.where("__hub is null").select(*rows.columns).join(grown(keyed.where(F.col("n") <= limit).select(key, *columns)), key)
    return rest.unionByName(known.where("__hub").select(*rest.columns))


def computed(df: DataFrame) -> DataFrame:
    """The same rows, behind a step that filters aren't pushed through. Spark would compute what a filter
    reads a second time below, and there put whole arrays in the place of columns that a function of their
    elements refers to, which makes work for each element out of work for each row."""
    row = F.explode_outer(F.array(F.struct(*df.columns))).alias("_row")
    return df.select(row).select(*(F.col("_row")[c].alias(c) for c in df.columns))


#: Texts that go to a Python worker at a time.
BATCH_ROWS = 512


def text_batches(df: DataFrame) -> DataFrame:
    """The same rows. Rows that hold whole texts go to Python in smaller batches than Spark's default of
    10,000, of which executor and worker would keep several at a time."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


#: Bytes of a group from which on memory is given back after it.
LARGE = 1 << 22


def give_back() -> None:
    """Return to the system what this Python worker has freed. Workers stay for the next stage, and allocators keep
    what they once had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back when its partition is done."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and the
    master is local (tests), a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Where new scratch folders are noted, while something collects them.
_collecting: ContextVar[list[str] | None] = ContextVar("collecting", default=None)


@contextmanager
def collected_scratch() -> Iterator[list[str]]:
    """The scratch folders that are begun inside. Whoever collects them may delete them with
    `delete_folders` once the results that read them are written."""
    folders: list[str] = []
    token = _collecting.set(folders)
    try:
        yield folders
    finally:
        _collecting.reset(token)


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in the shared folder: each write cuts lineage and survives lost executors. What results still
    read then is deleted when the driver ends, if nobody has deleted it before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if (folders := _collecting.get()) is not None:
            folders.append(self.root)
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        """Write `df` and return the table that was written."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        if self.count == 1:  # only what exists can be marked
            self.fs.deleteOnExit(self.spark._jvm.org.apache.hadoop.fs.Path(self.root))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        # Spark deletes the shuffle files of what was written when the driver collects its garbage
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        delete_folders(self.spark, [df._scratch_path])
