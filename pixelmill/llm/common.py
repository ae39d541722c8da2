"""What several operators share: shared folders, lineage cuts, columns of unknown presence."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill import session

#: Bytes of the batches that Spark and a Python worker exchange: both hold some at a time.
BATCH_BYTES = 4 << 20
JSON_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def ship(spark: SparkSession) -> SparkSession:
    """Workers can import this package, and get their rows in batches of bounded size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default; a caller's own choice stands
        spark.conf.set(key, str(BATCH_BYTES))
    return session.ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a temporary one where that is unset and all run on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Table:
    """A DataFrame written as Parquet to the shared folder, dropped by hand once nothing reads it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_REMEMBERED: dict[str, dict] = {}


def remembered(name: str) -> dict:
    """A table that this process keeps between tasks of one kind."""
    return _REMEMBERED.setdefault(name, {})


def _forget(keep: str | None) -> None:
    for name, table in _REMEMBERED.items():
        if name != keep:
            table.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where there is one
    if trim:
        trim(0)


def tidied(run: Callable, keep: str | None = None) -> Callable:
    """A task's function that begins and ends with what its worker remembers of other kinds forgotten, and gives memory back:
    workers are reused and idle ones live on, next to the stages that follow. keep: the table for the next task of this kind."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget(keep)
        try:
            yield from run(batches)
        finally:
            _forget(keep)

    return whole


def text_or_empty(df: DataFrame, col: str = "text"):
    return F.coalesce(df[col].cast("string"), F.lit(""))
