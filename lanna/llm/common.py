"""What the operators share: reading tables, the shared folder, batches of rows."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lanna.session import ship

#: Arrow batches end at this many bytes, so that very long texts don't gather in one batch.
BATCH_BYTES = 8 << 20
#: Temporary folders of applications in local mode.
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python functions get, in bytes and rows; a smaller setting of the session stays.  Workers get the code."""
    ship(spark)
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 8192)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset, in local mode, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lanna-")
        atexit.register(shutil.rmtree, folder, True)
        base = _local[spark.sparkContext.applicationId] = f"file://{folder}"
    return f"{base.rstrip('/')}/lanna-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def written(df: DataFrame, codec: str = "zstd", per_file: int = 0) -> DataFrame:
    """`df` written as Parquet to the shared folder, at most `per_file` rows in a file, and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).option("maxRecordsPerFile", per_file).parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_caches: dict[str, Callable[[], None]] = {}
_turn = ""


def take_turn(name: str, clear: Callable[[], None]) -> None:
    """An operator's tables in a worker process begin to be used; those of others, which the process may keep from earlier stages, are emptied."""
    global _turn
    _caches[name] = clear
    if _turn != name:
        for other in [x for x in _caches if x != name]:
            _caches.pop(other)()
        _turn = name
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without it keeps what is freed
            ctypes.CDLL(None).malloc_trim(0)


class Touched:
    """Tells whether a range touches any of some (start, end, ...) ranges, in logarithmic time."""

    def __init__(self, spans: list[tuple]):
        own = sorted(spans)
        self.starts = [x[0] for x in own]
        self.ends = [*accumulate((x[1] for x in own), max)]

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, lengths: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about `most` characters each."""
    start = size = 0
    for k, n in enumerate(lengths):
        size += n
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(lengths):
        yield start, len(lengths)
