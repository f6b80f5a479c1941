"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: \x20 and \x09-\x0D, which is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns by name; empty batches are skipped."""
    names = [x.name for x in _struct(schema)]
    types = [_arrow(x.dataType) for x in _struct(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=names)
        give_back()

    return df.mapInArrow(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo mod, as a Column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in spark.checkpoint.dir, so that a lost executor costs no recomputation.

    The directory is the one the cluster names. Where it is unset, a session within one
    process, as in tests, gets a temporary one; any other has to name one that its
    executors share.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^,]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df from a Parquet table in the folder of checkpoints, which is smaller than a checkpoint where rows are many and short."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(df.sparkSession.range(1))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, partitions: int, column: str) -> DataFrame:
    """df by hash of a column, from files, such that grouping by that column needs no further shuffle.

    What adaptive execution plans has no known partitioning, so it is off for this one job.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df.repartition(partitions, column))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column; one scan of that column."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def tasks_for(spark: SparkSession, size: int, each: int) -> int:
    """How many partitions hold `size` bytes in shares of about `each`, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


_held: dict[tuple, object] = {}


def held(make: Callable, *args):
    """make(*args), kept for this worker's later tasks of the same kind; a worker keeps one such thing at most."""
    key = make, args
    if key not in _held:
        give_back()
        _held[key] = make(*args)
    return _held[key]


def give_back() -> None:
    """Lets go of what this worker holds and returns freed memory to the system; workers are used again, also by other
    operators, and else keep it for later tasks."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Bytes of the rows that a task sends to Python at a time.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """From here on the session sends Python batches of about BATCH_BYTES, unless it names a limit of its own.

    Spark's own limits let a batch have 10,000 rows, and a task then holds some 20 MB of texts
    several times over outside the heap, which the JVM doesn't give back to the system. What
    the operators return doesn't depend on how rows are batched.
    """
    if spark.conf.get(name := "spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def in_shares(column: pa.Array, rows: int) -> Iterator[list]:
    """The values of a column, so many at a time: as Python objects, a whole batch of texts is as large again."""
    return (column.slice(i, rows).to_pylist() for i in range(0, len(column), rows))
