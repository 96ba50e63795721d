"""What the operators of this folder share: the shared scratch folder, Arrow batches, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Rows of a batch that goes to Python: texts may be long, so few of them travel together.
BATCH_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the cluster's shared checkpoint folder.

    Only a session on one machine may lack ``spark.checkpoint.dir``; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/kinchart-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """One Arrow batch in, one out; the batches are small because texts may be very long."""
    _small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)
        forget()

    return df.mapInArrow(run, schema)


def map_partitions(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """A whole partition as a stream of small Arrow batches."""
    _small_batches(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        forget()

    return df.mapInArrow(whole, schema)


# What a worker remembers during a task only: workers are used again by later stages, which have memories of their own.
_MEMORIES: list[dict] = []


def remembered(memory: dict) -> dict:
    """A memory that is emptied at the end of each task."""
    _MEMORIES.append(memory)
    return memory


def forget() -> None:
    for memory in _MEMORIES:
        memory.clear()
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, a null as the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word as a small number, equal words alike, in order of first use."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: numbers that differ in any bit become unrelated."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
