"""Shared plumbing of the training-data operators: stage tables in the shared
folder, bounded bitmaps, and views of Arrow text columns as numpy bytes."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; a longer single text is a pass of its own.
CHUNK_BYTES = 1 << 18


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package (a cluster gets it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.insert(0, root)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; the warehouse, which executors share too, where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (d or spark.conf.get("spark.sql.warehouse.dir") + "/_stages").rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    and a lost executor costs only the running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """A small result of a wide shuffle in an eighth of its partitions, so that it becomes an eighth as many files."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def text_hash(col: Column, seed: int = 0) -> Column:
    """64-bit hash of a text; other seeds give independent hashes. Null counts as empty."""
    return F.xxhash64(F.lit(seed), F.coalesce(col, F.lit("")))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow text column; null is empty."""
    arr = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) \
        else pc.fill_null(column, b"")
    arr = arr.cast(pa.large_binary())
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64, len(arr) + 1 + arr.offset)[arr.offset:] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows whose texts hold about ``limit`` bytes, at least one row each."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def bitmap(df: DataFrame, col: str, bits: int, fold: int = 8) -> np.ndarray:
    """A bit array with bit ``col mod bits`` set for every row of ``df``.

    ``bits`` (a power of two) is fixed by the caller, so what tasks send, what the driver
    receives (at most ``fold`` arrays of bits / 8 bytes) and what is broadcast are bounded
    whatever the input. A set bit may be false; a clear bit is certain."""
    size = bits // 8

    def partial(batches):
        from pyspark import TaskContext
        acc = np.zeros(size, np.uint8)
        some = False
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
            some |= len(x) > 0
            np.bitwise_or.at(acc, (x >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (x & np.uint64(7)).astype(np.uint8)))
        if some:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % fold], pa.int32()),
                                              "bits": pa.array([acc.tobytes()], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size, np.uint8)
        for b in batches:
            for x in b.column(b.schema.get_field_index("bits")):
                acc |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_pydict({"bits": pa.array([acc.tobytes()], pa.binary())})

    rows = (df.select(F.col(col).cast("long").alias("x")).where("x is not null")
            .mapInArrow(partial, "part int, bits binary")
            .groupBy("part").applyInArrow(merge, "bits binary").collect())
    acc = np.zeros(size, np.uint8)
    for r in rows:
        acc |= np.frombuffer(bytes(r.bits), np.uint8)
    return acc


def has_bit(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    i = x.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pow2(n: float, least: int, most: int) -> int:
    """The power of two at or above ``n``, kept between two bounds."""
    return int(min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(1, n))))))))
