"""Shared folders, blocks of documents, lookups with hot keys and packed integers."""

from __future__ import annotations

import ctypes
import math
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespan.sources.folders import new_path

U64 = np.uint64
try:
    _libc: ctypes.CDLL | None = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _libc = None
#: Bytes of text in a block of documents, and about as much in a bucket of hashes.
BLOCK_BYTES = 8 << 20
#: Bytes of an Arrow batch between Spark and Python. Spark's own bound would let a few long texts or messages fill an executor's memory beside its heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read again, so that nothing before it is ever run again."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.options(**options).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cubespan_path = path
    return out


def small_batches(df: DataFrame) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless they are smaller already; a batch has one row at least."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def release(encoders: bool = False) -> None:
    """Gives freed memory back to the machine. Python workers stay after a task, and several of an executor would each keep what the largest block took, and the encoders of an operator before, unless encoders."""
    if not encoders and (tokens := sys.modules.get("cubespan.llm._tokens")):
        tokens._loaded.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def freed(f: Callable) -> Callable:
    """A function of a group, or of two that meet, that calls release() when it is done. Spark looks at the number of its arguments."""
    if f.__code__.co_argcount == 3:

        def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = f(key, left, right)
            release()
            return out

        return both

    def one(key: tuple, part: pa.Table) -> pa.Table:
        out = f(key, part)
        release()
        return out

    return one


def remove(*tables: DataFrame) -> None:
    """Deletes tables of table() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cubespan_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def row_hash(df: DataFrame) -> Column:
    """A hash of the row; maps can't be hashed and don't count."""
    return F.xxhash64(F.lit(0), *(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()))


def look_up(rows: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of small, a row for each key with __n: how many rows have it (total of all).

    A key that has a large share of the rows would go to one task. At most 4 x shuffle partitions keys have
    1 / (4 x shuffle partitions) of the rows or more, so these can be broadcast; the others are joined by key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col("__n") * 4 * parts >= max(1, total)
    more = [c for c in small.columns if c not in (key, "__n")]
    known = small.where(hot).select(key, F.struct(*more).alias("__more"))
    met = rows.join(F.broadcast(known), key, "left")
    cold = met.where("__more IS NULL").drop("__more").join(small.where(~hot).drop("__n"), key, how)
    return met.where("__more IS NOT NULL").select(*rows.columns, *(F.col(f"__more.{c}").alias(c) for c in more)).unionByName(cold)


def block_count(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes of text the documents make: it grows with the input."""
    small_batches(docs)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def with_block(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(blk, doc_id, text): rows are dealt by id and text, so neither one id nor one text can fill a block alone.

    Rows that are equal in both stay together; they are the same document twice. Callers deal blk over n tasks, so
    that a task has a block or a few whatever the size of the input.
    """
    row, body = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return docs.select(F.pmod(F.xxhash64(row, body), F.lit(n)).cast("int").alias("blk"), row.alias("doc_id"), body.alias("text"))


def packed_blocks(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(blk, docs): with_block() with all rows of a batch that go to one block in one compressed record batch, so that less is shuffled. unpacked() opens them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))
        for b in batches:
            blk = b.column(0).to_numpy()
            order = np.argsort(blk, kind="stable")
            used, first = np.unique(blk[order], return_index=True)
            out = []
            for rows in np.split(order, first[1:]) if len(used) else []:
                sink = pa.BufferOutputStream()
                own = b.select(["doc_id", "text"]).take(pa.array(rows))
                with pa.ipc.new_stream(sink, own.schema, options=options) as writer:
                    writer.write_batch(own)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out, pa.binary())], names=["blk", "docs"])
        release()

    return with_block(docs, doc_id, text, n).mapInArrow(run, "blk int, docs binary")


def unpacked(column: pa.ChunkedArray) -> pa.Table:
    """(doc_id, text) of all record batches of packed_blocks()."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in column.to_pylist()])


def pack(*columns: np.ndarray) -> bytes:
    """Equally long columns of 64-bit integers as byte planes, without the planes that are zero throughout."""
    out = [struct.pack("<IB", len(columns[0]), len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c).view(U64)
        top = int(c.max()) if len(c) else 0
        k = (top.bit_length() + 7) // 8
        out += [bytes([k]), c.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    """The columns of pack(), as unsigned integers."""
    n, count = struct.unpack_from("<IB", raw)
    at, out = 5, []
    for _ in range(count):
        k = raw[at]
        c = np.zeros((n, 8), np.uint8)
        if k and n:
            c[:, :k] = np.frombuffer(raw, np.uint8, n * k, at + 1).reshape(k, n).T
        out.append(c.reshape(-1).view(U64))
        at += 1 + n * k
    return out


def pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """As pack(), with ascending keys as differences."""
    return pack(np.diff(keys, prepend=U64(0)) if len(keys) else keys, *columns)


def unpack_sorted(raw: bytes) -> list[np.ndarray]:
    keys, *rest = unpack(raw)
    return [np.cumsum(keys, dtype=U64), *rest]


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending keys (one more at the end). A bucket is an equal range of hashes."""
    edges = np.array([((b << 64) + buckets - 1) // buckets for b in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def as_ids(column) -> np.ndarray:
    """Document ids as 64-bit integers. A null id counts as the largest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pc.fill_null(column.cast(pa.int64()), (1 << 63) - 1).to_numpy(zero_copy_only=False), np.int64)
