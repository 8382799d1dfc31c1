"""Token ids as Parquet list columns (operator 2).

write() puts one row for each document into Parquet files in ascending order of its id: the id, the number of
tokens and the ids as a list column. Ids are dictionary-coded: pages hold bit-packed indices into one
dictionary a row group, which the vocabulary bounds; row groups and pages have set sizes, and the files carry
column and page indexes, so a reader takes single columns, row groups and pages. The id column is delta-coded.

Documents are dealt by ranges of their ids and sorted within them; files follow one another. The position of
a document in the whole stream is the total of the files before it (one number a file) plus the
running total within its file.
Null text is empty and has the end id alone. Rows with equal ids follow one another; a null id comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubespan.llm._shared import small_batches

SCHEMA = "part int, place long, doc_id long, n_tokens long, ids array<int>"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SCHEMA in ascending order of the ids: part and place give the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cubespan.llm import _text
        from cubespan.llm._tokens import encoder

        coder, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            _, bytes_off = _text.utf8(b.column(1))
            for i, j in _text.parts(bytes_off, 4 << 20):
                ids, off = coder.encode(b.column(1).slice(i, j - i))
                n = np.diff(off) + 1
                end = off[1:] + np.arange(1, len(off))
                flat = np.full(len(ids) + len(n), end_id, np.uint32)
                keep = np.ones(len(flat), bool)
                keep[end - 1] = False
                flat[keep] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(place + np.arange(len(n))), b.column(0).slice(i, j - i), pa.array(n), lists], names=["part", "place", "doc_id", "n_tokens", "ids"])
                place += len(n)

    small_batches(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the files; an existing path is an error."""
    options = {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#place": "false",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.writer.version": "v2",
        "parquet.page.write-checksum.enabled": "true",
    }
    encode(docs, tokenizer, end_id, doc_id, text).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What write() wrote. Selections of columns and ranges of doc_id reach the files."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(stored: DataFrame) -> DataFrame:
    """(part, place, doc_id, n_tokens, start). Reads the numbers only, not the ids."""
    own = stored.select("part", "place", "doc_id", "n_tokens")
    totals = own.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = totals.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return own.withColumn("within", within).join(before, "part").select("part", "place", "doc_id", "n_tokens", (F.col("before") + F.col("within")).alias("start"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """DIGEST of every document, from the files: ids_crc32 is the checksum of its ids as little-endian 32-bit integers.

    A file is read in its order, so the position within it is a running total; totals of the files come from
    the number column alone, one row a file.
    """
    stored = read(spark, path)
    small_batches(stored)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = totals.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            off = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(lists.values.to_numpy().astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    summed = stored.mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return summed.withColumn("within", within).join(before, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
