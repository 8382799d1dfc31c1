"""Packing into windows of tokens by minimum bin slack (operator 7).

A document's ids and its end id are cut at multiples of the capacity; full pieces are sequences by
themselves. The rests are packed: the longest one opens a sequence, and a bitset of reachable sums over the
remaining lengths (a length counts as often as it is left, in powers of two) gives the multiset that fills
the sequence closest to capacity; it is traced back through the bitsets. The same multiset is used as often
as the counts allow.

Rests are packed in windows of window rests within a partition, so memory is bounded and nothing is
shuffled; the last sequences of a window can have slack. Sequence ids are unique and follow the partitions.
Null text is empty and still has its end id; a null id stays null, and repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.llm import _shared

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_multiset(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how often) whose sum comes closest to room without exceeding it. Longer lengths are preferred."""
    full = 1 << room
    mask = (full << 1) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        take = 1
        while left > 0:
            k = min(take, left)
            more = reach | (reach << (k * length)) & mask
            if more != reach:
                steps.append((length, k, reach))
                reach = more
            left -= k
            take *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= k * length
    return sorted(chosen.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences as (multiset of lengths, how many such sequences); they use every length counts times."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        rest = best_multiset({k: n for k, n in left.items() if n}, capacity - top)
        left[top] += 1
        used = dict(rest)
        used[top] = used.get(top, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((sorted(used.items(), reverse=True), times))
    return out


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length, and the number of sequences. Equal lengths are used in their order."""
    values, n = np.unique(lengths, return_counts=True)
    order = np.argsort(lengths, kind="stable")
    queues = dict(zip(values.tolist(), np.split(order, np.cumsum(n)[:-1]) if len(values) else [], strict=True))
    used = dict.fromkeys(queues, 0)
    sequence, offset, k = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for multiset, times in plan(dict(zip(values.tolist(), n.tolist(), strict=True)), capacity):
        at = 0
        for length, often in multiset:
            got = queues[length][used[length] : used[length] + often * times].reshape(times, often)
            used[length] += often * times
            sequence[got] = k + np.arange(times)[:, None]
            offset[got] = at + length * np.arange(often)
            at += length * often
        k += times
    return sequence, offset, k


def pack(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, window: int = 1 << 16) -> DataFrame:
    """One row of SCHEMA for each piece. One pass over the documents, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cubespan.llm import _text
        from cubespan.llm._tokens import encoder

        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 33
        made = 0
        rests: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        def flush() -> pa.RecordBatch:
            nonlocal made
            sequence, offset, n = place(np.array([r[2] for r in rests], np.int64), capacity)
            out = batch([(*r, base + made + s, o) for r, s, o in zip(rests, sequence.tolist(), offset.tolist(), strict=True)])
            made += n
            rests.clear()
            return out

        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            _, bytes_off = _text.utf8(b.column(1))
            for i, j in _text.parts(bytes_off, 4 << 20):
                ids, off = encode.encode(b.column(1).slice(i, j - i))
                raw, full = memoryview(ids.astype("<u4").tobytes()), []
                for d, a, z in zip(b.column(0).slice(i, j - i).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    n = z - a + 1
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * min(z, a + start + length)])
                        if start + length == n:
                            crc = zlib.crc32(tail, crc)
                        piece = (d, start, length, crc, n)
                        if length == capacity:
                            full.append((*piece, base + made, 0))
                            made += 1
                        else:
                            rests.append(piece)
                if full:
                    yield batch(full)
                if len(rests) >= window:
                    yield flush()
        if rests:
            yield flush()
        _shared.release(encoders=True)

    _shared.small_batches(docs)
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)
