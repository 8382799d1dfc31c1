"""Mixing sources to target weights (operator 9).

The words of a source, in an order of its documents, are cut into blocks of block_words. A source gets a
target in words: all words of the corpus, shared by weight, a share above most times the source's own words
being cut to that and the excess reshared among the rest. The mix consists of shards of about shard_slots slots.
How many slots of a shard each source gets is a draw: the whole part of its expectation, and of the slots that
are left a multinomial draw by the fractional parts. So the counts of shards, and with them what the mix takes,
depend on the seed, while a source misses its target by a few slots at most. Draws are made for groups of
shards and split down a binary tree within a group, so any shard's counts follow from the seed alone, without
the others. Slot i of a source takes block p(i mod blocks) of its pass i div blocks, where p is a keyed
pseudorandom permutation of the source's blocks that each pass changes; every pass takes every block once, and
slots beyond most passes stay empty. Slots and documents meet by joining on (source, block).

Null text has no words; null source is a source of its own, the last; a null id is an id of its own. Rows with
equal ids are rows of their own; rows that agree in id, source and text can't be told apart and lie in one chunk.
The same rows give the same mix in any order. Columns that the mix doesn't use pass through texts() whatever
their names. The driver holds one row a source, not one a document.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespan.llm import _text
from cubespan.llm._shared import release, row_hash, small_batches, table, whole_row

#: A group of shards draws fewer slots than that, the most that numpy's hypergeometric draw is exact for.
GROUP_SLOTS = 1 << 28
GROUP_SHARDS = 1 << 16


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Words for each source: shares of the total by weight, none above most times its size."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass(frozen=True)
class Draws:
    """How many slots of each shard every source gets. expected: slots of each source in all shards together."""

    expected: tuple[int, ...]
    shards: int
    seed: int

    @property
    def whole(self) -> np.ndarray:
        """Slots that a source has in every shard."""
        return np.array(self.expected, np.int64) // self.shards

    @property
    def rest(self) -> np.ndarray:
        """The expectation of its drawn slots, in all shards together."""
        return np.array(self.expected, np.int64) % self.shards

    def drawn_slots(self, shard: int) -> int:
        """Slots that are drawn in the shards before this one."""
        q = int(self.rest.sum())
        return shard * (q // self.shards) + min(shard, q % self.shards)

    @property
    def group(self) -> int:
        """Shards that are drawn together."""
        return max(1, min(GROUP_SHARDS, GROUP_SLOTS // max(1, -(-int(self.rest.sum()) // self.shards))))

    def of_group(self, g: int) -> np.ndarray:
        lo, hi = g * self.group, min(self.shards, (g + 1) * self.group)
        n, rest = self.drawn_slots(hi) - self.drawn_slots(lo), self.rest
        return np.random.default_rng([self.seed, 1, g]).multinomial(n, rest / rest.sum()) if n else np.zeros_like(rest)

    def before_group(self, g: int) -> np.ndarray:
        return sum((self.of_group(k) for k in range(g)), np.zeros_like(self.rest))

    def totals(self) -> np.ndarray:
        return self.whole * self.shards + self.before_group(-(-self.shards // self.group))

    def of_shard(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Each source's slots before a shard, and in it."""
        g = shard // self.group
        lo, hi = g * self.group, min(self.shards, (g + 1) * self.group)
        before, here = _group_start(self, g)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self.drawn_slots(mid) - self.drawn_slots(lo)
            got = np.random.default_rng([self.seed, 2, lo, hi]).multivariate_hypergeometric(here, left, method="marginals")
            if shard < mid:
                here, hi = got, mid
            else:
                before, here, lo = before + got, here - got, mid
        return before + shard * self.whole, here + self.whole


@functools.lru_cache(16)
def _group_start(draws: Draws, g: int) -> tuple[np.ndarray, np.ndarray]:
    return draws.before_group(g), draws.of_group(g)


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """p(i) for a pseudorandom permutation p of 0..n-1: four rounds of a Feistel network, repeated until the result is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for r in range(4)]
    x, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (_text.mix(right + k) & mask)
        x[todo] = left << shift | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def pass_key(seed: int, source: int, number: int) -> int:
    return (seed * 1_000_003 + source) * 64 + number


def word_count(text: Column) -> Column:
    """The words of a text, 0 for null: white space and a word become one letter each time, and the last word is ours."""
    body = F.concat(F.coalesce(text.cast("string"), F.lit("")), F.lit(" a"))
    return (F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "a")) - 1).cast("long")


def place_documents(sized: DataFrame, chunk_rows: int = 1 << 13) -> DataFrame:
    """sized (doc_id, source, copy, size) with first: the words of its source before it; (source, chunk, place) is a key.

    Rows are dealt into chunks by a hash of all four, whatever their source, so no task orders a whole source.
    """
    n = max(1, math.ceil(sized.count() / chunk_rows))
    own = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "copy", "source", "size"), F.lit(n)).cast("int")).repartition(n, "chunk")
    sums = own.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk")
    sums = sums.select(F.col("source").alias("__s"), F.col("chunk").alias("__c"), (F.sum("words").over(before) - F.col("words")).alias("__before"))
    order = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "copy")
    own = own.withColumn("__inside", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(order))
    joined = own.join(sums, own["source"].eqNullSafe(sums["__s"]) & (own["chunk"] == sums["__c"]))
    return joined.withColumn("first", F.col("__before") + F.col("__inside")).drop("__s", "__c", "__before", "__inside")


class Mix:
    """A drawn mix. documents: (doc_id, source, copy, size, chunk, place, first); sources: Python rows; slots(): the shards."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(1.0, 2.0, 3.0), most: float = 3.0, block_words: int = 128, shard_slots: int = 1 << 14, seed: int = 9) -> None:
        """weights: by position of the source in the order of code points, null last, repeating."""
        small_batches(docs)
        self.spark, self.block_words, self.seed = docs.sparkSession, block_words, seed
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text).cast("string")).alias("copy"), word_count(F.col(text)).alias("size"))
        # Sizes are used three times; texts are read for them once.
        self.documents = table(place_documents(table(rows, "mix-sizes")), "mix-documents")
        rows = self.documents.groupBy("source").agg(F.sum("size").alias("size")).collect()
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
        self.names, sizes = [r.source for r in rows], [r["size"] for r in rows]
        self.sizes = sizes
        self.targets = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], most)
        self.blocks = [-(-s // block_words) for s in sizes]
        #: The most slots that a source can fill.
        self.most = [math.floor(most * b) for b in self.blocks]
        # A pass takes size words by so many slots as there are blocks; the last block can be short.
        expected = [min(m, round(t * b / s)) if s else 0 for t, b, s, m in zip(self.targets, self.blocks, sizes, self.most, strict=True)]
        self.draws = Draws(tuple(expected), max(1, -(-sum(expected) // shard_slots)), seed)

    def slots(self) -> DataFrame:
        """(shard, slot, source_index, pass, block): a slot takes the whole block.

        The planner can't tell how many slots a shard makes and takes this table for small: joins need a hint so that it isn't broadcast.
        """
        draws, blocks, most, seed = self.draws, self.blocks, np.array(self.most, np.int64), self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard in b.column(0).to_pylist():
                    before, here = draws.of_shard(shard)
                    here = np.clip(most - before, 0, here)
                    parts = []
                    for k in np.flatnonzero(here).tolist():
                        i = before[k] + np.arange(here[k])
                        number, inner = i // blocks[k], i % blocks[k]
                        block = np.empty(len(i), np.int64)
                        for p in np.unique(number).tolist():
                            block[number == p] = permuted(inner[number == p], blocks[k], pass_key(seed, k, p))
                        parts.append((np.full(len(i), k), number, block))
                    if parts:
                        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                        order = np.random.default_rng([seed, 3, shard]).permutation(len(columns[0]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), shard)), pa.array(np.arange(len(order))), *(pa.array(c[order], pa.int64()) for c in columns)], names=["shard", "slot", "source_index", "pass", "block"])

        shards = draws.shards if sum(draws.expected) else 0
        made = self.spark.range(0, shards, 1, min(max(1, shards), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return made.mapInArrow(run, "shard long, slot long, source_index long, pass long, block long")

    def source_table(self) -> DataFrame:
        """(source, source_index, source_size, target)."""
        rows = [(n, i, s, float(t)) for i, (n, s, t) in enumerate(zip(self.names, self.sizes, self.targets, strict=True))]
        return self.spark.createDataFrame(rows, "source string, source_index long, source_size long, target double")

    def pieces(self) -> DataFrame:
        """(doc_id, copy, size, source, chunk, place, source_index, source_size, target, block, lo, hi): where a document lies in a block of its source; block is null without words."""
        s = self.source_table().withColumnRenamed("source", "__s")
        d = self.documents.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        width = self.block_words
        d = d.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("size") - 1) / width)))))
        lo = F.greatest(F.col("first") - F.col("block") * width, F.lit(0))
        return d.withColumn("lo", lo).withColumn("hi", F.least(F.col("first") + F.col("size") - F.col("block") * width, F.lit(width)))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken): one row for each row of the documents."""
        uses = self.slots().groupBy("source_index", "block").agg(F.count(F.lit(1)).alias("times"))
        got = self.pieces().join(uses.hint("merge"), ["source_index", "block"], "left")
        keys = ["source", "chunk", "place", "doc_id", "size", "source_size", "target"]
        out = got.groupBy(*keys).agg(F.coalesce(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))), F.lit(0)).cast("long").alias("taken"))
        return out.select("doc_id", "size", "source_size", "target", "taken")

    def texts(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
        """docs as the mix has them: a row for each pass that takes words of a document, with those words as its text.

        docs are those the mix was made of. A document that is taken whole keeps its text; else the runs of
        words that were taken follow one another, a line each. Documents that the mix doesn't take go.
        """
        uses = self.slots().select("source_index", "pass", "block")
        got = self.pieces().join(uses.hint("merge"), ["source_index", "block"])
        start = F.col("block") * self.block_words - F.col("first")
        span = F.struct(F.col("pass"), (start + F.col("lo")).alias("lo"), (start + F.col("hi")).alias("hi"))
        key = ["doc_id", "copy", "source"]
        spans = got.groupBy(*key, "chunk", "place").agg(F.array_sort(F.collect_list(span)).alias("spans"))
        spans = spans.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("chunk", "place")))
        # Rows that agree in id, text and source are interchangeable; the ones that were taken come first.
        own = docs.select(whole_row(docs).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("copy"), F.col(source).cast("string").alias("source"), row_hash(docs).alias("h"))
        own = own.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("h"))).alias("own")
        same = F.expr("own.doc_id <=> s.doc_id AND own.copy = s.copy AND own.source <=> s.source AND own.n = s.n")
        joined = own.join(spans.alias("s"), same).select("own.row", "s.spans")
        names, at = docs.columns, docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = b.column(0).flatten()
                rows, texts = [], []
                for i, (body, spans_) in enumerate(zip(columns[at].to_pylist(), b.column(1).to_pylist(), strict=True)):
                    data, off = _text.utf8(pa.array([body]))
                    starts, ends, _ = _text.words(data, off)
                    raw = data.tobytes()
                    runs: dict[int, list[list[int]]] = {}
                    for s in spans_:
                        mine = runs.setdefault(s["pass"], [])
                        if mine and mine[-1][1] == s["lo"]:
                            mine[-1][1] = s["hi"]
                        else:
                            mine.append([s["lo"], s["hi"]])
                    for p in sorted(runs):
                        whole = runs[p] == [[0, len(starts)]]
                        texts.append(body if whole else "\n".join(raw[starts[a] : ends[z - 1]].decode() for a, z in runs[p]))
                        rows.append(i)
                    if len(texts) >= 4096:
                        yield batch(columns, rows, texts)
                        rows, texts = [], []
                if rows:
                    yield batch(columns, rows, texts)
            release()

        def batch(columns: list, rows: list[int], texts: list[str]) -> pa.RecordBatch:
            out = [c.take(pa.array(rows)) for c in columns]
            out[at] = pa.array(texts, out[at].type)
            if n_chars in names:
                k = names.index(n_chars)
                out[k] = pa.array([len(t) for t in texts]).cast(out[k].type)
            return pa.RecordBatch.from_arrays(out, names=names)

        return joined.mapInArrow(run, docs.schema)
