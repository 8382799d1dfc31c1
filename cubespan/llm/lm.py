"""Deleted interpolation of n-gram models (operator 1).

Tokens are words, with A-Z lowered, and one end token a document. The probability of a token w after v mixes
the maximum-likelihood estimates c(v w) / c(v) and c(w) / N with the uniform 1 / (V + 1). The weights depend
on the bucket of c(v), a power of two; they are learned by expectation-maximisation on training documents
that are held out: counts for that come from the other training documents only. The final model counts all
training documents.

Documents are dealt into blocks. A block asks for the global counts of its distinct n-grams, sorted and
pre-aggregated, from buckets of the hash range; each bucket sums what all blocks sent and answers in their
order. So a frequent n-gram costs one entry a block, and blocks and buckets grow in number with the input; a
block asks only buckets that its n-grams fall into, so it never sends more messages than it has n-grams.
What reaches the driver is three totals and a histogram of log ratios, whose size has a fixed bound.

Null text is empty: it has the end token. A null id counts as the empty text for the fold. Repeated rows are
documents of their own. Without training documents every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.llm import _shared, _text
from cubespan.llm._shared import pack, pack_sorted, table, unpack, unpack_sorted

U64 = np.uint64
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Bigrams are told apart by 56 bits, words by 64. Of 10**12 distinct bigrams one in 70,000 shares its count with another.
PAIR_BITS = U64(0xFFFFFFFFFFFFFF00)
BUCKETS = 40
ASK_SCHEMA = "bucket int, blk int, uni binary, bi binary"
TOLD_SCHEMA = "blk int, bucket int, uni binary, bi binary, v long"
#: n, n_core and v are a block's part of the totals, on its first row: training tokens, those without the ones held out for the weights, distinct tokens.
COUNTED_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, uni binary, bi binary, histogram binary, n long, n_core long, v long"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Ratios are binned in 2**(1/STEPS) for learning the weights.
STEPS = 4
_START = np.array([0.5, 0.4, 0.1])


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


class _Block:
    """Tokens of some documents. role: 0 for counts, 1 held out for the weights, 2 held out for good."""

    def __init__(self, ids: list, column: pa.ChunkedArray | pa.Array, folds: int, held: int, every: int) -> None:
        data, off = _text.utf8(column)
        data = _text.LOWER[data]
        starts, ends, first = _text.words(data, off)
        self.n = np.diff(first) + 1
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        self.first = first + np.arange(len(first))
        size = int(self.first[-1])
        self.token = np.full(size, END, U64)
        self.token[np.arange(len(starts)) + doc] = _text.hash_spans(data, starts, ends)
        self.context = np.empty(size, U64)
        self.context[1:] = self.token[:-1]
        self.context[self.first[:-1]] = BEGIN
        self.pair = _text.mix(_text.mix(self.context + U64(2)) * U64(0xD1342543DE82EF95) + self.token) & PAIR_BITS
        f = [fold(i) for i in ids]
        self.role = np.array([2 if x % folds == held else 1 if x // folds % every == 0 else 0 for x in f], np.int8)
        role = np.repeat(self.role, self.n)
        self.uni, self.uni_back = np.unique(self.token, return_inverse=True)
        self.bi, self.bi_back = np.unique(self.pair, return_inverse=True)
        self.sums = [[np.bincount(back[role == r], minlength=len(keys)) for r in (0, 1)] for keys, back in ((self.uni, self.uni_back), (self.bi, self.bi_back))]
        #: The unigram whose count is the count of the context: before the first token that is the end token.
        self.before = np.empty(size, np.int64)
        self.before[1:] = self.uni_back[:-1]
        self.before[self.first[:-1]] = np.searchsorted(self.uni, END)


def _ratio_bins(block: _Block, uni: np.ndarray, bi: np.ndarray) -> bytes:
    """Counts of (bucket, bin of c(v w) / c(v), bin of c(w), how often) over the tokens held out for the weights; bin 0 is a count of 0."""
    at = np.repeat(block.role == 1, block.n)
    c, w, b = uni[block.before[at]].astype(np.float64), uni[block.uni_back[at]].astype(np.float64), bi[block.bi_back[at]].astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(b > 0, np.round(STEPS * np.log2(b / c)) + 4096, 0)
        one = np.where(w > 0, np.round(STEPS * np.log2(w)) + 4096, 0)
        bucket = np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0)
    key, n = np.unique((bucket.astype(np.int64) << 32) | (two.astype(np.int64) << 16) | one.astype(np.int64), return_counts=True)
    return pack(key.view(U64), n.astype(np.int64))


def learn(keys: np.ndarray, n: np.ndarray, total: int = 1, types: int = 0, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each bucket, by expectation-maximisation; a bucket nobody met keeps the starting weights. total and types: tokens and distinct tokens that the counts come from."""
    out = np.tile(_START, (BUCKETS, 1))
    bucket, two, one = np.minimum(keys >> 32, BUCKETS - 1), keys >> 16 & 0xFFFF, keys & 0xFFFF
    p = np.stack([np.where(two > 0, np.exp2((two - 4096) / STEPS), 0.0), np.where(one > 0, np.exp2((one - 4096) / STEPS) / max(1, total), 0.0), np.full(len(keys), 1 / (types + 1))], 1)
    for k in np.unique(bucket).tolist():
        at = bucket == k
        mine, times, w = p[at], n[at].astype(np.float64)[:, None], _START.copy()
        for _ in range(rounds):
            share = mine * w
            share /= share.sum(axis=1, keepdims=True)
            got = (share * times).sum(axis=0) + _START
            w = got / got.sum()
        out[k] = w
    out[0] = [0.0, out[0][1] + out[0][0], out[0][2]]
    return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, every: int = 8, block_bytes: int = _shared.BLOCK_BYTES) -> DataFrame:
    """One row of SCHEMA for each document. Documents whose fold is held aren't learned from; of the others, one in every is held out for the weights."""
    buckets = _shared.block_count(docs, text, block_bytes)
    rows = _shared.packed_blocks(docs, doc_id, text, buckets).repartition(buckets, "blk")

    def block(part: pa.Table) -> tuple[list, _Block]:
        part = _shared.unpacked(part["docs"])
        ids = part["doc_id"].to_pylist()
        return ids, _Block(ids, part["text"], folds, held, every)

    @_shared.freed
    def ask(key: tuple, part: pa.Table) -> pa.Table:
        _, own = block(part)
        cuts = [_shared.bucket_cuts(keys, buckets) for keys in (own.uni, own.bi)]
        used = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist()
        packed = [[pack_sorted(keys[c[k] : c[k + 1]], core[c[k] : c[k + 1]], extra[c[k] : c[k + 1]]) for k in used] for keys, c, (core, extra) in zip((own.uni, own.bi), cuts, own.sums, strict=True)]
        return pa.table([pa.array(used, pa.int32()), pa.array([key[0].as_py()] * len(used), pa.int32()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], names=["bucket", "blk", "uni", "bi"])

    @_shared.freed
    def tell(key: tuple, part: pa.Table) -> pa.Table:
        answers, types = [], np.zeros(part.num_rows, np.int64)
        for column in ("uni", "bi"):
            asked = [unpack_sorted(x) for x in part[column].to_pylist()]
            cuts = np.cumsum([len(a[0]) for a in asked])
            keys, first, back = np.unique(np.concatenate([a[0] for a in asked]), return_index=True, return_inverse=True)
            core, extra = (np.bincount(back, np.concatenate([a[c] for a in asked]).astype(np.float64), len(keys)).astype(np.int64) for c in (1, 2))
            if column == "uni":
                # A distinct training token counts for the block that asked for it first.
                types = np.bincount(np.searchsorted(cuts, first[core + extra > 0], "right"), minlength=part.num_rows)
            answers.append([pack(core[at], extra[at]) for at in np.split(back, cuts[:-1])])
        return pa.table([part["blk"], pa.array([key[0].as_py()] * part.num_rows, pa.int32()), pa.array(answers[0], pa.binary()), pa.array(answers[1], pa.binary()), pa.array(types, pa.int64())], names=["blk", "bucket", "uni", "bi", "v"])

    @_shared.freed
    def count(key: tuple, part: pa.Table, told: pa.Table) -> pa.Table:
        ids, own = block(part)
        told = told.sort_by("bucket")
        core, whole = [], []
        for column in ("uni", "bi"):
            a, b = (np.concatenate(c) for c in zip(*(unpack(x) for x in told[column].to_pylist()), strict=True))
            core.append(a)
            whole.append(a + b)
        uni, bi = whole[0][own.uni_back], whole[1][own.bi_back]
        spans = list(zip(own.first[:-1].tolist(), own.first[1:].tolist(), strict=True))
        known = np.concatenate([[0], np.cumsum(uni > 0)])
        packed = [[pack(c[a:z]) for a, z in spans] for c in (uni, bi)]
        bins: list[bytes | None] = [None] * len(ids)
        bins[0] = _ratio_bins(own, core[0], core[1])
        facts = np.zeros((3, len(ids)), np.int64)
        facts[:, 0] = own.n[own.role != 2].sum(), own.n[own.role == 0].sum(), sum(told["v"].to_pylist())
        columns = [pa.array(ids, pa.int64()), pa.array(own.role == 2), pa.array(own.n), pa.array(known[own.first[1:]] - known[own.first[:-1]]), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()), pa.array(bins, pa.binary()), *map(pa.array, facts)]
        return pa.table(columns, names=[c.split()[0] for c in COUNTED_SCHEMA.split(", ")])

    asked = rows.groupBy("blk").applyInArrow(ask, ASK_SCHEMA).repartition(buckets, "bucket")
    told = asked.groupBy("bucket").applyInArrow(tell, TOLD_SCHEMA).repartition(buckets, "blk")
    counted = table(rows.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(count, COUNTED_SCHEMA), "lm-counts")
    total, total_core, types = (int(x or 0) for x in counted.agg(F.sum("n"), F.sum("n_core"), F.sum("v")).first())

    def open_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [unpack(x) for x in b.column(0).to_pylist()]
            if got:
                keys, n = (np.concatenate(c).view(np.int64) for c in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    bins = counted.where("histogram IS NOT NULL").select("histogram").mapInArrow(open_bins, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    weights = learn(bins["key"].to_numpy(np.int64), bins["n"].to_numpy(np.int64), total_core, types)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, scores = [], []
            for uni, bi in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                w, pairs = unpack(uni)[0].astype(np.float64), unpack(bi)[0].astype(np.float64)
                base.append(float(np.log10((w + 0.5) / (total + 0.5 * (types + 1))).sum()))
                # What stands before the first token was seen once a training document, as was the end token.
                c = np.concatenate([w[-1:], w[:-1]])
                bucket = np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)
                lam = weights[bucket]
                p = lam[:, 0] * pairs / np.maximum(c, 1) + lam[:, 1] * w / max(1, total) + lam[:, 2] / (types + 1)
                scores.append(float(np.log10(p).sum()) if total else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(np.full(len(base), total)), pa.array(base, pa.float64()), pa.array(scores, pa.float64())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return counted.select("doc_id", "held_out", "n_tokens", "n_known", "uni", "bi").mapInArrow(final, SCHEMA)
