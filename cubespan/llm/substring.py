"""Removal of repeated passages by seed and extend (operator 5).

Seeds are winnowed anchors: of every run of window - anchor + 1 consecutive anchor-word sequences the one with
the smallest hash, so equal passages of window words have an anchor in common, at the same place. Anchors are
joined over all documents; one that lies in two documents or more is a seed. A match is extended from its
seeds to both sides: the passages of window words around a seed are joined the same way, and those that also
start in a document with a smaller id are marked. Overlapping marked passages make up the maximal repeats of
window words or more; their words are removed.

Both joins exchange sorted, pre-aggregated hashes between blocks of documents and buckets of the hash range:
a passage costs one entry a block however often it occurs, and no pairs of documents are formed. Anchors have
hashes of 64 bits, as an anchor that is wrongly held to be a seed only costs time; passages that are equal in two
independent hashes, 128 bits, count as equal.

Null text has no words. A null id counts as larger than all others. Rows with equal ids don't remove each
other's words, but lose those that a smaller id has. What a document loses depends on the input alone, not on
what is left of others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cubespan.llm import _shared, _text
from cubespan.llm._shared import pack_sorted, unpack_sorted

U64 = np.uint64
#: Makes a second hash of a word from the first.
SECOND = U64(0x9E3779B97F4A7C15)
ASK_SCHEMA = "bucket int, blk int, asked binary"
TOLD_SCHEMA = "blk int, bucket int, told binary"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<string>, kept_text string"


def anchors(g: np.ndarray, valid: np.ndarray, run: int) -> np.ndarray:
    """Positions of sequences that are smallest in a run of run sequences that lie in one document. g: hashes of the sequences; valid: whether a run can start there, for len(g) - run + 1 starts."""
    if not valid.any():
        return np.zeros(0, np.int64)

    def slide(x: np.ndarray, pick) -> np.ndarray:
        width = 1
        while 2 * width <= run:
            x = pick(x[: len(x) - width], x[width:])
            width *= 2
        rest = run - width
        return pick(x[: len(x) - rest], x[rest:]) if rest else x

    low = np.where(valid, slide(g, np.minimum), U64(0))
    edge = np.zeros(run - 1, U64)
    return np.flatnonzero(slide(np.concatenate([edge, low, edge]), np.maximum) == g)


class _Block:
    """Words, anchors and windows of some documents."""

    def __init__(self, part: pa.Table, window: int, anchor: int) -> None:
        self.ids = _shared.as_ids(part["doc_id"])
        self.data, self.off = _text.utf8(part["text"])
        self.starts, self.ends, self.first = _text.words(self.data, self.off)
        self.h = _text.hash_spans(self.data, self.starts, self.ends)
        self.doc = np.repeat(self.ids, np.diff(self.first))
        self.valid = _text.within(self.first, window)
        self.window, self.anchor = window, anchor

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes."""
        if not self.valid.any():
            return np.zeros(0, np.int64), np.zeros(0, U64)
        g = _text.grams(self.h, self.anchor)
        at = anchors(g, self.valid, self.window - self.anchor + 1)
        return at, g[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one document, and two hashes of them."""
        at = np.flatnonzero(self.valid)
        if not len(at):
            return at, np.zeros(0, U64), np.zeros(0, U64)
        return at, _text.windows(self.h, self.window)[at], _text.windows(_text.mix(self.h + SECOND), self.window)[at]


def _distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts pairs, and where each distinct pair begins in it."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    return order, np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else np.zeros(0, np.int64)


def _ask(blk, keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, buckets: int) -> pa.Table:
    """Distinct keys with their checks, the smallest and the largest document, by bucket."""
    order, first = _distinct(keys, checks)
    k, c, d = keys[order][first], checks[order][first], docs[order]
    low, high = (f.reduceat(d, first) if len(first) else d for f in (np.minimum, np.maximum))
    cuts = _shared.bucket_cuts(k, buckets)
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    packed = [pack_sorted(*(x[cuts[b] : cuts[b + 1]] for x in (k, c, low, high))) for b in used]
    return pa.table([pa.array(used, pa.int32()), pa.array([blk] * len(used), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "blk", "asked"])


def _tell(key: tuple, part: pa.Table, later: bool) -> pa.Table:
    """To each block those of its keys that two documents have, with the smallest document; later: only those that a larger document of the block has too."""
    asked = [unpack_sorted(x) for x in part["asked"].to_pylist()]
    keys, checks, least, most = (np.concatenate(c) for c in zip(*asked, strict=True))
    order, first = _distinct(keys, checks)
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    low, high = (f.reduceat(d.view(np.int64)[order], first) if len(first) else d.view(np.int64) for f, d in ((np.minimum, least), (np.maximum, most)))
    told, at = [], 0
    for own, check, _, top in asked:
        mine = back[at : at + len(own)]
        at += len(own)
        wanted = low[mine] < (top.view(np.int64) if later else high[mine])
        told.append(pack_sorted(own[wanted], check[wanted], low[mine][wanted]))
    return pa.table([part["blk"], pa.array([key[0].as_py()] * len(told), pa.int32()), pa.array(told, pa.binary())], names=["blk", "bucket", "told"])


def _table(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys, checks and smallest documents of what all buckets told a block."""
    got = [unpack_sorted(x) for x in told.sort_by("bucket")["told"].to_pylist()]
    if not got:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
    keys, checks, low = (np.concatenate(c) for c in zip(*got, strict=True))
    return keys, checks, low.view(np.int64)


def _found(keys: np.ndarray, checks: np.ndarray, wanted: np.ndarray, wanted_checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted pair is among ascending ones, and where."""
    hit, at = np.zeros(len(wanted), bool), np.searchsorted(keys, wanted)
    open_ = np.flatnonzero(at < len(keys))
    while len(open_):
        open_ = open_[keys[at[open_]] == wanted[open_]]
        same = checks[at[open_]] == wanted_checks[open_]
        hit[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(keys)]
    return hit, at


def _spans(marked: np.ndarray) -> list[str]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [f"{a}-{z}" for a, z in edge.reshape(-1, 2).tolist()]


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = 16, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = _shared.BLOCK_BYTES) -> DataFrame:
    """One row of SCHEMA for each document: removed lists the maximal repeats as "first-end" in words; kept_text is null unless with_text."""
    if not 1 <= anchor <= window:
        raise ValueError("anchor must lie between 1 and window")
    buckets = _shared.block_count(docs, text, block_bytes)
    rows = _shared.with_block(docs, doc_id, text, buckets).repartition(buckets, "blk")

    @_shared.freed
    def ask_anchors(key: tuple, part: pa.Table) -> pa.Table:
        own = _Block(part, window, anchor)
        at, g = own.anchors()
        return _ask(key[0].as_py(), g, np.zeros(len(g), U64), own.doc[at], buckets)

    @_shared.freed
    def ask_windows(key: tuple, part: pa.Table, told: pa.Table) -> pa.Table:
        blk = key[0].as_py()
        if not part.num_rows or not told.num_rows:
            return _ask(blk, np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), buckets)
        own = _Block(part, window, anchor)
        at, g = own.anchors()
        keys, checks, _ = _table(told)
        seeds = at[_found(keys, checks, g, np.zeros(len(g), U64))[0]]
        near = np.zeros(len(own.h) + 1, np.int64)
        np.add.at(near, np.maximum(0, seeds - (window - anchor)), 1)
        np.add.at(near, seeds + 1, -1)
        start, w, check = own.windows()
        close = np.cumsum(near)[start] > 0
        return _ask(blk, w[close], check[close], own.doc[start[close]], buckets)

    @_shared.freed
    def finish(key: tuple, part: pa.Table, told: pa.Table) -> pa.Table:
        own = _Block(part, window, anchor)
        start, w, check = own.windows()
        keys, checks, low = _table(told)
        hit, at = _found(keys, checks, w, check)
        hit[hit] = low[at[hit]] < own.doc[start[hit]]
        gone = _text.covered(start[hit], window, len(own.h))
        raw, out = own.data.tobytes(), []
        for i, (row, a, z) in enumerate(zip(part["doc_id"].to_pylist(), own.first[:-1].tolist(), own.first[1:].tolist(), strict=True)):
            marked = gone[a:z]
            if marked.any():
                left = np.flatnonzero(~marked) + a
                kept = b" ".join([raw[x:y] for x, y in zip(own.starts[left].tolist(), own.ends[left].tolist(), strict=True)])
                out.append((row, z - a, z - a - len(left), hashlib.sha256(kept).hexdigest(), _spans(marked), kept.decode() if with_text else None))
            else:
                kept = b" ".join(raw[own.off[i] : own.off[i + 1]].split())
                out.append((row, z - a, 0, hashlib.sha256(kept).hexdigest(), [], kept.decode() if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def answered(asked: DataFrame, later: bool):
        told = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared.freed(lambda key, part: _tell(key, part, later)), TOLD_SCHEMA)
        return told.repartition(buckets, "blk").groupBy("blk")

    told = answered(rows.groupBy("blk").applyInArrow(ask_anchors, ASK_SCHEMA), later=False)
    told = answered(rows.groupBy("blk").cogroup(told).applyInArrow(ask_windows, ASK_SCHEMA), later=True)
    return rows.groupBy("blk").cogroup(told).applyInArrow(finish, SCHEMA)
