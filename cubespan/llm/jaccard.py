"""Grouped prefix join on n-gram sets (operator 4).

A document's set are its distinct shingles of n words, with A-Z lowered; a shorter text is one shingle as a
whole; a text without words has the empty set and links with nothing. Two documents link when the size of
the intersection is percent hundredths of the size of the union or more.

1. Documents with equal texts are one (links between them are certain).
2. Shingles are ordered by how many documents have them, rarest first; the counts are exact and cover all
   documents. Two linked documents share a shingle of their prefixes, that is of the first
   size - ceil(size * percent / 100) + 1. Only shingles that two documents have can be shared.
3. Documents with identical prefixes and sizes collapse into one group. Pairs of groups that share a prefix
   shingle are filtered by their sizes and by what can still be shared after the shingle's places in both
   prefixes. Where more than SHORT groups have a shingle their pairs aren't made: a chain through them in the
   order of sizes, cut where two sizes are too far apart, joins them instead, which loses no pair.
4. Connected groups are expanded to their members, which are verified exactly by their sets, skipping pairs that
   are connected already. A large component is cut into parts: each part is compared within itself and with
   the first part; if that doesn't connect all of it, what lies outside the largest connected piece is compared
   with everything. So a great group of near copies costs as many tasks as it has parts. A link is never lost.
5. The verified links' connected components are the classes.

Null text is empty. A null id compares as the largest id and is reported as null. Repeated rows are one
document, reported as often as they occur; rows with one id and different texts are different documents.
deduplicate() passes columns through whatever their names; of rows that agree in id and text it keeps one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespan.llm import _shared, _text
from cubespan.llm._graph import components, forest
from cubespan.llm._shared import freed, look_up, pack, pack_sorted, release, remove, table, unpack, unpack_sorted

U64 = np.uint64
ASK_SCHEMA = "bucket int, blk int, asked binary"
TOLD_SCHEMA = "blk int, bucket int, told binary"
SETS_SCHEMA = "node long, size long, gid long, prefix binary, members binary"
#: Shingles that a verifying task holds of one part.
PART_ITEMS = 1 << 18
#: Groups that share a shingle of which all pairs are looked at.
SHORT = 64


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """Ascending distinct hashes for each document."""
    data, off = _text.utf8(column)
    out = []
    for i, j in _text.parts(off, 4 << 20):
        part = _text.LOWER[data[off[i] : off[j]]]
        starts, ends, first = _text.words(part, off[i : j + 1] - off[i])
        h = _text.hash_spans(part, starts, ends)
        g = _text.grams(h, n)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= n:
                out.append(np.unique(g[a : z - n + 1]))
            else:
                out.append(_text.grams(h[a:z], z - a) if z > a else np.zeros(0, U64))
    return out


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1


def verified(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows) that connect whatever is connected among the sets; with side only pairs of different sides are compared. Pairs that are connected already, as rows with one number in known are, aren't compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    _, items = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    off = np.concatenate([[0], np.cumsum(size)])
    owner_side = None if side is None else side[order]
    label = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1][order]
    mark = np.zeros(int(items.max()) + 1 if len(items) else 1, bool)
    a, b = [], []
    # Sizes ascend, so a row's partners below end where sizes are too small, and those above are met from their own side.
    low = np.searchsorted(size * 100, size * percent)
    for p in range(1, n):
        rows = np.arange(low[p], p)
        rows = rows[label[rows] != label[p]]
        if owner_side is not None:
            rows = rows[owner_side[rows] != owner_side[p]]
        if not len(rows):
            continue
        mark[items[off[p] : off[p + 1]]] = True
        n_rows = size[rows]
        flat = items[np.repeat(off[rows] - (np.cumsum(n_rows) - n_rows), n_rows) + np.arange(int(n_rows.sum()))]
        common = np.add.reduceat(mark[flat].astype(np.int64), np.cumsum(n_rows) - n_rows)
        mark[items[off[p] : off[p + 1]]] = False
        linked = rows[100 * common >= percent * (size[p] + n_rows - common)]
        for r in linked.tolist():
            if label[r] != label[p]:
                a.append(order[p])
                b.append(order[r])
                label[label == label[r]] = label[p]
    return np.array(a, np.int64), np.array(b, np.int64)


#: What a null id counts as.
NULL_ID = (1 << 63) - 1


def _node(doc_id: str, text: str) -> Column:
    """What tells documents apart: a hash of id and text."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), F.col(text).cast("string"))


def classes(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", block_bytes: int = _shared.BLOCK_BYTES, part_items: int = PART_ITEMS) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest id that is reachable by links."""
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return _members(docs, n, percent, doc_id, text, block_bytes, part_items).select(shown("doc_id"), "n_shingles", shown("component_id"))


def _members(docs: DataFrame, n: int, percent: int, doc_id: str, text: str, block_bytes: int = _shared.BLOCK_BYTES, part_items: int = PART_ITEMS) -> DataFrame:
    """(doc_id, node, n_shingles, component_id, chosen): a row for each row of docs; chosen is the node that stands for its class."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    buckets = _shared.block_count(docs, text, block_bytes)
    whole = _shared.with_block(docs, doc_id, text, buckets).withColumn("node", _node("doc_id", "text"))
    rows = whole.select("blk", "node", "text").repartition(buckets, "blk")
    # One text stands for all that equal it: the one of the smallest id.
    keyed = whole.select("blk", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "node", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h"))
    keyed = table(keyed, "jaccard-ids")
    total = keyed.count()
    first = keyed.groupBy("h").agg(F.min(F.struct("doc_id", "node")).alias("m"), F.count(F.lit(1)).alias("__n"))
    first = table(first.select("h", F.col("m.node").alias("rep"), F.col("m.doc_id").alias("rep_id"), "__n"), "jaccard-texts")
    known = table(look_up(keyed, first.drop("rep_id"), "h", total).drop("h"), "jaccard-copies")
    remove(keyed)
    copies = known.where("node <> rep").groupBy("blk", F.pmod("node", F.lit(64)).alias("s")).agg(F.collect_set("node").alias("ids"))
    copies = copies.select("blk", F.lit(-1).alias("bucket"), "ids", F.lit(None).cast("binary").alias("told"))

    def own_sets(part: pa.Table, more: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        """Nodes and sets of a block's documents, each once, without copies of another."""
        gone = {i for ids in more["ids"].to_pylist() for i in ids or ()}
        nodes, at = np.unique(part["node"].to_numpy(), return_index=True)
        keep = [k for k, i in zip(at.tolist(), nodes.tolist(), strict=True) if i not in gone]
        own = part.take(pa.array(keep, pa.int64()))
        return own["node"].to_pylist(), shingle_sets(own["text"], n)

    @freed
    def ask(key: tuple, part: pa.Table, more: pa.Table) -> pa.Table:
        _, sets = own_sets(part, more)
        keys, times = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_counts=True)
        cuts = _shared.bucket_cuts(keys, buckets)
        used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        packed = [pack_sorted(keys[cuts[b] : cuts[b + 1]], times[cuts[b] : cuts[b + 1]]) for b in used]
        return pa.table([pa.array(used, pa.int32()), pa.array([key[0].as_py()] * len(used), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "blk", "asked"])

    @freed
    def tell(key: tuple, part: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x) for x in part["asked"].to_pylist()]
        keys, back = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(back, np.concatenate([a[1] for a in asked]).astype(np.float64), len(keys)).astype(np.int64)[back]
        at, told = 0, []
        for own, _ in asked:
            mine = total[at : at + len(own)]
            at += len(own)
            told.append(pack_sorted(own[mine > 1], mine[mine > 1]))
        return pa.table([part["blk"], pa.array([key[0].as_py()] * len(told), pa.int32()), pa.array(told, pa.binary())], names=["blk", "bucket", "told"])

    @freed
    def prefixes(key: tuple, part: pa.Table, more: pa.Table) -> pa.Table:
        ids, sets = own_sets(part, more)
        answers = more.filter(pa.compute.greater_equal(more["bucket"], 0)).sort_by("bucket")["told"].to_pylist()
        shared, times = (np.concatenate(c) for c in zip((np.zeros(0, U64), np.zeros(0, U64)), *map(unpack_sorted, answers), strict=True))
        out = []
        for i, s in zip(ids, sets, strict=True):
            at = np.minimum(np.searchsorted(shared, s), max(0, len(shared) - 1))
            count = np.where(shared[at] == s, times[at], U64(1)) if len(shared) else np.ones(len(s), U64)
            chosen = np.lexsort((s, count))[: prefix_length(len(s), percent)] if len(s) else np.zeros(0, np.int64)
            common = chosen[count[chosen] > 1]
            if not len(common):
                out.append((i, len(s), None, None, None))
                continue
            whole = np.sort(s[chosen])
            gid = int(_text.mix(np.array([_text.windows(whole, len(whole))[0] + U64(len(s))], U64)).view(np.int64)[0])
            # Each shared shingle of the prefix, with its place in the document's order.
            place = np.flatnonzero(count[chosen] > 1)
            by_hash = np.argsort(s[common])
            out.append((i, len(s), gid, pack_sorted(s[common][by_hash], place[by_hash]), pack_sorted(s)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["node", "size", "gid", "prefix", "members"])

    asked = rows.groupBy("blk").cogroup(copies.repartition(buckets, "blk").groupBy("blk")).applyInArrow(ask, ASK_SCHEMA)
    told = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tell, TOLD_SCHEMA)
    more = copies.unionByName(told.select("blk", "bucket", F.lit(None).cast("array<long>").alias("ids"), "told")).repartition(buckets, "blk")
    sets = table(rows.groupBy("blk").cogroup(more.groupBy("blk")).applyInArrow(prefixes, SETS_SCHEMA), "jaccard-sets")

    links = components(_candidate_edges(sets, percent, buckets))
    group = F.coalesce("component", "gid")
    found = sets.where("gid IS NOT NULL").join(links.withColumnRenamed("node", "linked"), F.col("gid") == F.col("linked"), "left").select("node", "size", group.alias("cluster"), "members")
    found = table(found, "jaccard-clusters")
    joined = table(components(_verified_edges(found, percent, part_items)), "jaccard-classes").select(F.col("node").alias("rep"), "component")
    remove(found)
    # A row for each text, then for each document; one text or class can have a large share of them.
    own = first.drop("h").join(sets.select(F.col("node").alias("rep"), F.col("size").alias("n_shingles")), "rep").join(joined, "rep", "left")
    smallest = own.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("rep_id", "rep")).alias("m"), F.count(F.lit(1)).alias("__n"))
    own = table(look_up(own, smallest, "component", first.count(), "left").drop("component"), "jaccard-members")
    out = look_up(known, own, "rep", total)
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("m.rep_id", "rep_id"))
    chosen = F.when(alone, F.col("node")).otherwise(F.coalesce("m.rep", "rep"))
    return out.select("doc_id", "node", "n_shingles", component.alias("component_id"), chosen.alias("chosen"))


def neighbours(keys: np.ndarray, size: np.ndarray, gid: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between groups that can have linked members, of entries (shingle, size, group, place in the prefix)."""
    order = np.lexsort((gid, size, keys))
    keys, size, gid, left = keys[order], size[order], gid[order], (size - place)[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    many = np.diff(np.append(first, len(keys)))
    long = np.repeat(many > SHORT, many)
    close = lambda d: (keys[d:] == keys[:-d]) & (100 * size[:-d] >= percent * size[d:]) & (gid[d:] != gid[:-d])
    at = np.flatnonzero(close(1) & long[1:])
    a, b = [gid[at]], [gid[at + 1]]
    for d in range(1, int(many[many <= SHORT].max(initial=1))):
        # What two groups share from here on must do for a link; earlier shingles that they share have lists of their own.
        at = np.flatnonzero(close(d) & ~long[d:] & ((100 + percent) * np.minimum(left[:-d], left[d:]) >= percent * (size[:-d] + size[d:])))
        a.append(gid[at])
        b.append(gid[at + d])
    return np.concatenate(a), np.concatenate(b)


def _candidate_edges(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b): a spanning forest, for each bucket of shingles, of the neighbours among its groups."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [unpack_sorted(x) for x in b.column(2).to_pylist()]
            if not lists:
                continue
            n = [len(x[0]) for x in lists]
            keys, place = (np.concatenate(c) for c in zip(*lists, strict=True))
            size, gid = (np.repeat(b.column(k).to_numpy(), n) for k in (1, 0))
            order = np.argsort(keys)
            keys, size, gid, place = keys[order], size[order], gid[order], place[order]
            cuts = _shared.bucket_cuts(keys, buckets)
            used = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            packed = [pack(*(c[cuts[k] : cuts[k + 1]] for c in (keys, size, gid, place))) for k in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "entries"])
        release()

    def join(key: tuple, part: pa.Table) -> pa.Table:
        keys, *rest = (np.concatenate(c) for c in zip(*map(unpack, part["entries"].to_pylist()), strict=True))
        a, b = forest(*neighbours(keys, *(c.view(np.int64) for c in rest), percent))
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    groups = sets.where("gid IS NOT NULL").groupBy("gid").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    return groups.mapInArrow(deal, "bucket int, entries binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(join, "a long, b long")


def _compared(met: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(a, b) for (cluster, i, j, side, known, node, members): the rows of one (cluster, i, j) are compared, sides i and j with each other if they differ."""

    @freed
    def verify(key: tuple, part: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        part = part.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending")])
        keys = np.stack([part[c].to_numpy().astype(np.int64) for c in ("cluster", "i", "j")])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        ids, side, known, raw = part["node"].to_numpy(), part["side"].to_numpy(), part["known"].to_numpy(), part["members"]
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), part.num_rows], strict=True):
            if hi - lo > 1:
                sets = [unpack_sorted(x)[0] for x in raw.slice(lo, hi - lo).to_pylist()]
                cross = keys[1, lo] != keys[2, lo]
                x, y = verified(sets, percent, side[lo:hi] if cross else None, known[lo:hi])
                a.append(ids[lo:hi][x])
                b.append(ids[lo:hi][y])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    task = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(tasks)).cast("int")
    return met.withColumn("task", task).repartition(tasks, "task").groupBy("task").applyInArrow(verify, "a long, b long")


def _verified_edges(found: DataFrame, percent: int, part_items: int) -> DataFrame:
    """(a, b): links between documents that connect whatever is connected. found: (node, size, cluster, members)."""
    every, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(4 * math.ceil(total / part_items), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("items")).where("__n > 1")
    sizes = table(sizes.select("cluster", "__n", F.ceil(F.col("items") / part_items).cast("int").alias("parts")), "jaccard-parts")
    own = look_up(found, sizes, "cluster", every).withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Within each part, and each part with the first one.
    other = F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0), F.col("side"))))
    met = own.withColumn("other", other).select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", F.col("node").alias("known"), "node", "members")
    edges = table(_compared(met, percent, tasks), "jaccard-edges")
    if sizes.where("parts > 2").isEmpty():
        return edges
    # Parts that haven't met: all that isn't in the largest connected piece of its component meets everything.
    big = own.where("parts > 2")
    pieces = components(edges.join(big.select(F.col("node").alias("a")), "a", "left_semi"))
    big = big.join(pieces.withColumnRenamed("component", "piece"), "node", "left").withColumn("known", F.coalesce("piece", "node")).drop("piece")
    big = table(big, "jaccard-big")
    of_piece = big.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items"))
    rest = of_piece.groupBy("cluster").agg(F.sum("n").alias("__n"), F.max_by("known", F.struct("n", "known")).alias("main"), F.sum("items").alias("all_"), F.max(F.struct("n", "known", "items")).alias("top"))
    rest = rest.select("cluster", "__n", "main", F.ceil((F.col("all_") - F.col("top.items")) / part_items).cast("int").alias("odd")).where("odd > 0")
    big = look_up(big, table(rest, "jaccard-rest"), "cluster", every)
    here = F.pmod(F.xxhash64("node"), F.col("odd")).cast("int")
    odd = big.where("known <> main").select("cluster", here.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"), F.lit(-1).alias("side"), "known", "node", "members")
    all_ = big.select("cluster", F.explode(F.sequence(F.lit(0), F.col("odd") - 1)).alias("i"), F.col("side").alias("k"), "side", "known", "node", "members")
    # j is never i, so that the sides meet and each isn't compared within itself.
    met = odd.unionByName(all_).select("cluster", "i", (-1 - F.col("k")).alias("j"), "side", "known", "node", "members")
    return edges.unionByName(_compared(met, percent, tasks))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, that of the smallest id, once."""
    kept = _members(docs, n, percent, doc_id, text).select(F.col("chosen").alias("node")).distinct()
    own = docs.select(_shared.whole_row(docs).alias("row"), _node(doc_id, text).alias("node"), _shared.row_hash(docs).alias("h"))
    one = own.groupBy("node").agg(F.min_by("row", "h").alias("row"))
    return one.join(kept, "node", "left_semi").select("row.*")
