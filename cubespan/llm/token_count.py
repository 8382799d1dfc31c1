"""Token counts with overlap resynchronisation (operator 3).

Documents of at most huge_chars characters are encoded whole. A longer one is cut into chunks of chunk_chars
that overlap by overlap_chars, which are dealt over the cluster by the bytes of all chunks and encoded with
offsets: those of the pieces that a byte-level BPE's store keeps, those of tokens for other libraries and for
chunks that the store can't cut. Two neighbours are spliced at a boundary that both encodings have in their
overlap and that is proven stable: the place before a single space between two other characters. The tokenizers'
patterns never match across it, so the tokens left and right of it don't depend on what lies beyond. Where an
overlap has no such boundary, the document is cut anew with four times the chunk and eight times the overlap,
until one chunk holds it.

Null and empty texts have 0 bytes and 0 tokens. Rows with equal texts are encoded once if they are huge. A null id
stays null, and rows with equal ids are counted each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespan.llm._shared import small_batches, table

#: Bytes of chunks that a task encodes, about.
TASK_BYTES = 4 << 20
CHUNK_SCHEMA = "h string, k long, last boolean, start long, chunk string"
CODED_SCHEMA = "h string, k long, last boolean, n_tokens long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def library_offsets(path: str):
    """A function from a text to (starts, ends) of its tokens in characters, by the library for the file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def pieces(text: str) -> tuple[np.ndarray, np.ndarray]:
            got = sp.encode(text, return_type="proto").pieces
            raw = np.frombuffer(text.encode(), np.uint8)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            return chars[np.array([p.begin for p in got], np.int64)], chars[np.array([p.end for p in got], np.int64)]

        return pieces
    from cubespan.llm._tokens import encoder

    library = encoder(path).library

    def offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
        got = np.array(library.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]

    return offsets


def stable(text: str, lo: int, hi: int, plain: bool = False) -> list[int]:
    """Places in [lo, hi) before a single space that stands between two characters other than white space.

    plain: both have to be ASCII letters or digits, for libraries that normalise text first.
    """
    found, at = [], text.find(" ", max(lo, 1), hi)
    while at >= 0:
        if at + 1 < len(text):
            a, b = text[at - 1], text[at + 1]
            if (a + b).isascii() and (a + b).isalnum() or not plain and not a.isspace() and not b.isspace() and min(a, b) > "\x1f":
                found.append(at)
        at = text.find(" ", at + 1, hi)
    return found


def inner_space_free(path: str) -> bool:
    """Whether no piece of a sentencepiece model goes over the space between two words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))


def cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """CHUNK_SCHEMA for (h, text). Texts that a task has met already are left out."""
    met = set()
    for b in batches:
        for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if h in met:
                continue
            met.add(h)
            n = max(1, -(-max(0, len(text) - overlap) // chunk))
            for k in range(0, n, 64):
                ks = range(k, min(n, k + 64))
                parts = [text[i * chunk :] if i == n - 1 else text[i * chunk : (i + 1) * chunk + overlap] for i in ks]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(ks)), pa.array(ks, pa.int64()), pa.array([i == n - 1 for i in ks]), pa.array([i * chunk for i in ks], pa.int64()), pa.array(parts, pa.string())], names=["h", "k", "last", "start", "chunk"])


def code(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """CODED_SCHEMA for CHUNK_SCHEMA: stable token boundaries in both overlaps, with the tokens before them."""
    offsets, plain = library_offsets(path), path.endswith(".model")
    if plain:
        pieces = lambda column: [(np.zeros(1, np.int64),) * 2] * len(column)
    else:
        from cubespan.llm._tokens import encoder

        pieces = encoder(path).boundaries

    def counted(text: str, begin: np.ndarray, before: np.ndarray):
        """The number of tokens, and a function from places to (whether tokens begin there, the tokens before)."""
        if len(begin) > 2:

            def by_store(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                edges = [0, *at.tolist()]
                at = np.cumsum([len(text[x:y].encode()) for x, y in zip(edges, edges[1:], strict=False)], dtype=np.int64)
                i = np.searchsorted(begin, at)
                return begin[i] == at, before[i]

            return int(before[-1]), by_store
        first, end = offsets(text)

        def by_library(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i = np.searchsorted(end, at, "right")
            return np.append(first, len(text))[i] >= at, i

        return len(first), by_library

    for b in batches:
        rows = []
        for h, k, last, start, text, known in zip(*(c.to_pylist() for c in b.columns), pieces(b.column(4)), strict=True):
            n, look = counted(text, *known)
            row: list = [h, k, last, n]
            for lo, hi, wanted in ((0, overlap, k > 0), (chunk, chunk + overlap, not last)):
                at = np.array(stable(text, lo, min(hi, len(text)), plain) if wanted else [], np.int64)
                good, before = look(at)
                row += [(at[good] + start).tolist(), before[good].tolist()]
            rows.append(row)
        if rows:
            names = [c.split()[0] for c in CODED_SCHEMA.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def splice(coded: DataFrame) -> DataFrame:
    """(h, n_tokens, aligned): n_tokens counts where every two neighbours share a boundary."""
    w = Window.partitionBy("h").orderBy("k")
    common = F.array_min(F.array_intersect("right_at", F.lead("left_at").over(w)))
    out = coded.withColumn("cut", F.when(~F.col("last"), common))
    out = out.withColumn("before", F.lag("cut").over(w))
    place = lambda at, n, p: F.try_element_at(F.col(n), F.array_position(F.col(at), F.col(p)).cast("int"))
    upto = F.when(F.col("last"), F.col("n_tokens")).when(F.col("cut").isNotNull(), place("right_at", "right_n", "cut"))
    since = F.when(F.col("k") == 0, F.lit(0)).when(F.col("before").isNotNull(), place("left_at", "left_n", "before"))
    return out.groupBy("h").agg(F.sum(upto - since).alias("n_tokens"), F.min(upto.isNotNull() & since.isNotNull()).alias("aligned"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = 8192, overlap_chars: int = 256, huge_chars: int = 16384) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of docs; over_limit: more tokens than limit."""
    if tokenizer.endswith(".model") and not inner_space_free(tokenizer):
        raise ValueError("this model has pieces that go over spaces, so no boundary is proven stable")
    small_batches(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            count = lambda column: [len(library_offsets(tokenizer)(t or "")[0]) for t in column.to_pylist()]
        else:
            from cubespan.llm._tokens import encoder

            count = lambda column: np.diff(encoder(tokenizer).encode(column)[1])
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count(b.column(2)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    small = rows.where(F.length("text") <= huge_chars).mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")
    huge = rows.where(F.length("text") > huge_chars).select("doc_id", "n_bytes", F.sha2("text", 256).alias("h"), "text")
    counted, chunk, overlap, todo = None, chunk_chars, overlap_chars, huge.select("h", "text")
    tasks = max(1, math.ceil((huge.agg(F.sum("n_bytes")).first()[0] or 0) / TASK_BYTES))
    while True:
        pieces = todo.mapInArrow(lambda it, c=chunk, o=overlap: cut(it, c, o), CHUNK_SCHEMA)
        once = pieces.repartition(tasks, "h", "k").groupBy("h", "k").agg(*(F.first(c).alias(c) for c in ("last", "start", "chunk")))
        coded = once.mapInArrow(lambda it, c=chunk, o=overlap: code(it, tokenizer, c, o), CODED_SCHEMA)
        done = table(splice(coded), "token-counts")
        aligned = done.where("aligned").select("h", "n_tokens")
        counted = aligned if counted is None else counted.unionByName(aligned)
        left = done.where("not aligned").select("h")
        if left.isEmpty():
            break
        chunk, overlap = 4 * chunk, min(8 * overlap, 2 * chunk)
        todo = huge.select("h", "text").join(left, "h", "left_semi")
    spliced = huge.select("doc_id", "n_bytes", "h").join(counted, "h").select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
