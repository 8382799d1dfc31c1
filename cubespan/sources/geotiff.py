"""GeoTIFF files: a reader of windows of tiled or striped rasters, and a writer for maps.

Only what maps and single-band scenes need: the first sample, overviews by number, the affine grid, EPSG code and
no-data value. Plain, deflated, LZW and Zstandard blocks, predictors 1 to 3, classic and BigTIFF. A window takes
only the blocks that it meets from the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of the TIFF and GeoTIFF specifications.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
PIXELS = "path string, row int, col int, v double"
#: Pixels of a map that the driver writes as one file: a Sentinel-2 tile.
MOST_PIXELS = 1 << 27


@dataclass(frozen=True)
class Raster:
    """x0, y0: the outer corner of the first pixel; dx, dy: the step of a column and a row (dy is negative in maps with north up)."""

    data: np.ndarray
    x0: float = 0.0
    dx: float = 1.0
    y0: float = 0.0
    dy: float = -1.0
    epsg: int | None = None
    nodata: float | None = None


Reader = Callable[[int, int], bytes]


def of_bytes(raw: bytes) -> Reader:
    return lambda at, size: raw[at : at + size]


def buffered(fetch: Reader, chunk: int = 1 << 16) -> Reader:
    """A reader that asks for chunks and keeps them, for headers; what is larger than a chunk goes through."""
    kept: dict[int, bytes] = {}

    def read_at(at: int, size: int) -> bytes:
        if size > chunk:
            return fetch(at, size)
        first, last = at // chunk, (at + max(size, 1) - 1) // chunk
        for k in range(first, last + 1):
            if k not in kept:
                kept[k] = fetch(k * chunk, chunk)
        return b"".join(kept[k] for k in range(first, last + 1))[at - first * chunk :][:size]

    return read_at


def _directories(read_at: Reader) -> tuple[str, list[dict[int, tuple]]]:
    head = read_at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("no TIFF file")
    # BigTIFF has wider counts and offsets.
    count, entry, offset, inline = ("H", "HHI", "I", 4) if magic == 42 else ("Q", "HHQ", "Q", 8)
    size = struct.calcsize("<" + entry) + inline
    out, at = [], struct.unpack_from(order + offset, head, 4 if magic == 42 else 8)[0]
    while at:
        wide = struct.calcsize("<" + count)
        n = struct.unpack(order + count, read_at(at, wide))[0]
        raw = read_at(at + wide, n * size + inline)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, items = struct.unpack_from(order + entry, raw, k * size)
            if kind in _TYPES:
                code = order + _TYPES[kind] * items
                place = (k + 1) * size - inline
                body = raw[place : place + inline] if struct.calcsize(code) <= inline else read_at(struct.unpack_from(order + offset, raw, place)[0], struct.calcsize(code))
                tags[tag] = struct.unpack_from(code, body)
        out.append(tags)
        at = struct.unpack_from(order + offset, raw, n * size)[0]
    return order, out


def lzw(raw: bytes) -> bytes:
    """The TIFF variant of LZW: codes of 9 to 12 bits, highest bit first, 256 to start anew and 257 to end."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    words, out, held, bits, width, last = list(first), [], 0, 0, 9, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = list(first), 9, None
            continue
        if last is None:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out.append(word)
        last = word
        width = max(9, min(12, (len(words) + 1).bit_length()))
    return b"".join(out)


def _unpacked(block: bytes, compression: int) -> bytes:
    if compression == 1:
        return block
    if compression in (8, 32946):
        return zlib.decompress(block)
    if compression == 5:
        return lzw(block)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(block)
    raise ValueError(f"compression {compression} is not supported")


def _pixels(block: bytes, kind: np.dtype, width: int, samples: int, predictor: int) -> np.ndarray:
    """(row, column, sample) of a block, in the machine's byte order."""
    plain = kind.newbyteorder("=")
    size = width * samples * kind.itemsize
    block = block[: len(block) // size * size]
    if predictor == 3:
        # Rows of differences of bytes, the highest byte of every number first.
        flat = np.frombuffer(block, np.uint8).reshape(-1, width * kind.itemsize, samples)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(-1, kind.itemsize, width * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">{plain.kind}{plain.itemsize}").astype(plain).reshape(-1, width, samples)
    pixels = np.frombuffer(block, kind).reshape(-1, width, samples)
    if predictor == 2:
        return np.cumsum(pixels, axis=1, dtype=plain)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return pixels.astype(plain)


def header(read_at: Reader, overview: int | None = None) -> tuple[str, dict[int, tuple], Raster]:
    """Byte order, tags and the raster without its data: the full one, or an overview by its number from 0."""
    order, found = _directories(read_at)
    if overview is not None and overview + 1 >= len(found):
        raise ValueError(f"there is no overview {overview}")
    full, tags = found[0], found[0 if overview is None else overview + 1]
    sx, sy = full.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    i, j, _, x, y = full.get(TIEPOINT, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))[:5]
    zoom_x, zoom_y = full[WIDTH][0] / tags[WIDTH][0], full[HEIGHT][0] / tags[HEIGHT][0]
    keys = full.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
    said = b"".join(full[NODATA]).split(b"\0")[0].strip() if NODATA in full else b""
    empty = np.zeros((0, 0))
    return order, tags, Raster(empty, x - i * sx, sx * zoom_x, y + j * sy, -sy * zoom_y, codes.get(3072, codes.get(2048)), float(said) if said else None)


def read_window(read_at: Reader, overview: int | None = None, window: tuple[int, int, int, int] | None = None) -> Raster:
    """The part of a raster from row r0 and column c0 to before r1 and c1 (r0, r1, c0, c1), or all of it."""
    order, tags, place = header(read_at, overview)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    r0, r1, c0, c1 = window or (0, height, 0, width)
    kind = np.dtype(f"{order}{_KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS) // 8}")
    tiled = TILE_WIDTH in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, sizes = (tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES])
    across = -(-width // w)
    data = np.zeros((max(0, r1 - r0), max(0, c1 - c0)), kind.newbyteorder("="))
    for i in range(r0 // h, -(-r1 // h)):
        for j in range(c0 // w, -(-c1 // w)):
            k = i * across + j
            if not sizes[k]:
                # A block that was left out has nothing but no-data.
                got = np.full((h, w), place.nodata if place.nodata is not None else 0).astype(data.dtype)
            else:
                got = _pixels(_unpacked(read_at(offsets[k], sizes[k]), one(COMPRESSION, 1)), kind, w, samples, one(PREDICTOR, 1))[:, :, 0]
            y0, x0 = max(r0, i * h), max(c0, j * w)
            y1, x1 = min(r1, i * h + len(got)), min(c1, j * w + w)
            data[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0] = got[y0 - i * h : y1 - i * h, x0 - j * w : x1 - j * w]
    return Raster(data, place.x0 + c0 * place.dx, place.dx, place.y0 + r0 * place.dy, place.dy, place.epsg, place.nodata)


def read(raw: bytes, overview: int | None = None) -> Raster:
    """The full raster, or an overview by its number from 0."""
    return read_window(of_bytes(raw), overview)


def write(raster: Raster) -> bytes:
    """A striped 32-bit float GeoTIFF; missing is NaN."""
    data = np.ascontiguousarray(raster.data, "<f4")
    height, width = data.shape
    geographic = raster.epsg is not None and 4000 <= raster.epsg < 5000
    keys = [1, 1, 0, 3 if raster.epsg else 2, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1]
    if raster.epsg:
        keys += [2048 if geographic else 3072, 0, 1, raster.epsg]
    rows = max(1, (1 << 16) // max(1, 4 * width))
    strips = [data[k : k + rows].tobytes() for k in range(0, height, rows)]
    body = b"".join(strips)
    offsets = [8 + sum(map(len, strips[:k])) for k in range(len(strips))]
    tags = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [32]), (COMPRESSION, "H", [1]), (PHOTOMETRIC, "H", [1]), (STRIP_OFFSETS, "I", offsets), (SAMPLES, "H", [1]), (ROWS_PER_STRIP, "I", [rows]), (STRIP_SIZES, "I", [len(s) for s in strips]), (SAMPLE_FORMAT, "H", [3]),
        (PIXEL_SCALE, "d", [raster.dx, -raster.dy, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, raster.x0, raster.y0, 0.0]), (GEO_KEYS, "H", keys), (NODATA, "c", [bytes([c]) for c in b"nan\0"]),
    ]
    codes, at = {v: k for k, v in _TYPES.items()}, 8 + len(body)
    entries, more = [], b""
    begin = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        packed = struct.pack(f"<{kind * len(values)}", *values)
        if len(packed) <= 4:
            place = packed.ljust(4, b"\0")
        else:
            place = struct.pack("<I", begin + len(more))
            more += packed
        entries.append(struct.pack("<HHI", tag, codes[kind], len(values)) + place)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + b"".join(entries) + struct.pack("<I", 0) + more


def cells(data: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Rows, columns and values of a raster, many at a time."""
    height, width = data.shape
    step = max(1, most // max(1, width))
    for y in range(0, height if width else 0, step):
        part = data[y : y + step]
        row, col = np.indices(part.shape, np.int32)
        yield pa.array((row + y).ravel()), pa.array(col.ravel()), part.ravel()


def read_pixels(spark: SparkSession, path: str, overview: int | None = None) -> DataFrame:
    """PIXELS of all files of path; no-data and values that aren't finite are null. A file is decoded by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = read(raw, overview)
                v = r.data.astype(np.float64)
                v[~np.isfinite(v) | (v == r.nodata if r.nodata is not None else False)] = np.nan
                for row, col, part in cells(v):
                    yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(part), np.int32), [name]).dictionary_decode(), row, col, pa.array(part, from_pandas=True)], names=["path", "row", "col", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PIXELS)


def read_grids(spark: SparkSession, path: str, overview: int | None = None) -> DataFrame:
    """(path, x0, dx, y0, dy, ny, nx, epsg, nodata) of all files of path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, tags, r = header(of_bytes(raw), overview)
                row = [name, r.x0, r.dx, r.y0, r.dy, tags[HEIGHT][0], tags[WIDTH][0], r.epsg, r.nodata]
                kinds = [pa.string(), *[pa.float64()] * 4, *[pa.int32()] * 3, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["path", "x0", "dx", "y0", "dy", "ny", "nx", "epsg", "nodata"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, x0 double, dx double, y0 double, dy double, ny int, nx int, epsg int, nodata double")


def map_raster(grid: DataFrame, value: str, shape: tuple[int, int], **place) -> Raster:
    """A map (y, x, value) as a raster, on the driver; a map has a row for each pixel."""
    data = np.full(shape, np.nan)
    got = grid.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL").toArrow()
    data[got["y"].to_numpy(), got["x"].to_numpy()] = got["v"].to_numpy()
    return Raster(data, **place)


def write_tiff(grid: DataFrame, value: str, path: str, shape: tuple[int, int], **place) -> None:
    """A map as one GeoTIFF on the driver's machine, 32-bit float. Larger maps than MOST_PIXELS are for write_map()."""
    if shape[0] * shape[1] > MOST_PIXELS:
        raise ValueError(f"a map of {shape[0]} x {shape[1]} is too large for one file made by the driver")
    raw = write(map_raster(grid, value, shape, **place))
    with open(path, "wb") as f:
        f.write(raw)


def write_map(grid: DataFrame, value: str, path: str, metadata: dict) -> None:
    """A map of any size as Parquet (y, x, value as 32-bit float) with its grid beside it in JSON."""
    import json

    out = grid.select("y", "x", F.col(value).cast("float").alias(value))
    out.write.parquet(f"{path}/map")
    grid.sparkSession.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{path}/grid")
