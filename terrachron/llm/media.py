"""Media columns (operator 3): Netpbm and BMP to numpy, area resizing, NPY tiles, difference hashes.

Decoders give uint8 arrays (rows, columns, channels). Resizing takes exact area means
from an integral image that is only kept at the rows and columns where output cells
begin, so an image of any height needs memory for itself and one block of rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.plans.tables import written

_ROWS = 4096


def write_pgm(pixels: np.ndarray) -> bytes:
    """A binary grey map (P5) of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with samples of up to 8 bits -> uint8 (rows, columns, 1 or 3).

    Samples are scaled to 0..255 where the largest one allowed is another; bit maps give
    0 and 255. ValueError for a header that is cut short, an image without pixels, a
    raster shorter than the header says, and samples over the largest one allowed.
    """
    kind, at, numbers = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not Netpbm")
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d{1,9})(?!\d)").match(data, at)
        if not m:
            raise ValueError("Netpbm header ends early")
        numbers.append(int(m[1]))
        at = m.end()
    width, height = numbers[:2]
    channels = 3 if kind in (b"P3", b"P6") else 1
    most = numbers[2] if len(numbers) > 2 else 1
    if not 0 < most < 256:
        raise ValueError("samples of more than 8 bits")
    if not width or not height:
        raise ValueError("no pixels")
    n = width * height * channels
    if kind in (b"P4", b"P5", b"P6"):
        stored = height * ((width + 7) // 8) if kind == b"P4" else n
        if len(data) - at - 1 < stored:
            raise ValueError("Netpbm raster ends early")
        values = np.frombuffer(data, np.uint8, stored, at + 1)
        if kind == b"P4":
            values = np.unpackbits(values.reshape(height, -1), axis=1)[:, :width]
    else:
        rest = re.sub(rb"#[^\n]*", b"", data[at:])
        if len(rest) < n:
            raise ValueError("Netpbm raster ends early")
        found = re.findall(rb"[01]" if kind == b"P1" else rb"\d+", rest)[:n]
        if len(found) != n or any(len(x) > 3 for x in found):
            raise ValueError("Netpbm raster ends early or has too large a sample")
        values = np.array(found).astype(np.int64)
    if kind in (b"P1", b"P4"):
        values = (1 - values) * 255
    elif values.max() > most:
        raise ValueError(f"a sample over {most}")
    elif most != 255:
        values = np.rint(values * (255 / most))
    return values.astype(np.uint8, copy=False).reshape(height, width, channels)


def write_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of (rows, columns, 3)."""
    h, w = pixels.shape[:2]
    row = (3 * w + 3) // 4 * 4
    raster = np.zeros((h, row), np.uint8)
    raster[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + h * row, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * row, 2835, 2835, 0, 0) + raster.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits -> uint8 (rows, columns, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    offset, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (8, 24, 32):
        raise ValueError("BMP kind not read")
    if w <= 0 or not h:
        raise ValueError("no pixels")
    row = (w * bits + 31) // 32 * 4
    if len(data) - offset < abs(h) * row:
        raise ValueError("BMP raster ends early")
    raster = np.frombuffer(data, np.uint8, abs(h) * row, offset).reshape(abs(h), row)
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256 or len(data) - 14 - head < used * 4:
            raise ValueError("BMP palette ends early")
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        if raster[:, :w].max() >= used:
            raise ValueError("a sample outside the palette")
        out = palette[raster[:, :w]]
    else:
        out = raster[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return out[::-1] if h > 0 else out


def _edges(n: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * (n / parts)


def _prefix(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Integral along axis 1 of (rows, columns, channels), at fractional columns."""
    whole = np.concatenate([np.zeros_like(sums[:, :1]), np.cumsum(sums, axis=1)], axis=1)
    lo = np.minimum(edges.astype(int), sums.shape[1] - 1)
    return whole[:, lo] + (edges - lo)[None, :, None] * sums[:, lo]


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means, float64 (rows, columns, channels); sizes need not divide and may grow."""
    h, w = pixels.shape[:2]
    ys = _edges(h, rows)
    at = np.zeros((rows + 1, w, pixels.shape[2]))
    total, k = np.zeros((w, pixels.shape[2])), 0
    for start in range(0, h, _ROWS):
        block = pixels[start : start + _ROWS]
        part = np.concatenate([np.zeros((1, *block.shape[1:]), np.uint32), np.cumsum(block, axis=0, dtype=np.uint32)])
        while k <= rows and ys[k] < start + len(block):
            lo = int(ys[k])
            at[k] = total + part[lo - start] + (ys[k] - lo) * block[lo - start]
            k += 1
        total = total + part[-1]
    at[k:] = total
    grid = _prefix(at, _edges(w, columns))
    cells = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return cells / ((h / rows) * (w / columns))


def npy_tile(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: is a cell of the 8 x 9 grey thumbnail darker than its right neighbour? Equal areas stay equal: means are taken to six decimals."""
    grey = area_resize(pixels, 8, 9).mean(axis=2).round(6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def decode(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def tiles(images: DataFrame, side: int = 32) -> DataFrame:
    """(id, data binary) -> id, height, width, tile (NPY of side x side x channels uint8), dhash, error.

    Null, empty or unreadable data: null results and a reason in ``error``; the row
    stays. Repeated rows stay, other columns are ignored.
    """

    def one(data: bytes | None) -> tuple:
        try:
            p = decode(data or b"")
            return p.shape[0], p.shape[1], npy_tile(np.rint(area_resize(p, side, side)).astype(np.uint8)), difference_hash(p), None
        except (ValueError, struct.error) as e:
            return None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                cols = list(zip(*map(one, b.column(1).to_pylist()), strict=True)) or [()] * 5
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "height", "width", "tile", "dhash", "error"])

    return images.select(F.col("id").cast("long").alias("id"), F.col("data").cast("binary").alias("data")).mapInArrow(run, "id long, height int, width int, tile binary, dhash string, error string")


def stored_text(raw: bytes | None) -> bytes:
    """The grey map that stores a text's bytes, 64 samples to a row, padded with 0 to one row at least."""
    raw = raw or b""
    padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    return write_pgm(np.frombuffer(padded, np.uint8).reshape(-1, 64))


def store_media(docs: DataFrame, side: int = 32, at_once: int = 200) -> DataFrame:
    """(doc_id, text) -> a written table doc_id, n_bytes, media (grey map), tile (NPY of side x side x 1 uint8), dhash.

    A text's bytes are stored as they are, valid UTF-8 or not. Null text is empty; repeated
    rows are stored again; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                b, rows = whole.slice(at, at_once), []
                for text in b.column(1):
                    raw = text.as_py()
                    media = stored_text(raw)
                    p = read_netpbm(media)
                    rows.append((len(raw or b""), media, npy_tile(np.rint(area_resize(p, side, side)).astype(np.uint8)), difference_hash(p)))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "media", "tile", "dhash"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return written(own.mapInArrow(run, "doc_id long, n_bytes long, media binary, tile binary, dhash string"), "media", "zstd")


def read_media(stored: DataFrame) -> DataFrame:
    """Output of :func:`store_media` -> as :func:`text_media`; payload and tile are read from the stored grey map and NPY tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            rows = []
            for data, npy in zip(b.column(2), b.column(3), strict=True):
                media = data.as_py()
                payload = read_netpbm(media).tobytes()
                tile = np.lib.format.read_array(io.BytesIO(npy.as_py()), allow_pickle=False)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(tile.tobytes()).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), b.column(4)],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile_sha256", "feature"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media", "tile", "dhash").mapInArrow(run, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tile_sha256, feature.

    Grey maps, NPY tiles and difference hashes are stored first; all columns come from
    the table that is read back. ``tile_sha256`` is of the stored tile's pixels, ``feature`` the
    stored difference hash. Null text is empty: one row of 64 zero samples. Equal texts
    have equal values; repeated rows each have a row; other columns are ignored, whatever their names; no rows give no rows.
    """
    return read_media(store_media(docs))
