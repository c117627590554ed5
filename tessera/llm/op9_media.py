"""Media columns: Netpbm and BMP images as binary columns.

`decode` turns Netpbm (P1-P6) and uncompressed BMP bytes into NumPy arrays,
`area_resize` averages exact pixel areas through an integral image, `npy_tile`
writes an array as .npy bytes and `difference_hash` compares neighbours of a
9 x 8 reduction.

`store` keeps any text as image bytes without loss (payload = UTF-8 plus spaces
up to a positive multiple of 192 bytes, 64 RGB pixels a row; an even number of
rows is stored as binary PPM, an odd one as 24-bit BMP) and `features` reads
such a column back.  Both are row-wise maps: no shuffle, bounded batches.

Edge cases: a null or empty text is one row of 64 blank pixels; texts of any length
are stored whole; an empty table gives an empty result; equal texts give
equal bytes; null ids pass through; a null media row has null features; `store`
reads no other columns; `features` passes other columns through under any name, but
for those it computes (`payload_bytes`, `payload_sha256`, `tail_crc32`, `feature`,
`tile`), which it replaces; bytes that are no image of these formats raise.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._arrow import map_text
from tessera.llm._store import table
from tessera.llm._text import buffers

WIDTH = 64
ROW = 3 * WIDTH
TILE = 32


def encode_ppm(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, rows bottom up, blue first, rows padded to four bytes."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), dtype=np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    body = rows.tobytes()
    header = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    return header + info + body


def _netpbm_header(blob: bytes, count: int) -> tuple[list[int], int]:
    """`count` numbers after the magic and the offset past the one byte that ends them; '#' starts a comment."""
    values, at = [], 2
    while len(values) < count:
        while blob[at : at + 1].isspace() or blob[at : at + 1] == b"#":
            at = blob.index(b"\n", at) + 1 if blob[at : at + 1] == b"#" else at + 1
        end = at
        while blob[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad netpbm header")
        values.append(int(blob[at:end]))
        at = end
    return values, at + 1


def decode_netpbm(blob: bytes) -> np.ndarray:
    """uint8 array (h, w) for P1, P2, P4, P5 or (h, w, 3) for P3, P6; other maxima are scaled to 255."""
    kind = blob[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not netpbm")
    bits = kind in (b"P1", b"P4")
    values, at = _netpbm_header(blob, 2 if bits else 3)
    w, h = values[:2]
    top = 1 if bits else values[2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        digits = [c - 48 for line in blob[at:].split(b"\n") for c in line.split(b"#")[0] if c in b"01"]
        data = 1 - np.array(digits[: w * h], dtype=np.int64)
    elif kind == b"P4":
        packed = np.frombuffer(blob, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        data = 1 - np.unpackbits(packed, axis=1)[:, :w].astype(np.int64)
    elif kind in (b"P2", b"P3"):
        words = b"\n".join(line.split(b"#")[0] for line in blob[at:].split(b"\n")).split()
        data = np.array(words[: w * h * depth], dtype=np.int64)
    else:
        data = np.frombuffer(blob, ">u2" if top > 255 else np.uint8, w * h * depth, at)
    if data.size != w * h * depth:
        raise ValueError("short netpbm data")
    if top != 255:
        data = (data.astype(np.int64) * 255 + top // 2) // top
    return data.reshape((h, w, 3) if depth == 3 else (h, w)).astype(np.uint8, copy=False)


def decode_bmp(blob: bytes) -> np.ndarray:
    """uint8 array (h, w, 3), red first; 1, 4, 8 (palette), 24 and 32 bits without compression."""
    if blob[:2] != b"BM":
        raise ValueError("not bmp")
    start, size, w, h, _, depth, packing = struct.unpack_from("<IIiiHHI", blob, 10)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported bmp")
    flip, h = h > 0, abs(h)
    stride = (w * depth + 31) // 32 * 4
    rows = np.frombuffer(blob, np.uint8, stride * h, start).reshape(h, stride)
    if depth >= 24:
        out = rows[:, : w * depth // 8].reshape(h, w, depth // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", blob, 46)[0] or 1 << depth
        palette = np.frombuffer(blob, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, :w]
        out = palette[bits @ (1 << np.arange(depth)[::-1])]
    return out[::-1] if flip else out


def decode(blob: bytes) -> np.ndarray:
    return decode_bmp(blob) if blob[:2] == b"BM" else decode_netpbm(blob)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma times 1000 as int64, so that sums are exact."""
    if pixels.ndim == 2:
        return pixels.astype(np.int64) * 1000
    return pixels.astype(np.int64) @ np.array([299, 587, 114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the exact (fractional) source area of every target pixel, as float64."""
    h, w = image.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=integral[1:, 1:])

    def at(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.arange(parts + 1) * n / parts
        low = np.minimum(edges.astype(np.int64), n - 1)
        return low, edges - low

    y, fy = at(h, height)
    x, fx = at(w, width)
    rows = integral[y] * (1 - fy)[:, None] + integral[y + 1] * fy[:, None]
    corner = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums * (height * width) / (h * w)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = np.rint(area_resize(image, 8, 9))
    bits = np.packbits((small[:, :-1] < small[:, 1:]).reshape(-1))
    return bits.tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image area-resized to size x size grey levels, as the bytes of an .npy file."""
    tile = np.clip(np.rint(area_resize(image, size, size) / 1000), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0))
    return out.getvalue()


def _store():
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        raw, offsets = buffers(batch.column("text"))
        data, media = raw.tobytes(), []
        for a, b in zip(offsets[:-1], offsets[1:]):
            n = int(b - a)
            rows = max(1, -(-n // ROW))
            pixels = np.frombuffer(data[a:b].ljust(rows * ROW), dtype=np.uint8).reshape(rows, WIDTH, 3)
            media.append(encode_bmp(pixels) if rows % 2 else encode_ppm(pixels))
        return {"n_bytes": pa.array(np.diff(offsets)), "media": pa.array(media, pa.binary())}

    return work


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8) and media (image bytes) of docs(doc_id, text)."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return map_text(docs, ["doc_id"], fields, _store)


FEATURES = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("tile", T.BinaryType()),
]


def _features():
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        columns: dict[str, list] = {f.name: [] for f in FEATURES}
        for blob in batch.column("media").to_pylist():
            if blob is None:
                for values in columns.values():
                    values.append(None)
                continue
            pixels = decode(blob)
            payload = pixels.tobytes()
            image = grey(pixels)
            columns["payload_bytes"].append(len(payload))
            columns["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            columns["tail_crc32"].append(zlib.crc32(payload[-16:]))
            columns["feature"].append(difference_hash(image))
            columns["tile"].append(npy_tile(image))
        return {f.name: pa.array(columns[f.name], to_arrow_type(f.dataType)) for f in FEATURES}

    return work


def features(stored: DataFrame) -> DataFrame:
    """Adds what is read back from the media column: payload digests, difference hash and NPY tile."""
    return map_text(stored, stored.columns, FEATURES, _features, text="media")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features(store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.sha2("tile", 256).alias("tile_sha256"),
    )
