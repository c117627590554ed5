"""Recordings from MATLAB files of level 5 (plain or compressed): numeric and text variables, read by Spark as binary files.

The container holds a header of 128 bytes and elements of (type, bytes, data padded to 8 bytes); a matrix element holds
flags, dimensions, name and the real part, by columns.  Other classes (cells, structs, sparse) are passed over.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import ship

#: element types to NumPy kinds, and numbers of the classes and types that matter here (fixed values of the format)
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED, TEXT, NUMERIC, COMPLEX = 14, 15, 4, range(6, 16), 0x0800

VARIABLES = ("xy", "dir", "pos_sample_rate", "pixels_per_m", "spikes_times", "spk_sample_rate")


def _elements(data: bytes, order: str, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(type, data) of consecutive elements; up to four bytes of data may share the tag's eight."""
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def _matrix(data: bytes, order: str) -> tuple[str, np.ndarray | str | None]:
    parts = list(_elements(data, order))
    flags = struct.unpack_from(order + "I", parts[0][1])[0]
    dims = np.frombuffer(parts[1][1], order + "i4")
    name, cls = parts[2][1].decode("latin-1"), flags & 0xFF
    if cls not in (TEXT, *NUMERIC) or len(parts) < 4:
        return name, np.zeros(dims) if cls in NUMERIC else None
    values = np.frombuffer(parts[3][1], order + NUMBERS[parts[3][0]])
    if cls == TEXT:
        return name, "".join(map(chr, values))
    if flags & COMPLEX and len(parts) > 4:
        values = values + 1j * np.frombuffer(parts[4][1], order + NUMBERS[parts[4][0]])
    return name, values.reshape(dims, order="F")


def parse(content: bytes) -> dict[str, np.ndarray | str | None]:
    """Variables of a level-5 file by name."""
    if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB file of level 5")
    order = "<" if content[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray | str | None] = {}

    def take(kind: int, data: bytes) -> None:
        if kind == COMPRESSED:
            for inner in _elements(zlib.decompress(data), order):
                take(*inner)
        elif kind == MATRIX:
            name, value = _matrix(data, order)
            out[name] = value

    for kind, data in _elements(content, order, 128):
        take(kind, data)
    return out


def recording(content: bytes, name: str) -> dict[str, np.ndarray]:
    """The variables of a recording as flat arrays, xy with one row a sample."""
    found = parse(content)
    gone = [v for v in VARIABLES if found.get(v) is None]
    if gone:
        raise ValueError(f"{name} lacks {', '.join(gone)}")
    xy = np.asarray(found["xy"], dtype=float)
    out = {v: np.asarray(found[v], dtype=float).ravel() for v in VARIABLES[1:]}
    return out | {"xy": xy if xy.ndim == 2 and xy.shape[1] == 2 else xy.T}


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, spikes, recordings) of the files at a path, in the shapes that `recordings.track` takes.

    A recording's key is a hash of its file name.  Each file is parsed where it is read, once for every table asked for.
    """
    ship(spark)
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64(name).alias("cell_id"), name.alias("source_file"), "content")

    def table(rows, schema: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for cell, file, content in zip(batch["cell_id"], batch["source_file"], batch["content"]):
                    yield pd.DataFrame({"cell_id": cell, **rows(recording(bytes(content), file), file)})

        return files.mapInPandas(run, f"cell_id long, {schema}")

    def samples(r: dict, _: str) -> dict:
        return {"t": np.arange(len(r["xy"])), "x_px": r["xy"][:, 0], "y_px": r["xy"][:, 1], "dir_deg": r["dir"]}

    def meta(r: dict, file: str) -> dict:
        return {"source_file": [file], "pos_rate": r["pos_sample_rate"][:1], "px_per_m": r["pixels_per_m"][:1], "spk_rate": r["spk_sample_rate"][:1]}

    return (
        table(samples, "t long, x_px double, y_px double, dir_deg double"),
        table(lambda r, _: {"spike_sample": r["spikes_times"]}, "spike_sample double"),
        table(meta, "source_file string, pos_rate double, px_per_m double, spk_rate double"),
    )
