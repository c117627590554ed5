"""Running NumPy functions over text columns in Arrow batches of bounded bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm._text import CHUNK_BYTES, buffers, chunks
from tessera.runtime import ship


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with this package at hand on the executors; a task gives its free memory back when it ends."""
    ship(df.sparkSession)
    names = df.columns
    if any("." in c or "`" in c for c in names):  # mapInArrow looks columns up by unquoted names
        df = df.toDF(*[f"c{k}" for k in range(len(names))])

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.rename_columns(names) for batch in batches)
        release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Return freed memory to the system, as idle Python workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def columns(names: list[str]) -> list[str]:
    """Distinct names quoted for select, as they may hold dots."""
    return ["`" + c.replace("`", "``") + "`" for c in dict.fromkeys(names)]


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `limit` bytes of text (a longer row stands alone)."""
    _, offsets = buffers(batch.column(text))
    for i, j in chunks(offsets, limit):
        yield batch.slice(i, j - i)


def map_text(
    docs: DataFrame,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    text: str = "text",
    filtered: bool = False,
    read: tuple[str, ...] = (),
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """Rows of docs with columns `keep` and the computed `fields`.

    make() runs once a task; what it returns maps a record batch (of at most
    `limit` bytes of text, or one row) to the computed columns.  With `filtered`, it also returns "__keep", a boolean mask of rows.
    A computed column takes the place of a kept one of the same name; columns of
    `read` are read and not returned.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    source = docs.select(*columns([*keep, text, *read]))
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, text, limit):
                made = work(batch)
                out = pa.RecordBatch.from_arrays(
                    [(made[f.name] if f.name in made else batch.column(f.name)).cast(f.type) for f in arrow], schema=arrow
                )
                yield out.filter(made["__keep"]) if filtered else out

    return map_arrow(source, run, schema)


def strings(parts: bytes, lengths: np.ndarray) -> pa.Array:
    """String column from concatenated UTF-8 bytes and row lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(parts))
