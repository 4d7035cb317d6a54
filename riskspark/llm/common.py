"""Helpers of the corpus operators: text batches, hash folds, bounded samples, added columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

SLICE_BYTES = 4_000_000  # texts that one vectorised step holds at once


def fold(key: Column, k: int) -> Column:
    """crc32 of the key's decimal text modulo ``k``; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % k


def add_fields(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """``df`` with the fields of a struct column; they replace columns of the same name."""
    taken = {n.lower() for n in names}
    held = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    inner = "_fields_of_result"
    return df.withColumn(inner, result).select(*held, *[F.col(inner)[n].alias(n) for n in names])


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive groups of texts of about ``most`` bytes; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """``slices`` of a column's UTF-8 texts, one at a time: the column is never held as a list."""
    raw = column.cast(pa.large_binary())
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(raw), 0).to_pylist()):
        if size and size + n > most:
            yield byte_texts(raw[start:i])
            start, size = i, 0
        size += n
    if start < len(raw):
        yield byte_texts(raw[start:])


def text_udf(fn: Callable[[list[bytes]], pa.Array], schema: T.DataType) -> Callable:
    """A nondeterministic Arrow UDF (so that filters do not run it twice) over slices of texts.

    Every slice's result goes out as a batch of its own, so a worker holds one slice and its result."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for part in text_slices(column):
                yield fn(part)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()


def struct_array(**columns) -> pa.Array:
    """A struct array from named columns."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def concat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the length of each text."""
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def hashed_share(df: DataFrame, key: str, most: int, seed: str) -> tuple[DataFrame, Column]:
    """About 1.1 * ``most`` rows chosen by a hash of the key, and the hash; one count gives the share."""
    rank = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    rate = int(min(1.0, 1.1 * most / max(df.count(), 1)) * (1 << 40))
    return df.where(rank < rate), rank


def hashed_sample(df: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows of ``df`` in the order of a hash of the key: the same at every run."""
    share, rank = hashed_share(df, key, most, seed)
    return share.orderBy(rank, key).limit(most)
