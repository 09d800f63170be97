"""What several operators share: folds of documents, and texts as flat byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def no_clash(keep: tuple[str, ...], results: tuple[str, ...]) -> None:
    """Raises if columns to keep have names of results, in any case of letters."""
    clash = {c.lower() for c in results} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"keep uses names of results: {sorted(clash)}")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and where each value starts and ends in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type) or pa.types.is_binary_view(column.type):
        column = column.cast(pa.large_binary())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        none = column.is_null().to_numpy(zero_copy_only=False)
        ends[none] = starts[none]
    return raw, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of values that hold about ``size`` bytes together; a longer value is a run of its own."""
    total = np.cumsum(ends - starts)
    i = 0
    while i < len(starts):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + size, side="right")))
        yield i, j
        i = j
