"""Vectorised text helpers that run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def as_array(column) -> pa.Array:
    """One contiguous string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("")


def as_list(texts: pa.Array) -> list[str]:
    """Python strings of a string array; by way of numpy, which is several times as fast as to_pylist."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into row ranges of at most ``limit`` bytes of ``column``, so that working arrays stay bounded."""
    if not batch.num_rows:
        return
    size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size.astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers live on from stage to stage


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: the code of every word, each text's bounds in them, and the words by code."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    blank = words.index("").as_py() if len(words) else -1
    if blank >= 0:  # texts that begin or end with white space, or are empty
        keep = codes != blank
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return codes, bounds, words


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The text that each element belongs to, from the texts' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
