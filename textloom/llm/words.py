"""Words of whole batches of texts, cut from their bytes at once, for the operators that work on arrays of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: The bytes that part words. All are ASCII, so texts in UTF-8 are cut where their characters are.
NOT_ALPHANUMERIC = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class Words:
    """The words of a batch: bytes start[i]:end[i] of text are word i; text d has the words first[d]:first[d + 1]."""

    text: np.ndarray
    inside: np.ndarray  # whether a byte is in a word
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: pa.Array, between: bytes, lower: bool) -> Words:
        """Of texts (null has none). between: the bytes that part words; lower: whether A-Z get lower case."""
        column = pc.fill_null(texts, "").cast(pa.large_string())
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        table, parts = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
        table[65:91] += 32 * lower
        parts[np.frombuffer(between, np.uint8)] = True
        text, inside = table[raw], ~parts[raw]
        before, after = np.zeros(len(text), bool), np.zeros(len(text), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(text)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return Words(text, inside, start, end, np.searchsorted(start, offsets))

    def __len__(self) -> int:
        return len(self.start)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal where words are equal, and the words by their numbers."""
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        names = pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.text[self.inside])])
        coded = names.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.string())


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def gathered_batches(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to so many rows and bytes of a column; one that is larger stays as it is."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        own = batch.column(column).nbytes
        if held and (size + own > most_bytes or rows + len(batch) > most_rows):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, rows = [], 0, 0
        if len(batch):
            held, size, rows = [*held, batch], size + own, rows + len(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lists(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    """A column of one row that holds all values."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
