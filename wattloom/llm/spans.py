"""Runs of bytes in whole texts by numpy: words of many texts at once, numbered exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lookup(spaces: bytes) -> np.ndarray:
    """By byte, whether it belongs to a word."""
    word = np.ones(256, bool)
    word[list(spaces)] = False
    return word


#: Words are what stands between these bytes: blank and U+0009 to U+000D.
BETWEEN_BLANKS = lookup(b" \t\n\x0b\x0c\r")


class Texts:
    """The bytes of a binary Arrow column and where each text begins; null is empty."""

    def __init__(self, column: pa.Array):
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        if len(column) == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        offsets = np.frombuffer(column.buffers()[1], kind)
        offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def code_points(self) -> np.ndarray:
        """The number of code points before each byte, and of all."""
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The text that holds each byte."""
        return np.searchsorted(self.offsets, places, "right") - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end, given by byte whether it belongs to one."""
        full = np.flatnonzero(np.diff(self.offsets))
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside.copy()
        before[self.offsets[full]] = False
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside.copy()
        after[self.offsets[full + 1] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def numbered(compact: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    """Equal runs of bytes get equal numbers; ``compact`` holds the runs one after the other."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    runs = pa.Array.from_buffers(
        pa.large_binary(),
        len(lengths),
        [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(compact))],
    )
    return runs.dictionary_encode()
