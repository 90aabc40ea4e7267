"""Words and syllables of texts, counted with arrays inside the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are counted at once; a longer text is counted alone.
CHUNK = 1 << 20
COUNTS = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("syllables", T.IntegerType())])
_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_VOWEL = np.zeros(256, dtype=bool)
_VOWEL[list(b"aeiouy")] = True
#: UTF-8 of the white space of ``text.SPACE`` beyond ASCII, by its first byte.
_WIDE = {}
for _code in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _bytes = chr(_code).encode()
    _WIDE.setdefault(_bytes[0], []).append(_bytes[1:])


def _space(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    found = _ASCII_SPACE[data]
    if len(data) and data.max() > 0x7F:
        padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
        for first, rests in _WIDE.items():
            at = np.flatnonzero(data == first)
            for rest in rests:
                hit = at
                for i, byte in enumerate(rest, 1):
                    hit = hit[padded[hit + i] == byte]
                for i in range(len(rest) + 1):
                    found[hit + i] = True
    return found


def count_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, syllables) of each row of lower-cased UTF-8 text.

    A word has a syllable for each group of vowels, one less with a final e behind another group, and one without vowels.
    """
    letter, vowel = ~_space(data), _VOWEL[data]
    # whether a byte follows one of its row
    inner = np.ones(len(data) + 1, dtype=bool)
    inner[offsets] = False
    begins = letter & ~(np.concatenate([[False], letter[:-1]]) & inner[:-1])
    ends = letter & ~(np.concatenate([letter[1:], [False]]) & inner[1:])
    groups_before = np.concatenate([[0], np.cumsum(vowel & ~(np.concatenate([[False], vowel[:-1]]) & inner[:-1]))])
    starts = np.flatnonzero(begins)
    groups = np.diff(groups_before[np.append(starts, len(data))])
    silent = (groups >= 2) & (data[np.flatnonzero(ends)] == ord("e"))
    before = np.concatenate([[0], np.cumsum(groups - silent + (groups == 0))])
    first = np.searchsorted(starts, offsets)
    return np.diff(first), np.diff(before[first])


def _counted(texts: pa.Array) -> pa.Array:
    values = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = values.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[values.offset: values.offset + len(values) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    words, syllables = np.zeros(len(values), dtype=np.int32), np.zeros(len(values), dtype=np.int32)
    at = 0
    while at < len(values):
        stop = max(int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1, at + 1)
        words[at:stop], syllables[at:stop] = count_words(every[offsets[at]: offsets[stop]], offsets[at: stop + 1] - offsets[at])
        at = stop
    return pa.StructArray.from_arrays([pa.array(words), pa.array(syllables)], names=["words", "syllables"])


def words_and_syllables(lowered: Column) -> Column:
    """Counts of a lower-cased text; zeros for null."""
    return F.arrow_udf(_counted, COUNTS)(lowered)
