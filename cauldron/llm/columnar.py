"""Helpers shared by the operators: input columns, Arrow slices, words as arrays, written stage tables."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cauldron.session import write_stage_table

#: The contract's word separators: space and \x09-\x0D.
WHITE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step works on (a longer single text is a step of its own).
SLICE_BYTES = 1 << 20


def ship_package(spark) -> None:
    """Send this package's code to the executors (once a context), as --py-files would; workers then import it."""
    sc = spark.sparkContext
    if getattr(sc, "_cauldron_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cauldron-code-"), "cauldron_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)  # the driver's file server hands it to every executor, late ones too
    sc._cauldron_shipped = True


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; other columns (clashing names included) never enter an operator."""
    ship_package(df.sparkSession)
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in types.items()])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder of ``spark.checkpoint.dir`` and read it back."""
    return write_stage_table(df, f"llm-{name}")


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut so that each holds about ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(offsets_of(texts))
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    """The n + 1 byte offsets of a string array into its data buffer."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if texts.buffers()[1] is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize)
    return raw.astype(np.int64)


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows one after another, n + 1 offsets into them); a null row is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    offsets = offsets_of(texts)
    buffer = texts.buffers()[2]
    if buffer is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


def dictionary(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact codes of byte strings: (code of each, the distinct strings). ``data`` holds them back to back."""
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


# first two UTF-8 bytes of Thai and Lao, Myanmar, Khmer, kana to Han, Han outside the first plane
_UNSPACED = np.zeros(1 << 16, bool)
for _low, _high in ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B3)):
    _UNSPACED[_low:_high + 1] = True


def _unspaced_characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which characters of scripts without spaces begin and end."""
    lead = np.flatnonzero(data >= 0xE0)
    lead = lead[_UNSPACED[data[lead].astype(np.int64) << 8 | data[lead + 1]]]
    return lead, lead + np.where(data[lead] >= 0xF0, 4, 3)


class Words:
    """The words (runs of non-white bytes) of every row of a text array, as arrays.

    ``codes``: index into ``distinct`` of each word; ``starts``/``ends``: byte
    offsets in ``data``; ``rows``: n + 1 offsets of each row's words. With
    ``characters`` each character of a script without spaces (Han, kana, Thai
    and the like) is a word of its own.
    """

    def __init__(self, texts: pa.Array, characters: bool = False):
        self.data, self.bounds = data_of(texts)
        size = len(self.data)
        white = _IS_WHITE[self.data]
        edge = np.zeros(size + 1, bool)  # a row starts here, so no word runs over this place
        edge[self.bounds] = True
        before = np.ones(size, bool)
        before[1:] = white[:-1]
        begins = ~white & (before | edge[:-1])
        after = np.ones(size, bool)
        after[:-1] = white[1:]
        finishes = ~white & (after | edge[1:])
        if characters:
            begin, end = _unspaced_characters(self.data)
            begins[begin] = finishes[end - 1] = True
            finishes[begin[begin > 0] - 1] |= ~white[begin[begin > 0] - 1]
            begins[end[end < size]] |= ~white[end[end < size]]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.rows = np.searchsorted(self.starts, self.bounds)
        self.codes, self.distinct = dictionary(self.data[~white], self.starts, self.ends - self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def long_hash(column):
    """A 64-bit hash of a key used for spreading and ordering only."""
    return F.xxhash64(column)
