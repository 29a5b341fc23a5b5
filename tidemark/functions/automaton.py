"""All phrases of a lexicon in one scan of the text.

The phrases are an Aho-Corasick automaton over UTF-8 bytes, built once by a worker. A batch of lower-cased texts is scanned as it lies in
Arrow's buffer, all rows in one go; a match that would reach over the end of its row is none. The time depends on the bytes
and the matches, not on how many phrases there are.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many phrases a search for each of them in compiled code is as fast as the way to Python and back.
FEW = 24


@lru_cache(16)
def _automaton(phrases: tuple[str, ...]) -> tuple[ahocorasick.Automaton, np.ndarray]:
    raw = [p.encode() for p in phrases]
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for k, p in enumerate(raw):
        found.add_word(p.decode("latin-1"), k)  # a byte is a character here
    if raw:
        found.make_automaton()
    return found, np.array([len(p) for p in raw], np.int64)


def matches(column: pa.Array, phrases: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, phrase and 0-based code point of the last character of every match in a column of texts: by row and place, longer phrases first."""
    automaton, size = _automaton(phrases)
    none = np.zeros(0, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(size) or not len(column):
        return none, none, none
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    flat = np.fromiter(itertools.chain.from_iterable(automaton.iter(data.tobytes().decode("latin-1"))), np.int64)
    end, phrase = flat[0::2], flat[1::2]
    start = end - size[phrase] + 1
    row = np.searchsorted(offsets, start, "right") - 1
    inside = end < offsets[row + 1]
    end, phrase, row = end[inside], phrase[inside], row[inside]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return row, phrase, points[end + 1] - points[offsets[row]] - 1


def _lists(row: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))


def distinct_phrases(phrases: tuple[str, ...]) -> tuple[str, ...]:
    """Lower-cased, each once, in their order."""
    return tuple(p for p in dict.fromkeys(x.lower() for x in phrases) if p)


def scan(low: Column, phrases: tuple[str, ...]) -> Column:
    """array<struct<phrase, end_index>> of all matches in a lower-cased text."""

    @F.arrow_udf("array<struct<phrase:string,end_index:int>>")
    def scanned(column: pa.Array) -> pa.Array:
        row, phrase, end = matches(column, phrases)
        names = pa.array(phrases, pa.string()).take(pa.array(phrase))
        return pa.ListArray.from_arrays(_lists(row, len(column)), pa.StructArray.from_arrays([names, pa.array(end.astype(np.int32))], names=["phrase", "end_index"]))

    return scanned(low)


def hits(low: Column, phrases: tuple[str, ...]) -> Column:
    """How many different phrases a lower-cased text has."""

    @F.arrow_udf("int")
    def counted(column: pa.Array) -> pa.Array:
        row, phrase, _ = matches(column, phrases)
        once = np.unique(row * max(len(phrases), 1) + phrase)
        return pa.array(np.bincount(once // max(len(phrases), 1), minlength=len(column)).astype(np.int32))

    return counted(low)
