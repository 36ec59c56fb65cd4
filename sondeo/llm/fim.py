"""Fill-in-middle: texts cut into prefix, middle and suffix at unit borders.

Counting a text's units leaves a sparse index: every ``EVERY`` units a checkpoint with the
unit's number, byte offset and code-point offset.  A cut is found by binary search among the
checkpoints and a short scan from the one before it, so neither a list of all units nor a
second pass over the text is needed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, batches_of_texts, extended, free_name

EVERY = 256
#: Bytes that a scan from a checkpoint looks at a time.
STRIDE = 1 << 14
MARKS = ("<P>", "<S>", "<M>")


def line_starts(part: np.ndarray, before: int) -> np.ndarray:
    """True where a line ``[^\\n]*\\n|[^\\n]+`` begins: after a line feed (or the text's begin)."""
    return np.concatenate([[before], part[:-1]]) == 10


def char_starts(part: np.ndarray, before: int) -> np.ndarray:
    """True where a code point begins."""
    return (part & 0xC0) != 0x80


UNITS = {"line": line_starts, "char": char_starts}


class SparseIndex:
    """The number of a text's units, and where every ``every``-th of them begins."""

    def __init__(self, text: bytes, unit: str = "line", every: int = EVERY):
        self.buf, self.starts = np.frombuffer(text, np.uint8), UNITS[unit]
        self.numbers, self.bytes, self.points = [], [], []
        units = points = 0
        for at, part, new, begun in self.blocks(0, BLOCK):
            places = np.flatnonzero(new)
            chosen = places[(-units) % every :: every]
            before = np.cumsum(begun, dtype=np.int64)
            self.numbers += range(units + (-units) % every, units + len(places), every)
            self.bytes += (at + chosen).tolist()
            self.points += (points + before[chosen] - 1).tolist()
            units += len(places)
            points += int(before[-1])
        self.units, self.length = units, points

    def blocks(self, at: int, step: int):
        """``(offset, bytes, where units begin, where code points begin)`` from an offset on."""
        while at < len(self.buf):
            part = self.buf[at : at + step]
            yield at, part, self.starts(part, int(self.buf[at - 1]) if at else 10), char_starts(part, 0)
            at += step

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit begins; the text's end for the number of units."""
        if unit >= self.units:
            return len(self.buf), self.length
        i = bisect_right(self.numbers, unit) - 1
        left, points = unit - self.numbers[i], self.points[i]
        for at, _, new, begun in self.blocks(self.bytes[i], STRIDE):
            places = np.flatnonzero(new)
            if left < len(places):
                return at + int(places[left]), points + int(np.count_nonzero(begun[: places[left]]))
            left -= len(places)
            points += int(np.count_nonzero(begun))
        raise AssertionError("units end before their count")


def draws(seed: int, key) -> list[int]:
    """Four numbers below 2**32 from a seed and a row's key (null: an empty one)."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = "line", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with ``fim_units`` (number of units), ``fim_form`` (``psm``, ``spm`` or
    ``plain``), ``fim_prefix_chars`` and ``fim_middle_chars`` (null if plain) and
    ``fim_text``.  ``rate`` percent of the texts are cut, of these ``spm_rate`` percent
    begin with the suffix; cuts and forms follow from the seed and the row's key alone.

    Null counts as empty; empty texts and those that hold one of the marks stay plain.
    Rows with equal keys are cut by the same draws; null keys draw like an empty one.  Columns
    named like one of the new ones are replaced, all others pass through; an empty table
    gives no rows.  One pass, row by row; a text is held with its output and its index."""
    add = "fim_units long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_text string"
    fresh = [c.split()[0] for c in add.split(", ")]
    kept = [c for c in docs.columns if c not in fresh]
    src = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{key}`").cast("string").alias(free_name("key", kept)), F.col(f"`{text}`").cast("binary").alias(free_name("bytes", kept)))
    schema = extended(docs.select(*(F.col(f"`{c}`") for c in kept)).schema, add)
    p_mark, s_mark, m_mark = (m.encode() for m in marks)

    def one(t: bytes, k):
        index = SparseIndex(t, unit)
        h1, h2, h3, h4 = draws(seed, k)
        if not t or any(m in t for m in (p_mark, s_mark, m_mark)) or h3 % 100 >= rate:
            return index.units, "plain", None, None, t
        a, b = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
        (a, pa_), (b, pb) = index.cut(a), index.cut(b)
        if h4 % 100 < spm_rate:
            return index.units, "spm", pa_, pb - pa_, b"".join((s_mark, t[b:], p_mark, t[:a], m_mark, t[a:b]))
        return index.units, "psm", pa_, pb - pa_, b"".join((p_mark, t[:a], s_mark, t[b:], m_mark, t[a:b]))

    def run(batches):
        for batch in batches:
            for first, texts in batches_of_texts(batch.column(len(kept) + 1)):
                rest = batch.slice(first, len(texts))
                cols = list(zip(*(one(t, k) for t, k in zip(texts, rest.column(len(kept)).to_pylist()))))
                made = [pa.array(c, f) for c, f in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rest.columns[: len(kept)], *made, pa.array(cols[4], pa.binary()).cast(pa.string())], names=[*kept, *fresh])

    return src.mapInArrow(run, schema)


def restored(text: str | Column = "fim_text", form: str | Column = "fim_form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: a form's three parts stand between its marks, of
    which each occurs once."""
    text, form = (F.col(c) if isinstance(c, str) else c for c in (text, form))
    part = F.split(text, "|".join(re.sub(r"(\W)", r"\\\1", m) for m in marks))
    return F.when(form == "plain", text).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
