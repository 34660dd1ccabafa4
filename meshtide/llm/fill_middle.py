"""Fill-in-the-middle texts: cuts at unit boundaries, found by select on a boundary set.

The ends of a text's units form a set of code point offsets, held in the manner
of a Roaring bitmap: one container for each 65,536 offsets, an array, a bitmap or
a list of runs, whichever is smallest, and the cumulative cardinalities of the
containers. The k-th boundary is found by a search over the cumulative
cardinalities and a select inside one container; no list of units is made.

The two cuts and the form of a text follow from its id alone (SHA-256 of
``seed:id``), so a lost task that runs again returns the same rows.

Defined results: null text counts as empty; an empty text, and one that holds a
sentinel, stays plain; a null id draws as the empty id; repeated rows give equal
rows; an empty table gives an empty result; other columns are not looked at. A
text is held whole in one task, four bytes for each of its code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut, and of those so many are written suffix first.
RATE, SPM_RATE = 50, 80
SPAN = 1 << 16
ARRAY, BITMAP, RUN = "array", "bitmap", "run"


@dataclass(frozen=True)
class Container:
    """The boundaries of one span: sorted offsets, 64-bit words, or (first, last) runs."""

    kind: str
    data: np.ndarray

    @staticmethod
    def of(low: np.ndarray) -> Container:
        """The smallest container of sorted distinct offsets below SPAN."""
        gaps = np.flatnonzero(np.diff(low) > 1)
        sizes = {ARRAY: 2 * len(low), BITMAP: SPAN // 8, RUN: 4 * (len(gaps) + 1)}
        kind = min(sizes, key=sizes.__getitem__)
        if kind == ARRAY:
            return Container(kind, low.astype(np.uint16))
        if kind == RUN:
            return Container(kind, np.stack([low[np.append(0, gaps + 1)], low[np.append(gaps, len(low) - 1)]]).astype(np.int32))
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        return Container(kind, np.packbits(bits, bitorder="little").view(np.uint64))

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        if self.kind == ARRAY:
            return int(self.data[k])
        if self.kind == RUN:
            ends = np.cumsum(self.data[1] - self.data[0] + 1)
            at = int(np.searchsorted(ends, k, "right"))
            return int(self.data[1][at] - (ends[at] - 1 - k))
        ends = np.cumsum(np.bitwise_count(self.data), dtype=np.int64)
        at = int(np.searchsorted(ends, k, "right"))
        word = np.flatnonzero(np.unpackbits(self.data[at : at + 1].view(np.uint8), bitorder="little"))
        return 64 * at + int(word[k - (ends[at - 1] if at else 0)])


class BoundarySet:
    """Sorted distinct offsets in containers, with select."""

    def __init__(self, offsets: np.ndarray):
        high, start = np.unique(offsets >> 16, return_index=True)
        self.base = high << 16
        self.containers = [Container.of(part & (SPAN - 1)) for part in np.split(offsets, start[1:])] if len(offsets) else []
        self.through = np.append(start[1:], len(offsets)) if len(offsets) else start  # cumulative cardinalities
        self.size = len(offsets)

    def select(self, k: int) -> int:
        """Offset after ``k`` units; 0 for none."""
        if k == 0:
            return 0
        c = int(np.searchsorted(self.through, k, "left"))
        return int(self.base[c]) + self.containers[c].select(k - 1 - (int(self.through[c - 1]) if c else 0))


def boundaries(text: str, unit: str = "word") -> BoundarySet:
    """Ends of a text's units, in code points.

    ``word``: white space with the word that follows it, or the white space at the
    end (``[\\x20\\x09-\\x0D]``). ``char``: every code point.
    """
    if unit == "char":
        return BoundarySet(np.arange(1, len(text) + 1, dtype=np.int64))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    last = np.ones(len(points), bool)  # a word's last point, or the last of the text
    last[:-1] = ~space[:-1] & space[1:]
    return BoundarySet(np.flatnonzero(last).astype(np.int64) + 1)


def draws(key: str, seed: int = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers that follow from ``seed`` and ``key``."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(h[4 * k : 4 * k + 4], "big") for k in range(4))


def cut(text: str, key: str, unit: str = "word", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int, int]:
    """Number of units, form, and the code points before the first and the second cut (0 for plain texts)."""
    found = boundaries(text, unit)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return found.size, "plain", 0, 0
    first, second = sorted((h1 % (found.size + 1), h2 % (found.size + 1)))
    return found.size, "spm" if h4 % 100 < spm_rate else "psm", found.select(first), found.select(second)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "word", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row.

    ``rate`` of a hundred texts are cut, ``spm_rate`` of a hundred of those are
    written as suffix, prefix, middle, the others as prefix, suffix, middle.
    """

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, form, x, y = cut(text, key, unit, seed, rate, spm_rate)
                head, tail = PREFIX + text[:x], SUFFIX + text[y:]
                out = text if form == "plain" else (head + tail if form == "psm" else tail + head) + MIDDLE + text[x:y]
                plain = form == "plain"
                rows.append((n, form, None if plain else x, None if plain else y - x, out))
            n, form, x, m, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(x, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that :func:`transformed` was given. A cut text holds no sentinel, and none can arise across a cut, since each begins with ``<`` alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
