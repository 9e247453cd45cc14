"""Fill-in-the-middle transformation: a wavelet matrix over the character classes of whole texts finds both cuts.

The UTF-8 bytes of a group of documents are mapped to eight classes (continuation byte, newline, other
blank, digit, letter, other ASCII, lead of two bytes, lead of three or four), and one wavelet matrix of
three levels is built over them. The number of units that begin before a byte is the sum of the ranks of
the classes that begin one; the byte where a cut falls is found by bisection on these ranks, for both
cuts of all documents of the group at once.

A document's draws come from a hash of seed and id, so the outcome depends on the row only, not on
partitions. Cuts are uniform over the places between units, both ends included.

Defined results: a null text counts as empty; an empty text, and one that contains a sentinel, stays
plain; a null id counts as the empty string in the hash; rows that repeat an id are each transformed by
the same draws; a text longer than ``GROUP_BYTES`` makes a group of its own, with half a byte of index a
byte of text; an empty table gives an empty result; only the named columns are read, so other columns
can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 1
#: Percent of texts that are transformed, and of these with the suffix first.
RATE, SPM_RATE = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
GROUP_BYTES = 4 << 20

CONTINUATION, NEWLINE, BLANK, DIGIT, LETTER, OTHER, LEAD_2, LEAD_LONG = range(8)
LEVELS = 3
#: Classes whose bytes begin a unit: code points; lines (each newline begins one); words (each blank begins one).
UNITS = {"char": (NEWLINE, BLANK, DIGIT, LETTER, OTHER, LEAD_2, LEAD_LONG), "line": (NEWLINE,), "word": (NEWLINE, BLANK)}


def _class_of(byte: int) -> int:
    if byte >= 0x80:
        return CONTINUATION if byte < 0xC0 else LEAD_2 if byte < 0xE0 else LEAD_LONG
    c = chr(byte)
    return NEWLINE if c == "\n" else BLANK if c.isspace() else DIGIT if c.isdigit() else LETTER if c.isalpha() else OTHER


CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)


class WaveletMatrix:
    """Ranks of small symbols: how often one occurs before a position, for whole vectors of positions."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for k in reversed(range(levels)):
            ones = (symbols >> k & 1).astype(bool)
            packed = np.zeros(-(-(len(ones) + 1) // 64) * 8, np.uint8)
            packed[: -(-len(ones) // 8)] = np.packbits(ones, bitorder="little")
            bits = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits[:-1]), dtype=np.int64)])
            self.levels.append((bits, before, int(len(ones) - np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(bits[word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``at`` symbols."""
        low, high = np.zeros(1, np.int64), at
        for k, (bits, before, zeros) in enumerate(self.levels):
            a, b = self._ones(bits, before, low), self._ones(bits, before, high)
            low, high = (zeros + a, zeros + b) if symbol >> (len(self.levels) - 1 - k) & 1 else (low - a, high - b)
        return high - low[0]


class Units:
    """Where units begin in a group of texts laid end to end."""

    def __init__(self, data: np.ndarray, unit: str):
        self.matrix, self.classes = WaveletMatrix(CLASS[data]), UNITS[unit]

    def before(self, at: np.ndarray) -> np.ndarray:
        """Units that begin among the first ``at`` bytes: the ranks of their classes, added up."""
        return sum(self.matrix.rank(c, at) for c in self.classes)

    def cut(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The last place in each text before which no more than ``k`` of its units begin, by bisection."""
        most, low, high = self.before(start) + k, start.copy(), end.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = self.before(mid) <= most
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low


def _transformed(texts: list[bytes], h: np.ndarray, unit: str, rate: int, spm_rate: int, sentinels: tuple[bytes, bytes, bytes]) -> tuple[list, ...]:
    """(outputs, units, forms, prefix sizes, middle sizes) of a group of texts; ``h`` has four draws a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    units = Units(np.frombuffer(b"".join(texts), np.uint8), unit)
    first, n = units.before(start), units.before(end)
    n = n - first
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    x, y = units.cut(start, end, low) - start, units.cut(start, end, high) - start
    p, s, m = sentinels
    outputs, forms, prefix, middle = [], [], [], []
    for k, t in enumerate(texts):
        if not t or h[2][k] % 100 >= rate or any(mark in t for mark in sentinels):
            outputs.append(t)
            forms.append("plain")
            prefix.append(None)
            middle.append(None)
            continue
        head, mid, tail = t[: x[k]], t[x[k] : y[k]], t[y[k] :]
        spm = h[3][k] % 100 < spm_rate
        outputs.append(s + tail + p + head + m + mid if spm else p + head + s + tail + m + mid)
        forms.append("spm" if spm else "psm")
        prefix.append(int(low[k]))
        middle.append(int(high[k] - low[k]))
    return outputs, n.tolist(), forms, prefix, middle


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """One row per document: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (units; null if plain), output (the text to train on)."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    marks = tuple(m.encode() for m in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            group, size = 0, 0
            for k in range(len(texts) + 1):
                if k < len(texts) and (k == group or size + len(texts[k]) <= GROUP_BYTES):
                    size += len(texts[k])
                    continue
                if k > group:
                    h = np.stack([np.asarray(b.column(2 + j).slice(group, k - group)) for j in range(4)])
                    out, n, form, prefix, middle = _transformed(texts[group:k], h, unit, rate, spm_rate, marks)
                    cols = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(group, k - group), *cols], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                group, size = k, len(texts[k]) if k < len(texts) else 0

    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("long").alias(f"h{j}") for j in range(4)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t")
    done = docs.select(F.col(id_col).alias("id"), text, *draws).mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return done.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text again, from an output and its form alone (no transformed text contains a sentinel)."""
    p, s, m = sentinels

    def after(text: Column, mark: str, part: Column) -> Column:
        return F.substr(text, F.length(part) + len(mark) + 1)

    def halves(text: Column, mark: str) -> tuple[Column, Column]:
        part = F.substring_index(text, mark, 1)
        return part, after(text, mark, part)

    body = F.substr(output, F.lit(len(p) + 1))
    head, rest = halves(body, s)
    tail, middle = halves(rest, m)
    suffix_first = F.substr(output, F.lit(len(s) + 1))
    tail_2, rest_2 = halves(suffix_first, p)
    head_2, middle_2 = halves(rest_2, m)
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(head_2, middle_2, tail_2)).otherwise(output)
