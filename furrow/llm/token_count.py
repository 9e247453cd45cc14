"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece of text form a linked list; every adjacent pair that is in the vocabulary waits
in a heap, best rank first and leftmost first among equals. Popping merges the pair and may push two
new ones. The count is the initial symbols minus the merges (a character outside the vocabulary stands
for its UTF-8 bytes), so no token identifier is ever made.

Merges can't cross a place where no vocabulary entry has the two neighbouring characters side by side;
texts are cut there, and counts of recurring pieces are remembered in a table of bounded size.

Defined results: a null or empty text has no tokens; special strings in a text are ordinary text.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 400_000
SPACE = "▁"


class MergeCounter:
    """Counts tokens of a byte-pair vocabulary: ``ranks`` maps a piece to its rank, lower first."""

    def __init__(self, ranks: dict[str, float], dummy_prefix: bool = True, remembered: int = REMEMBERED):
        self.ranks, self.prefix, self.remembered = ranks, dummy_prefix, remembered
        self.pairs = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}
        # words can be taken one by one only if no piece has a space mark after another character
        self.by_word = not any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        self.words = _Memo(self._count_word, remembered)
        self.parts = _Memo(self._merge, remembered)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self._count((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        if self.prefix and SPACE not in text and "" not in (found := text.split(" ")):
            return sum(map(self.words.__getitem__, found))
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return sum(self._count(m) for m in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked))

    def _count_word(self, word: str) -> int:
        return self._count(SPACE + word)

    def _count(self, piece: str) -> int:
        """Cut where no merge can cross, then add up."""
        cuts = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.pairs]
        return sum(self.parts[piece[a:b]] for a, b in zip([0, *cuts], [*cuts, len(piece)]))

    def _merge(self, piece: str) -> int:
        ranks, symbols = self.ranks, list(piece)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(ranks[two], i, i + 1, len(two)) for i in range(n - 1) if (two := symbols[i] + symbols[i + 1]) in ranks]
        heapq.heapify(waiting)
        merges = 0
        while waiting:
            _, a, b, size = heapq.heappop(waiting)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one of them is part of another merge by now
            symbols[a] += symbols[b]
            symbols[b] = ""
            merges += 1
            right[a] = c = right[b]
            if c < n:
                left[c] = a
                if (two := symbols[a] + symbols[c]) in ranks:
                    heapq.heappush(waiting, (ranks[two], a, c, len(two)))
            if (p := left[a]) >= 0 and (two := symbols[p] + symbols[a]) in ranks:
                heapq.heappush(waiting, (ranks[two], p, a, len(two)))
        outside = sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in symbols if s and s not in ranks)
        return n - merges + outside


class _Memo(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


@lru_cache(maxsize=4)
def piece_counter(model: str) -> MergeCounter:
    """The counter of a sentencepiece byte-pair model, made once in each worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model if os.path.exists(model) else SparkFiles.get(os.path.basename(model)))
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return MergeCounter({sp.id_to_piece(i): -sp.get_score(i) for i in normal})


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. ``model`` is the vocabulary file's path on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
