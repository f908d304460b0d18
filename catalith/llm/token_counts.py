"""Operator 1: exact token counts by prefix dynamic programming."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.bpe import PrefixTable, Splitter
from catalith.llm.common import map_batches

#: Bytes, about, of the words and counts that one worker keeps; beyond it the cache starts anew.
CACHED_BYTES = 128 << 20

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


class TokenIndex:
    """Counts of words and of their prefixes; each word's are computed once and kept."""

    def __init__(self, path: str):
        self.splitter, self.table = Splitter(path), PrefixTable(path)
        self.counts: dict[str, int] = {}
        self.tables: dict[str, list[int]] = {}
        self.kept = 0

    def keep(self, of: dict, piece, value, size: int):
        if self.kept > CACHED_BYTES:
            self.counts.clear()
            self.tables.clear()
            self.kept = 0
        of[piece] = value
        self.kept += 150 + 2 * len(str(piece)) + size
        return value

    def word(self, piece) -> int:
        known = self.counts.get(piece)
        return self.keep(self.counts, piece, 1 if isinstance(piece, int) else self.table.total(piece), 0) if known is None else known

    def prefixes(self, piece: str) -> list[int]:
        """Tokens of the first 0, 1, 2 ... characters of a piece, each taken as a whole word."""
        known = self.tables.get(piece)
        if known is None:
            by_byte, at, known = self.table.ended(piece), 0, [0]
            for char in piece:
                at += len(char.encode("utf-8", "surrogatepass"))
                known.append(by_byte[at])
            self.keep(self.tables, piece, known, 8 * len(known))
        return known

    def count(self, text: str) -> int:
        pieces = self.splitter.pieces(text)
        try:
            return sum(map(self.counts.__getitem__, pieces))
        except KeyError:
            return sum(map(self.word, pieces))

    def counted(self, text: str) -> Prefixes:
        return Prefixes(self, text)


class Prefixes:
    """Exact token counts of every prefix of one text, which is split once.

    Held are the running counts at the ends of its pre-tokens; what a cut leaves of a
    pre-token is looked up in the table of that word's prefixes.  Where a character may
    change its length or join its neighbour as it is normalised, pre-tokens have no
    places; there the stretches between white space, at which counts add up, stand for
    them, and what a cut leaves of one is counted by itself.
    """

    def __init__(self, index: TokenIndex, text: str):
        self.index, self.text = index, text
        found = index.splitter.spans(text)
        self.exact = found is not None
        if found is None:
            found = [(m.start(), m.end(), m[0]) for m in index.splitter.stretches(text)]
        self.starts, self.ends, self.pieces = ([f[i] for f in found] for i in range(3))
        self.running = [0]
        for piece in self.pieces:
            self.running.append(self.running[-1] + (index.word(piece) if self.exact else index.count(piece)))

    def count(self, chars: int | None = None) -> int:
        """Tokens of the first ``chars`` characters."""
        if chars is None or chars >= len(self.text):
            return self.running[-1]
        i = bisect_right(self.ends, chars)  # the pre-tokens before i are whole
        while self.exact and i and self.pieces[i - 1].isspace():  # white space may be cut otherwise at an end
            i -= 1
        if i == len(self.pieces) or self.starts[i] >= chars:
            return self.running[i]
        return self.running[i] + self.tail(i, chars - self.starts[i])

    def tail(self, i: int, chars: int) -> int:
        """Tokens of so many characters from the start of pre-token i on."""
        if self.exact and chars <= len(self.pieces[i]):
            left = self.pieces[i][:chars]
            if self.index.splitter.plain(left) == [left]:
                return self.index.prefixes(self.pieces[i])[chars]
        return self.index.count(self.text[self.starts[i] : self.starts[i] + chars])

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of ``budget`` tokens at most.

        Without places of pre-tokens: of a prefix that ``budget`` tokens hold, found by halving.
        """
        if self.running[-1] <= budget:
            return len(self.text)
        i = bisect_right(self.running, budget) - 1  # the first pre-token that doesn't fit whole
        if not self.exact:
            low, high = self.starts[i], self.ends[i]
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if self.count(middle) <= budget else (low, middle)
            return low if self.count(low) <= budget else 0
        for chars in range(self.ends[i] - self.starts[i], 0, -1):
            if self.running[i] + self.prefix_or_less(i, chars) <= budget and self.count(self.starts[i] + chars) <= budget:
                return self.starts[i] + chars
        return self.starts[i]

    def prefix_or_less(self, i: int, chars: int) -> int:
        """A cheap bound from below: the table's count, but for contractions and white space."""
        piece = self.pieces[i]
        return 1 if piece.isspace() or piece[0] == "'" else self.index.prefixes(piece)[chars]


@lru_cache(maxsize=2)
def kept_index(path: str) -> TokenIndex:
    """One index for each worker, so that a word's counts last from task to task."""
    return TokenIndex(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document with its exact token count; nothing is shuffled.

    ``fit_chars`` is the length of the longest prefix that ``limit`` tokens hold (the
    text's if it fits; see ``Prefixes.fit``).  Null texts count as empty; texts of
    any length are counted whole; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept_index(path)
        for batch in batches:
            n_bytes, n_tokens, fits = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n = index.count(text)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(n)
                fits.append(len(text) if n <= limit else index.counted(text).fit(limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, SCHEMA)
