"""Token counts by count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import Shared
from riskframe.llm.pieces import Ragged, Vocabulary, best_paths, chunks, slices


#: Units whose counts a task remembers; a bound on memory, without effect on results.
REMEMBERED = 1 << 19


class Counter:
    """Numbers of pieces of units: no segmentation is kept, only the best score and its count at every place."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.scores = np.array(vocabulary.scores, float)
        self.lengths = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, piece in enumerate(vocabulary.pieces):
            self.automaton.add_word(piece, number)
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.memory: dict[str, int] = {}

    def count(self, run: list[str]) -> np.ndarray:
        """Pieces of the best segmentation of each unit, by the encoder's rules.

        The automaton gives all pieces in one pass over the units in a row.  An unknown character counts its bytes; if
        the model has no byte pieces, it counts 1, or nothing after another one.
        """
        # A line of one character apart; matches over it are left out, if a piece should hold that character.
        joined = "\n".join(run) + "\n"
        lengths = np.fromiter(map(len, run), np.int64, len(run))
        unit_starts = np.cumsum(lengths + 1) - lengths - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined) if self.vocabulary.pieces else ()), np.int64).reshape(-1, 2)
        end, number = found[:, 0] + 1, found[:, 1]
        start = end - self.lengths[number]
        unit = np.searchsorted(unit_starts, start, side="right") - 1
        inside = end <= (unit_starts + lengths)[unit]
        start, end, number = start[inside], end[inside], number[inside]
        places = np.ones(len(joined), bool)
        places[unit_starts + lengths] = False
        places[start[end - start == 1]] = False
        lone = np.flatnonzero(places)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)[lone]
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        known = len(start)
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        score = np.concatenate([self.scores[number], np.full(len(lone), self.vocabulary.unknown_score)])
        counts, unknown_before = np.zeros(len(joined) + 1, np.int64), np.zeros(len(joined) + 1, bool)

        def carry(chosen: np.ndarray) -> None:
            before, unknown = start[chosen], chosen >= known
            if self.vocabulary.byte_ids:
                more = np.where(unknown, width[np.maximum(chosen - known, 0)] if len(width) else 1, 1)
            else:
                more = np.where(unknown & unknown_before[before], 0, 1)
            counts[end[chosen]] = counts[before] + more
            unknown_before[end[chosen]] = unknown

        best_paths(unit_starts, len(joined), start, end, score, carry)
        return counts[unit_starts + lengths]

    def count_all(self, texts: Iterable[str | None]) -> np.ndarray:
        """Counts of many texts, 0 for null; each distinct unit of a run of texts is counted once."""
        return np.array([n for run in slices(texts) for n in self._count_run(run)], np.int64)

    def _count_run(self, texts: list[str | None]) -> list[int]:
        batch = Ragged(texts, self.vocabulary.crossing)
        new = [u for u in batch.number if u not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list(batch.number)
        for run in chunks(new):
            self.memory.update(zip(run, self.count(run).tolist(), strict=True))
        counts = np.fromiter(map(self.memory.__getitem__, batch.number), np.int64, len(batch.number))
        return [0 if row is None else int(counts[row].sum()) for row in batch.rows]

    def text(self, text: str | None) -> int:
        return int(self.count_all([text])[0])


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``n_tokens`` of every row: how many ids the encoder gives for the whole text, 0 for null or empty."""
    shared = Shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.built(Counter).count_all(texts))

    return docs.select(F.col(key), counts(F.col(text).cast("string")).alias("n_tokens"))
