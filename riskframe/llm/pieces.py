"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import Shared

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters segmented at once; a bound on memory, without effect on results.
CHUNK_CHARACTERS = 1 << 17
#: Characters of the texts whose distinct units are gathered before that.
BATCH_CHARACTERS = 1 << 22
# Kinds of pieces in a model file: fixed values of its format.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


class Vocabulary:
    """Pieces, log scores and byte pieces of a SentencePiece model: a few MB, whatever the corpus."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int] | None, unknown_id: int, ids: list[int] | None = None, size: int | None = None):
        self.pieces, self.scores = pieces, scores
        self.ids = ids if ids is not None else list(range(len(pieces)))
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self.size = size if size is not None else len(pieces)
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        # A piece that holds a mark after another character would cross a unit's border.
        self.crossing = any(MARK in p.lstrip(MARK) for p in pieces)


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, read on the driver from a parameter path.  The file is never trained or changed."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    chosen = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)]
    byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
    return Vocabulary(
        [p for _, p, _ in chosen], [s for *_, s in chosen], [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None,
        model.trainer_spec.unk_id, [i for i, *_ in chosen], len(model.pieces),
    )


class DoubleArrayTrie:
    """A trie of UTF-8 pieces in integer arrays: the child of state s by byte b is base[s] + b + 1 if check there is s.

    ``value`` holds the number of the piece that ends in a state, -1 for none.
    """

    def __init__(self, words: Iterable[str]):
        root: dict = {}
        for number, word in enumerate(words):
            node = root
            for b in word.encode():
                node = node.setdefault(b + 1, {})
            node[0] = number
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        taken, first, top = bytearray(size), 1, 1
        taken[0] = 1
        waiting = [(0, root)]
        for state, node in waiting:
            labels = sorted(k for k in node if k)
            value[state] = node.get(0, -1)
            if not labels:
                continue
            # Search the last stretch only: earlier holes are not worth the time.
            first = max(first, top - 512)
            while taken[first]:
                first += 1
            at = max(0, first - labels[0])
            while True:
                while at + 258 >= size:
                    base, check, value, taken = base + [0] * size, check + [-1] * size, value + [-1] * size, taken + bytes(size)
                    size *= 2
                if not any(taken[at + k] for k in labels):
                    break
                at += 1
            base[state] = at
            for k in labels:
                taken[at + k] = 1
                check[at + k] = state
                waiting.append((at + k, node[k]))
                top = max(top, at + k)
        # A leaf's base is 0, so the arrays end one full alphabet after the last state.
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that begin at any of ``starts`` and end by the start's own ``ends``, as (start, end, number)."""
        found, state, at = [], np.zeros(len(starts), np.int32), starts
        origin = starts
        while len(at):
            live = at < ends
            origin, at, state, ends = origin[live], at[live], state[live], ends[live]
            child = self.base[state] + data[at] + 1
            fits = self.check[child] == state
            origin, at, state, ends = origin[fits], at[fits] + 1, child[fits], ends[fits]
            number = self.value[state]
            some = number >= 0
            found.append((origin[some], at[some], number[some]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (starts, starts, starts.astype(np.int32))


def best_paths(unit_starts: np.ndarray, size: int, start: np.ndarray, end: np.ndarray, score: np.ndarray, carry=None) -> np.ndarray:
    """The best way into every place of many units at once: the index of the last match taken, -1 where there is none.

    Matches of one unit meet in order of their start, and one replaces another with the same end only if its score is
    higher; so of equal paths the one with the longest last match stays.  All units advance together, one start at a
    time, which is safe as matches with the same start have different ends.  The end of a unit must not be the start of
    the next.  ``carry(chosen)`` sees each step's matches.
    """
    unit = np.searchsorted(unit_starts, start, side="right") - 1
    offset = start - unit_starts[unit]
    order = np.argsort(offset, kind="stable")
    cuts = np.flatnonzero(np.diff(offset[order], prepend=-1)).tolist() + [len(order)]
    best, via = np.full(size + 1, -np.inf), np.full(size + 1, -1, np.int64)
    best[unit_starts] = 0.0
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = order[low:high]
        total = best[start[own]] + score[own]
        better = total > best[end[own]]
        own = own[better]
        best[end[own]], via[end[own]] = total[better], own
        if carry is not None:
            carry(own)
    return via


def normalised(text: str) -> str:
    """The text with a leading space and every space written as the mark."""
    return (" " + text).replace(" ", MARK) if text else ""


def units(text: str) -> list[str]:
    """A normalised text cut before every mark that follows another character; no piece crosses such a cut."""
    return _UNIT.findall(text)


_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def chunks(distinct: Iterable[str]) -> Iterator[list[str]]:
    """Units in runs of bounded size; a longer unit is a run of its own."""
    run, size = [], 0
    for unit in distinct:
        if run and size + len(unit) > CHUNK_CHARACTERS:
            yield run
            run, size = [], 0
        run.append(unit)
        size += len(unit) + 1
    if run:
        yield run


def slices(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of bounded size; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text or "") > BATCH_CHARACTERS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run


class Ragged:
    """The distinct units of a batch, numbered, with a row of values for each."""

    def __init__(self, texts: Iterable[str | None], crossing: bool):
        self.number: dict[str, int] = {}
        number = self.number
        self.rows: list[np.ndarray | None] = []
        for text in texts:
            parts = None if text is None else ([normalised(text)] if crossing and text else units(normalised(text)))
            self.rows.append(None if parts is None else np.fromiter((number.setdefault(u, len(number)) for u in parts), np.int64, len(parts)))


class Encoder:
    """Segmentation of units in runs.  Scores are added in double precision, a unit at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.trie = DoubleArrayTrie(vocabulary.pieces)
        self.scores, self.ids = np.array(vocabulary.scores, float), np.array(vocabulary.ids, np.int32)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32) if vocabulary.byte_ids else None

    def segment(self, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each unit has.

        A character that is no piece of its own may also stand as unknown, and is written as its bytes where the model
        has byte pieces; else a run of unknown characters is one unknown id.
        """
        # A zero byte follows each unit: no place belongs to two units.
        coded = [u.encode() for u in run]
        data = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8).astype(np.int32)
        lengths = np.array([len(c) for c in coded], np.int64)
        unit_starts = np.cumsum(lengths + 1) - lengths - 1
        unit_ends = unit_starts + lengths
        begins = (data & 0xC0) != 0x80
        begins[unit_ends] = False
        starts = np.flatnonzero(begins)
        own_end = unit_ends[np.searchsorted(unit_starts, starts, side="right") - 1]
        width = np.where(data[starts] < 0x80, 1, np.where(data[starts] < 0xE0, 2, np.where(data[starts] < 0xF0, 3, 4)))
        start, end, number = self.trie.matches(data, starts, own_end)
        single = np.zeros(len(data) + 1, bool)
        first = np.searchsorted(starts, start)
        single[start[end - start == width[first]]] = True
        lone = ~single[starts]
        start, end = np.concatenate([start, starts[lone]]), np.concatenate([end, (starts + width)[lone]])
        number = np.concatenate([number, np.full(lone.sum(), -1, np.int32)])
        score = np.where(number >= 0, self.scores[number] if len(self.scores) else 0.0, self.vocabulary.unknown_score)
        via = best_paths(unit_starts, len(data), start, end, score)
        # Back from every unit's end; what is found first is last.
        taken, at = [], unit_ends
        open_units = np.flatnonzero(at > unit_starts)
        while len(open_units):
            match = via[at[open_units]]
            taken.append(match)
            at = at.copy() if at is unit_ends else at
            at[open_units] = start[match]
            open_units = open_units[at[open_units] > unit_starts[open_units]]
        match = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        match = match[np.argsort(start[match], kind="stable")]
        start, end, number = start[match], end[match], number[match]
        unit = np.searchsorted(unit_starts, start, side="right") - 1
        unknown = number < 0
        if self.byte_ids is not None:
            repeat = np.where(unknown, end - start, 1)
            place = np.cumsum(repeat) - repeat
            inner = np.arange(repeat.sum()) - np.repeat(place, repeat)
            source = np.repeat(np.arange(len(start)), repeat)
            ids = np.where(unknown[source], self.byte_ids[data[start[source] + inner]], self.ids[number[source]] if len(self.ids) else 0)
            unit = unit[source]
        else:
            joined = unknown & np.concatenate([[False], unknown[:-1]]) & (np.diff(unit, prepend=-1) == 0)
            ids = np.where(unknown, self.vocabulary.unknown_id, self.ids[number] if len(self.ids) else 0)[~joined]
            unit = unit[~joined]
        return ids.astype(np.int32), np.bincount(unit, minlength=len(run))

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray | None]:
        """Ids of many texts; each distinct unit of a run of texts is segmented once."""
        return [ids for run in slices(texts) for ids in self._encode_run(run)]

    def _encode_run(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        batch = Ragged(texts, self.vocabulary.crossing)
        done = [self.segment(run) for run in chunks(batch.number)]
        ids = np.concatenate([np.zeros(0, np.int32)] + [x for x, _ in done])
        lengths = np.concatenate([np.zeros(0, np.int64)] + [n for _, n in done])
        places = np.cumsum(lengths) - lengths
        for row in batch.rows:
            if row is None:
                yield None
                continue
            size = lengths[row]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield ids[at + np.repeat(places[row], size)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


class Decoder:
    """Bytes of every id: byte pieces are single bytes, the mark is a space, control pieces are nothing."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = [b""] * vocabulary.size
        for number, piece in zip(vocabulary.ids, vocabulary.pieces, strict=True):
            self.bytes[number] = piece.replace(MARK, " ").encode()
        for value, number in enumerate(vocabulary.byte_ids or []):
            self.bytes[number] = bytes([value])
        if not vocabulary.byte_ids:
            self.bytes[vocabulary.unknown_id] = " \u2047 ".encode()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, and the one leading space of the encoder goes."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    """Rows of ids as one Arrow array, without a Python number for each id."""
    lengths = np.array([0 if r is None else len(r) for r in rows], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int32)] + [r for r in rows if r is not None])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(np.array([r is None for r in rows], bool)))


def encoder_column(spark: SparkSession, vocabulary: Vocabulary, text: Column) -> Column:
    """Ids of a text as an array of integers.  Null gives null, an empty text an empty array."""
    shared = Shared(spark, vocabulary)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(shared.built(Encoder).encode_all(texts.to_pylist()))

    return encode(text.cast("string"))


def decoder_column(spark: SparkSession, vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of an array of ids; null gives null.  Undoes ``encoder_column`` but for U+2581, which returns as a space."""
    shared = Shared(spark, vocabulary)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        own = shared.built(Decoder)
        return pa.array([None if not r.is_valid else own.decode(r.as_py()) for r in rows], pa.string())

    return decode(ids)


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` with the ids of the whole text added, in place of a column of that name."""
    return docs.withColumn(ids, encoder_column(docs.sparkSession, vocabulary, F.col(text)))


def round_trip_column(spark: SparkSession, vocabulary: Vocabulary, text: Column) -> Column:
    """A struct of ``ids`` and ``same``: whether decoding gives back the text, spaces for U+2581.

    Null has null ids and comes back the same.  Ids are decoded where they are made, so a text is encoded once.
    """
    shared = Shared(spark, vocabulary)

    @F.arrow_udf("ids array<int>, same boolean")
    def both(texts: pa.Array) -> pa.Array:
        encoder, decoder, strings = shared.built(Encoder), shared.built(Decoder), texts.to_pylist()
        ids = encoder.encode_all(strings)
        same = [t is None or decoder.decode(i.tolist()) == t.replace(MARK, " ") for t, i in zip(strings, ids, strict=True)]
        return pa.StructArray.from_arrays([_lists(ids), pa.array(same, pa.bool_())], ["ids", "same"])

    return both(text.cast("string"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``ids``, ``n_tokens`` and ``same``, as ``round_trip_column`` has them; null has 0 tokens."""
    out = docs.select(F.col(key).alias("_key"), round_trip_column(docs.sparkSession, vocabulary, F.col(text)).alias("_out"))
    ids = F.col("_out.ids")
    return out.select(F.col("_key").alias(key), ids.alias("ids"), F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_tokens"), "_out.same")
