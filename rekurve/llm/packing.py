"""Packing tokenized experiment descriptions into training sequences: best-fit decreasing over a segment tree of free room."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rekurve.llm.bpe import WordTokenizer
from rekurve.llm.common import cut_lineage, fresh_worker, ship_package

WINDOW, END_ID = 4096, 2
#: Pieces that one task packs; a task leaves at most one loosely filled sequence.
TASK_PIECES = 8192


class Rooms:
    """Open sequences by free room; every node of a binary tree counts the sequences below it."""

    def __init__(self, window: int):
        self.n = 1 << window.bit_length()
        self.count = [0] * (2 * self.n)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = self.n + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return a sequence with the least room that is at least ``need``, and its room."""
        count, i = self.count, self.n + need
        while not count[i]:
            while i > 1 and i & 1:
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.n:
            i *= 2
            if not count[i]:
                i += 1
        room = i - self.n
        while i:
            count[i] -= 1
            i >>= 1
        return self.open[room].pop(), room


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, for pieces of 1 to ``window`` tokens."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms, n = Rooms(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = rooms.take(need)
        if found is None:
            found, n = (n, window), n + 1
        s, room = found
        sequence[i], offset[i] = s, window - room
        if room > need:
            rooms.add(room - need, s)
    return sequence, offset


PIECES = "array<struct<start: long, length: long, ids_crc32: long>>"


def pieces(description: Column, path: str, window: int = WINDOW, end_id: int = END_ID) -> Column:
    """The ids and an end id, cut into full windows and a rest: an array of ``start, length, ids_crc32``."""

    @F.pandas_udf(PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh_worker()
        tokenizer, end = WordTokenizer(path, native=True), np.array([end_id], "<u4").tobytes()
        for s in batches:
            out = []
            for text in s:
                ids = tokenizer.ids_of(text) + end
                out.append([{"start": a // 4, "length": len(b) // 4, "ids_crc32": zlib.crc32(b)} for a in range(0, len(ids), 4 * window) for b in [ids[a : a + 4 * window]]])
            yield pd.Series(out)

    return run.asNondeterministic()(description)


def pack_notes(experiments: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, experiment_id: str = "experiment_id", description: str = "description") -> DataFrame:
    """``experiment_id, start, length, ids_crc32, note_tokens, sequence_id, offset`` for every piece of ``experiments(experiment_id, description string)``.

    A description is its ids from the tokenizer file at ``path`` (a place that every executor has), then ``end_id``; missing and empty
    ones are the end id alone.  One with more than ``window`` tokens is first cut into full windows and a rest.  Pieces go, longest first,
    into the open sequence with the least room that takes them.  ``start`` counts the description's ids before the piece, ``offset`` the
    ids before it in its sequence, ``ids_crc32`` is that of its ids as little-endian 32-bit integers.  Repeated rows are packed
    each; other columns are ignored, whatever their names; an empty table gives no rows.

    Only lengths are shuffled.  They are dealt by a hash of their row into parts of about ``TASK_PIECES``, and each part is packed for
    itself, whatever the size of the table; ``sequence_id`` is the part and the sequence's number in it.
    """
    ship_package(experiments.sparkSession)
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), F.monotonically_increasing_id().alias("row"), pieces(F.col(description), path, window, end_id).alias("p"))
    d = d.withColumn("note_tokens", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]))
    d = cut_lineage(d.select("experiment_id", "row", "note_tokens", F.inline("p")))
    parts = max(1, -(-d.count() // TASK_PIECES))
    kind = d.schema["experiment_id"].dataType.simpleString()

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["row", "start"], ignore_index=True)
        sequence, offset = best_fit(p.length.to_numpy(), window)
        return p.drop(columns=["row", "part"]).assign(sequence_id=(key[0] << 32) + sequence, offset=offset)

    d = d.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(parts)).cast("long"))
    schema = f"experiment_id {kind}, note_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = d.groupBy("part").applyInPandas(pack, schema)
    return out.select("experiment_id", "start", "length", "ids_crc32", "note_tokens", "sequence_id", "offset")
