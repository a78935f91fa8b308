"""Packing tokenized experiment descriptions into as few training sequences as can be: best-fit decreasing over all of them at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rekurve.llm.bpe import WordTokenizer
from rekurve.llm.common import cut_lineage, ranks, ship_package

WINDOW, END_ID = 4096, 1


class Capacities:
    """A segment tree over remaining capacities 0 to ``window``; a leaf keeps the runs ``(first, last + 1)`` of sequences with that much room.

    A node tells if any sequence below it is open, so the least capacity that is large enough takes one way up and one down.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, run: tuple[int, int]) -> None:
        self.runs.setdefault(room, []).append(run)
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of an open sequence that is at least ``need``."""
        node = self.leaves + need
        if self.any[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            node = self.leaves + room
            self.any[node] = False
            while node > 1 and not self.any[node ^ 1]:
                node //= 2
                self.any[node] = False
        return run


def best_fit_runs(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go, given how many there are of each length from 1 to ``window``: rows ``(length, rank, sequence, each, offset)``.

    Longest first, a piece goes into the open sequence with the least room that takes it, else into a new one.  Pieces of one length are
    placed together: they fill one sequence as often as it takes them, then the next with the same room, as they would one by one.  From
    ``rank`` on, pieces of the length lie ``each`` to a sequence, from ``sequence`` and ``offset`` on.  A length adds two runs of new
    sequences at most and cuts two in two, so the number of rows depends on the window alone, however many pieces there are.
    """
    tree, opened, out = Capacities(window), 0, []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                low, high = opened, opened + -(-left // each)
                opened = high
            else:
                (low, high), each = tree.take(room), room // length
            rank, full = counts[length] - left, min(high - low, left // each)
            if full:
                out.append((length, rank, low, each, window - room))
                tree.put(room - each * length, (low, low + full)) if room > each * length else None
                left -= full * each
            rest = min(left, each - 1) if full < high - low else 0
            if rest:
                out.append((length, rank + full * each, low + full, rest, window - room))
                tree.put(room - rest * length, (low + full, low + full + 1))
                left, full = left - rest, full + 1
            if full < high - low:
                tree.put(room, (low + full, high))
    return out


def pieces(description: Column, path: str, window: int, end_id: int) -> Column:
    """The ids and an end id, cut into windows if there are more than one takes: an array of ``piece, start, length, ids_crc32``."""

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer, end, size = WordTokenizer(path, native=True), np.array([end_id], "<u4").tobytes(), 4 * window
        for s in batches:
            out = []
            for text in s:
                ids = memoryview(tokenizer.ids_of(text) + end)
                cuts = range(0, len(ids), size)
                out.append([{"piece": k, "start": k * window, "length": len(ids[a : a + size]) // 4, "ids_crc32": zlib.crc32(ids[a : a + size])} for k, a in enumerate(cuts)])
            yield pd.Series(out)

    return run.asNondeterministic()(description)


def place(spark: SparkSession, length: Column, rank: Column, runs: list[tuple[int, int, int, int, int]]) -> Column:
    """``sequence_id, offset`` of the piece with this rank among those of its length."""
    sent = spark.sparkContext.broadcast(np.array(sorted(runs), np.int64).reshape(-1, 5))  # bounded by the window, see best_fit_runs

    @F.pandas_udf("sequence_id long, offset long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rows = sent.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for n, r in batches:
            n, r = n.to_numpy(np.int64), r.to_numpy(np.int64)
            at = rows[np.searchsorted(keys, (n << 48) + r, "right") - 1]
            k = r - at[:, 1]
            yield pd.DataFrame({"sequence_id": at[:, 2] + k // at[:, 3], "offset": at[:, 4] + k % at[:, 3] * n})

    return run(length, rank)


def pack_tightly(experiments: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, experiment_id: str = "experiment_id", description: str = "description") -> DataFrame:
    """``experiment_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``experiments(experiment_id, description string)``.

    A description is its ids from the tokenizer file at ``path`` (a place that every executor has), then ``end_id``; missing and empty ones
    are the end id alone.  Only one with more than ``window`` ids is cut, into full windows and a last piece that may be shorter.  ``start``
    counts the description's ids before the piece, ``offset`` the ids before it in its sequence; ``ids_crc32`` is that of its ids as
    little-endian 32-bit integers.  Repeated rows are packed each, and what has equal length is interchangeable; other columns are ignored,
    whatever their names; an empty table gives no rows.

    All pieces are packed together: their lengths are counted (at most ``window`` different ones), the counts are packed by best fit, and
    each piece finds its sequence by its rank among those of its length.  Only lengths and check sums are shuffled.
    """
    ship_package(experiments.sparkSession)
    d = experiments.select(F.col(experiment_id).alias("experiment_id"), F.monotonically_increasing_id().alias("row"), pieces(F.col(description), path, window, end_id).alias("p"))
    d = cut_lineage(d.select("experiment_id", "row", F.inline("p")))
    counts = {r["length"]: r["count"] for r in d.groupBy("length").count().collect()}  # at most one row for each length
    d = ranks(d, ["length"], ["row", "piece"])
    d = d.withColumn("at", place(experiments.sparkSession, F.col("length"), F.col("rank"), best_fit_runs(counts, window)))
    return d.select("experiment_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
