"""Shards of recording files of nearly equal size: best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from rekurve.llm.common import cut_lineage, positions

SHARDS = 16
#: Sizes up to this many bytes are classes of their own; larger ones keep eleven leading bits, so a class is at most 0.1 % wide.
EXACT = 1 << 16
#: Groups above this part of a shard are placed one by one.
LARGE = 1 / 256


def size_class(size: Column) -> Column:
    """The size itself, rounded up to eleven leading bits when it is above ``EXACT``: a bounded number of classes."""
    drop = F.floor(F.log2(size.cast("double"))).cast("int") - 10
    step = F.pow(F.lit(2.0), drop).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step).cast("long") * step)


class BinTree:
    """Open bins by remaining room in a treap: the tightest bin that takes a size is found in logarithmic time."""

    def __init__(self):
        self.root, self.draw = None, random.Random(1)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._cut(self.root, key)
        self.root = self._join(self._join(low, [key, self.draw.random(), None, None]), high)

    def take_tightest(self, room: int) -> tuple[int, int] | None:
        """Remove and return the least (room, bin) with at least ``room``."""
        low, high = self._cut(self.root, (room, -1))
        found, up = None, high
        while up:
            found, up = up[0], up[2]
        if found:
            _, high = self._cut(high, (found[0], found[1] + 1))
        self.root = self._join(low, high)
        return found

    def _cut(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], high = self._cut(t[3], key)
            return t, high
        low, t[2] = self._cut(t[2], key)
        return low, t

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b


def best_fit(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Place ``(size, count)`` items, largest first, each in the fullest bin that takes it; rows ``(index, bin, count)``.

    As many equal items as fit go into a bin at once.  None if an item fits nowhere and ``bins`` are open already.
    """
    tree, opened, out = BinTree(), 0, []
    for index in sorted(range(len(sizes)), key=lambda i: -sizes[i][0]):
        size, left = sizes[index]
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if size > capacity or opened == bins:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, b = found
            k = min(left, room // size)
            out.append((index, b, k))
            tree.add((room - k * size, b))
            left -= k
    return out


def smallest_capacity(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """The placement into at most ``bins`` bins with the least capacity that a bisection over best fits finds.

    An item above an equal share of what is left gets a bin of its own first.
    """
    alone, left, total = [], dict(enumerate(n for _, n in sizes)), sum(s * n for s, n in sizes)
    for index in sorted(left, key=lambda i: -sizes[i][0]):
        while left[index] and bins > 1 and sizes[index][0] * bins >= total:
            bins, total = bins - 1, total - sizes[index][0]
            alone.append((index, bins, 1))
            left[index] -= 1
        if left[index]:
            break
    sizes = [(s, left[i]) for i, (s, _) in enumerate(sizes)]
    low = max(-(-total // bins), max((s for s, n in sizes if n), default=1), 1)
    high, found = low, None
    while (found := best_fit(sizes, high, bins)) is None:
        high += max(1, high // 64)
    while high - low > max(1, low // 100_000) and low < high:
        mid = (low + high) // 2
        if (p := best_fit(sizes, mid, bins)) is None:
            low = mid + 1
        else:
            high, found = mid, p
    return alone + found


def shard_files(frap_files: DataFrame, file_id: str = "file_id", raw_data: str = "raw_data_json", shards: int = SHARDS) -> DataFrame:
    """``file_id, size, raw_crc32, law, shard, slot, grown_shard`` for every row of ``frap_files(file_id long, raw_data_json string)``.

    Law ``bytes``: shards 0 to ``shards`` - 1 get nearly the same number of bytes.  ``size`` is the UTF-8 length of the data (missing: 0)
    plus 1, ``raw_crc32`` the CRC of its bytes (missing: of none), ``slot`` counts a shard's files from 0 without a gap and
    ``grown_shard`` is null.  Files with equal data are one group and stay together; missing data is a group, empty data another.
    A group that alone is larger than an equal share makes its shard the largest, and the others share the rest.  Repeated rows are
    files of their own.  Other columns are ignored, whatever their names; an empty table gives no rows.

    Groups are classed by size; the number of classes is bounded, and so is that of groups above ``LARGE`` of a shard, which are placed
    one by one.  The driver places these counts largest first into the tightest open shard, for the least capacity that
    ``shards`` shards allow, and every group finds its shard by its rank in its class.  Only hashes and sizes are shuffled.
    """
    content = F.col(raw_data)
    d = frap_files.select(
        F.col(file_id).alias("file_id"),
        (F.coalesce(F.octet_length(content), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("raw_crc32"),
        F.unhex(F.coalesce(F.sha2(content, 256), F.lit("00"))).alias("of"),
        F.monotonically_increasing_id().alias("row"),
    )
    d = cut_lineage(d)
    groups = cut_lineage(d.groupBy("of").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files")))
    rows, total, n_groups = groups.agg(F.sum("files"), F.sum("bytes"), F.count(F.lit(1))).first()
    large = max(EXACT, int((total or 0) / shards * LARGE))
    groups = groups.withColumn("class", F.when(F.col("bytes") > large, F.col("bytes")).otherwise(size_class(F.col("bytes"))))
    counts = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class").collect()  # bounded: see above
    sizes = [(r["class"], r["n"]) for r in counts]
    upto: dict[int, list[tuple[int, int]]] = {}
    for index, b, k in smallest_capacity(sizes, shards) if sizes else []:
        held = upto.setdefault(sizes[index][0], [])
        held.append((b, (held[-1][1] if held else 0) + k))
    # most classes go to one shard as a whole; only the others need the ranks of their groups
    plan = [(c, held) for c, held in upto.items()]
    plan = frap_files.sparkSession.createDataFrame(plan, "class long, held array<struct<shard: int, upto: long>>")
    ranked = positions(groups, ["class"], ["of"], n_groups, name="rank")
    placed = ranked.join(F.broadcast(plan), "class")  # at most one row per class
    placed = cut_lineage(placed.select("of", F.filter("held", lambda h: h["upto"] > F.col("rank"))[0]["shard"].alias("shard")))
    out = positions(d.join(placed, "of").select("file_id", "size", "raw_crc32", "shard", "row"), ["shard"], ["row"], rows or 0, name="slot")
    return out.select("file_id", "size", "raw_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
