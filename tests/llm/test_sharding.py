import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from rekurve.llm import sharding

FILES = "file_id long, raw_data_json string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), max_size=12), st.integers(60, 90))
def test_best_fit(sizes, capacity):
    """Against best-fit decreasing item by item over a list."""
    rooms, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i][0]):
        for _ in range(sizes[i][1]):
            fit = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i][0]]
            if not fit:
                rooms.append(capacity)
                fit = [(capacity, len(rooms) - 1)]
            rooms[min(fit)[1]] -= sizes[i][0]
            want.append((i, min(fit)[1]))
    got = [(i, b) for i, b, k in sharding.best_fit(sizes, capacity) for _ in range(k)]
    assert Counter(got) == Counter(want)


def check(rows, got, shards=16):
    assert len(got) == len(rows)
    assert Counter((r.file_id, r.size, r.raw_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sums = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = defaultdict(set)
    for r in got:
        text[r.size, r.raw_crc32].add(r.shard)
    assert all(len(s) == 1 for (size, _), s in text.items() if size > 1)
    return [sums[k] for k in range(shards)]


def test_even(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "é" * int(rng.integers(0, 400)) + str(i % 2500)) for i in range(3000)] + [(9000 + i, "copy " * 50) for i in range(40)] + [(5, None), (5, None), (6, ""), (None, "x")] + [(7000 + i, chr(65 + i) * 90_000) for i in range(5)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], FILES + ", size int, shard int").repartition(5)
    sums = check(rows, sharding.shard_files(d).collect(), 16)
    assert max(sums) - min(sums) <= 0.01 * max(sums)


def test_hot_group(spark):
    rows = [(i, "z" * 500) for i in range(300)] + [(1000 + i, f"n{i}" * 40) for i in range(600)]
    sums = check(rows, sharding.shard_files(spark.createDataFrame(rows, FILES)).collect())
    rest = sorted(sums)[:-1]
    assert max(sums) == 300 * 501 and max(rest) - min(rest) <= 0.1 * max(rest)


def test_small(spark):
    assert sharding.shard_files(spark.createDataFrame([], FILES)).count() == 0
    assert [tuple(r)[3:] for r in sharding.shard_files(spark.createDataFrame([(1, "a")], FILES)).collect()] == [("bytes", 15, 0, None)]
