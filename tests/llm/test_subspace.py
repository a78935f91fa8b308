import math
import os

import numpy as np
import pytest

from rekurve.llm import subspace

CELLS = "cell_id long, features array<float>, condition int"


def plain(rows, cosine=0.93):
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])

    x = [np.array(r[1], np.float32).astype(float) if usable(r) else None for r in rows]
    links, par = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if (x[i] * x[j]).sum() / (math.sqrt((x[i] ** 2).sum()) * math.sqrt((x[j] ** 2).sum())) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    par[root(i)] = root(j)
    small = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            small[root(i)] = min(small.get(root(i), r[0]), r[0])
    return sorted(((r[0] if r[0] is not None else -1), links[i], small.get(root(i), -1), r[0] is not None and small[root(i)] == r[0]) for i, r in enumerate(rows))


def table(rng):
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    for k in range(260):  # near copies, chains, pairs about the threshold
        v = base[k % 7] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.35])
        rows.append((100 + k, (v * rng.choice([1.0, 3.0])).tolist(), k % 2))
    rows += [(500 + k, base[3].tolist(), 1) for k in range(30)] + [(500, base[3].tolist(), 1)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [None, 1.0], 1), (704, base[3].tolist(), None), (None, base[3].tolist(), 1)]
    return rows + [(705, [1.0, 0.0], 1), (706, [2.0, 0.0], 1), (707, [], 1), (708, [float("inf"), 1.0], 1), (-5, base[3].tolist(), 1)]


@pytest.mark.parametrize("rows", [8192, 40])
def test_cells(spark, monkeypatch, rows):
    monkeypatch.setattr(subspace, "TASK_ROWS", rows)  # 40: a grid, and cells that are dealt to pairs of chunks
    data = table(np.random.default_rng(5))
    d = spark.createDataFrame([(*r, 1) for r in data], CELLS + ", n_links int")
    got = sorted(((r.cell_id if r.cell_id is not None else -1), r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in subspace.near_duplicate_cells(d).collect())
    assert got == plain(data)


def test_no_cells(spark):
    assert subspace.near_duplicate_cells(spark.createDataFrame([], CELLS)).count() == 0


def shuffle_files(spark):
    """Name and size of the session's shuffle files."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: os.path.getsize(f"{d}/{f}") for top in dirs for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}


def test_vectors_are_not_copied_for_blocks_and_cells(spark):
    """One condition of 20,000 vectors: what is shuffled is a few times the input, however many blocks there are."""
    x = np.random.default_rng(6).standard_normal((20_000, 64)).astype(np.float32)
    x[1::200] = x[::200] * 2
    d = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], CELLS)
    before = shuffle_files(spark)
    got = {(r.cell_id, r.n_links, r.component_id, r.kept) for r in subspace.near_duplicate_cells(d).collect()}
    assert got == {(i, int(i % 200 < 2), i - (i % 200 == 1), i % 200 != 1) for i in range(len(x))}
    assert sum(n for f, n in shuffle_files(spark).items() if f not in before) < 5 * x.nbytes


@pytest.mark.parametrize("chunks", [1, 2])
def test_pairs_are_found_once(chunks):
    """More vectors than are compared at once, spread and crowded, of one chunk and of two."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24))
    x[500:900] = x[0] + rng.standard_normal((400, 24)) * rng.choice([0.01, 0.1, 0.25], (400, 1))
    x[900:1100] = x[:200] * 5 + rng.standard_normal((200, 24)) * 0.8
    x = x[rng.permutation(len(x))].astype(np.float32)
    chunk = rng.integers(0, chunks, len(x))
    pairs = subspace._pairs(subspace.Plan(24, 0.93, 8), x, np.flatnonzero(chunk == 0), np.flatnonzero(chunk == 1) if chunks > 1 else None, 0.93)
    got = [(min(a, b), max(a, b)) for i, j in pairs for a, b in zip(i.tolist(), j.tolist())]
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    a, b = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
    assert len(got) > 10_000 and sorted(got) == [(i, j) for i, j in zip(a.tolist(), b.tolist()) if chunks == 1 or chunk[i] != chunk[j]]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_zeros_of_either_sign_are_equal(spark, kind):
    d = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2)], CELLS.replace("float", kind))
    assert sorted(tuple(r) for r in subspace.near_duplicate_cells(d).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
