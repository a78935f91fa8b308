"""Near-duplicate cells: vectors of features that point the same way, found by a join of low-dimensional subspaces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rekurve.llm.common import components, cut_lineage, ship_package

COSINE, BLOCKS = 0.93, 8
#: Vectors of one condition in a chunk; a task joins two chunks, and conditions with more than two are dealt to pairs of chunks.
TASK_ROWS = 65536
#: Rows compared at once, rows in reach that they are compared with at once, and pairs verified at once.
SLICE, REACH, PAIRS = 128, 2048, 1 << 16
#: What a squared distance of parts of unit vectors may be off in 32 bits.
ROUNDING = 4e-6


class Plan:
    """Rotation, blocks and distance budget for unit vectors of ``dim`` components."""

    def __init__(self, dim: int, cosine: float, blocks: int):
        q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
        self.turn = q * np.sign(np.diag(r))
        self.parts = [p for p in np.array_split(np.arange(dim), blocks) if len(p)]
        reach = np.sqrt((2 - 2 * cosine) / len(self.parts))
        self.budget = float(reach * (1 + 1e-6) + 1e-6) ** 2  # coordinates are rounded to 32 bits
        self.whole = len(self.parts) * self.budget * (1 + 1e-5)

    def rotate(self, x: np.ndarray) -> list[np.ndarray]:
        """The blocks of the rotated unit vectors."""
        out = [np.empty((len(x), len(p)), np.float32) for p in self.parts]
        for s in range(0, len(x), 8192):
            u = x[s : s + 8192].astype(np.float64)
            u /= np.abs(u).max(1, keepdims=True)
            u /= np.sqrt((u * u).sum(1, keepdims=True))
            u = u @ self.turn
            for o, p in zip(out, self.parts):
                o[s : s + 8192] = u[:, p]
        return out


@lru_cache(maxsize=8)
def plan_for(dim: int, cosine: float, blocks: int) -> Plan:
    """One plan for all groups of a task."""
    return Plan(dim, cosine, blocks)


def _in_reach(b: np.ndarray, rows: np.ndarray, others: np.ndarray | None, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``rows`` and one of ``others`` (none: pairs within ``rows``) whose parts ``b`` are within the budget, and few more.

    ``rows`` are halved along one coordinate after the other; a half keeps those others whose squared distance from its box, summed up
    from cut to cut, stays within the budget.
    """
    budget += ROUNDING
    square = np.einsum("ij,ij->i", b, b)[:, None]
    one, columns = np.ones_like(square), np.ascontiguousarray(b.T)
    left, right = np.hstack([-2 * b, square, one]), np.hstack([b, one, square])
    none, wide = np.empty(0, np.int64), (np.full(b.shape[1], -np.inf, np.float32), np.full(b.shape[1], np.inf, np.float32))
    some = none if others is None else others
    stack = [(rows, some, np.zeros(len(some), np.float32), *wide, 0)]
    apart, under = np.empty(SLICE * REACH, np.float32), np.zeros(SLICE * REACH + 8, bool)  # one buffer for all comparisons
    while stack:
        rows, some, gap, low, high, c = stack.pop()
        if len(rows) <= SLICE:
            a = left[rows]
            if others is None:
                i, j = np.nonzero(np.triu(a @ right[rows].T <= budget, 1))
                yield rows[i], rows[j]
            for s in range(0, len(some), REACH):
                far = some[s : s + REACH]
                n = len(rows) * len(far)
                np.less_equal(np.matmul(a, right[far].T, out=apart[:n].reshape(len(rows), -1)), budget, out=under[:n].reshape(len(rows), -1))
                under[n : n + 8] = False
                at = 8 * np.flatnonzero(under[: -(-n // 8) * 8].view(np.int64))  # few are near: eight are looked at together
                at = (at[:, None] + np.arange(8)).ravel()
                at = at[under[at]]
                yield rows[at // len(far)], far[at % len(far)]
            continue
        half, x = len(rows) // 2, columns[c]
        rows = rows[np.argpartition(x[rows], half)]
        down, up = rows[:half], rows[half:]
        end, begin = x[down].max(), x[up].min()
        y = x[some]
        outside = np.maximum(np.maximum(low[c] - y, y - high[c]), 0) ** 2
        for part, lo, hi in ((down, low[c], end), (up, begin, high[c])):
            now = gap - outside + np.maximum(np.maximum(lo - y, y - hi), 0) ** 2
            near = np.flatnonzero(now <= budget)
            kept, now = some[near], now[near]
            if others is None and part is down:  # the upper half is among the others of the lower
                step = (x[up] - end) ** 2
                close = np.flatnonzero(step <= budget)
                kept, now = np.concatenate([kept, up[close]]), np.concatenate([now, step[close]])
            if others is None or len(kept):
                lows, highs = low.copy(), high.copy()
                lows[c], highs[c] = lo, hi
                stack.append((part, kept, now, lows, highs, (c + 1) % b.shape[1]))


def _pairs(plan: Plan, x: np.ndarray, rows: np.ndarray, others: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that are within the budget in some block and whose cosine is at least ``cosine``, each once: from the first such block."""
    blocks = plan.rotate(x)
    norm = np.concatenate([np.sqrt((v * v).sum(1)) for v in (x[s : s + 8192].astype(np.float64) for s in range(0, len(x), 8192))])

    def verified(k: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(0, len(i), PAIRS):
            p, q = i[s : s + PAIRS], j[s : s + PAIRS]
            far = np.zeros(len(p), np.float32)
            for c in [k, *range(k), *range(k + 1, len(blocks))]:
                gap = ((blocks[c][p] - blocks[c][q]) ** 2).sum(1)
                far = far + gap
                left = far <= plan.whole
                if c <= k:
                    left &= (gap <= plan.budget) == (c == k)
                p, q, far = p[left], q[left], far[left]
            alike = (x[p].astype(np.float64) * x[q].astype(np.float64)).sum(1) / (norm[p] * norm[q]) >= cosine
            yield p[alike], q[alike]

    for k, b in enumerate(blocks):
        held, n = [], 0
        for pair in _in_reach(b, rows, others, plan.budget):
            held.append(pair)
            n += len(pair[0])
            if n >= PAIRS:
                yield from verified(k, *map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from verified(k, *map(np.concatenate, zip(*held)))


def _named(vectors: DataFrame) -> DataFrame:
    """``vectors`` with a digest ``name`` in place of ``features``, which equal vectors share, and no others; 0 and -0 are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if p.num_rows:
                f = p.column("features")
                x, ends = f.flatten().to_numpy(zero_copy_only=False) + 0.0, f.offsets.to_numpy() - f.offsets[0].as_py()
                raw, ends = memoryview(x.tobytes()), (ends * x.itemsize).tolist()
                names = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in others), pa.array(names, pa.binary())], [*others, "name"])

    others = [c for c in vectors.columns if c != "features"]
    return vectors.mapInArrow(run, T.StructType([*(vectors.schema[c] for c in others), T.StructField("name", T.BinaryType())]))


def near_duplicate_cells(
    cell_features: DataFrame, cell_id: str = "cell_id", features: str = "features", condition: str = "condition", cosine: float = COSINE, blocks: int = BLOCKS
) -> DataFrame:
    """``cell_id, n_links, component_id, kept`` for every row of ``cell_features(cell_id long, features array<float>, condition)``.

    Cells of one condition whose feature vectors have a cosine of at least ``cosine`` (0 to 1) link; ``n_links`` counts a cell's links,
    ``component_id`` is the smallest id that links reach and ``kept`` marks the cell that has that id.  A row with a missing id, condition
    or vector, a vector of zeros or with a missing or non-finite component links with nothing: no links, its own component.  Vectors of
    different lengths never link.  Equal vectors are joined once and count as links of each other; repeated rows count as further cells.
    Other columns are ignored, whatever their names; an empty table gives no rows.

    Unit vectors are rotated at random and cut into ``blocks`` of few dimensions.  Linked vectors are at most 2 - 2 cosine apart
    (squared), so within 1 / blocks of that in some block.  A task holds the different vectors of a condition, or two chunks of a large
    one, once for all blocks; it range-joins each block under that budget and verifies what it finds on the whole vectors.  A task
    gives for each vector its number of links and one edge of a tree, never pairs.
    """
    spark = cell_features.sparkSession
    ship_package(spark)
    kind = cell_features.select(F.col(features)).schema[0].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    d = cell_features.select(F.col(cell_id).cast("long").alias("cell_id"), F.col(features).cast(f"array<{kind}>").alias("features"), F.col(condition).alias("condition"))
    fine = F.forall("features", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("features", lambda v: v != 0)
    d = d.withColumn("fits", F.coalesce(fine & F.col("cell_id").isNotNull() & F.col("condition").isNotNull(), F.lit(False)))
    classes = cut_lineage(d.filter("fits").groupBy("condition", "features").agg(F.min("cell_id").alias("node"), F.count(F.lit(1)).alias("n")))
    sized = classes.select("condition", F.size("features").alias("dim"), "node", "n", "features")
    crowded = sized.groupBy("condition", "dim").agg(F.count(F.lit(1)).alias("n_all")).filter(F.col("n_all") > 2 * TASK_ROWS)
    crowded = cut_lineage(crowded.select("condition", "dim", F.ceil(F.col("n_all") / TASK_ROWS).cast("int").alias("chunks")))
    dealt = sized.join(F.broadcast(crowded), ["condition", "dim"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))  # at most a row for each two chunks
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"c1": F.least("chunk", "k"), "c2": F.greatest("chunk", "k")}).drop("chunks", "k")

    def join(key: tuple, t: pa.Table) -> pa.Table:
        dim, c1, c2 = (v.as_py() for v in key[1:])
        x = t["features"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        node, n, chunk = (t[c].to_numpy() for c in ("node", "n", "chunk"))
        links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
        for i, j in _pairs(plan_for(dim, cosine, blocks), x, np.flatnonzero(chunk == c1), None if c1 == c2 else np.flatnonzero(chunk == c2), cosine):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            while len(i):
                while (parent != parent[parent]).any():
                    parent = parent[parent]
                i, j = parent[i], parent[j]
                apart = i != j
                i, j = i[apart], j[apart]
                np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        while (parent != parent[parent]).any():
            parent = parent[parent]
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "to": node[parent[some]]})

    found = cut_lineage(dealt.groupBy("condition", "dim", "c1", "c2").applyInArrow(join, "node long, links long, to long"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    of = _named(classes).join(degree, "node", "left").join(groups, "node", "left")
    of = cut_lineage(of.select("condition", "name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    named = _named(d.filter("fits").drop("fits"))  # whole vectors are shuffled no second time
    linked = named.join(of, ["condition", "name"]).select("cell_id", "n_links", "component_id")
    alone = d.filter("not fits").select("cell_id", F.lit(0).cast("long").alias("n_links"), F.col("cell_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("cell_id") == F.col("component_id"), F.lit(False)))
