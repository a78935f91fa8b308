"""Near-duplicate experiment descriptions: SimHash fingerprints and a binary-trie self-join under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rekurve.llm.common import components, cut_lineage, ship_package, width

SHINGLE_WORDS, BITS, SEED = 3, 3, 42
#: Distinct fingerprints below one top node that a single task joins; more are dealt to pairs of subtrees.
NODE_LIMIT = 50_000
#: Node pairs held at once, and leaf pairs compared at once.
FRONTIER, LEAVES = 1 << 16, 32


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """The hash of every shingle in order; a text of fewer words is one shingle, and one without words has none."""
    t = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white-space bytes only
    if not t:
        return np.zeros(0, np.uint64)
    if len(t) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(t), SEED)], np.uint64)
    line, digest = b" ".join(t), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, t), np.int64, len(t)) + 1)
    a, b = [0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist()
    return np.fromiter([digest(line[i:j], SEED) for i, j in zip(a, b)], np.uint64, len(b))


def fingerprint_of_hashes(h: np.ndarray) -> int:
    """A bit is 1 if more than half of the shingle hashes have it; 0 where there is none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints_of(text: str | None, words: int = SHINGLE_WORDS, tables: int = 1) -> list[int]:
    """The fingerprint of a text; tables after the first mix the shingle hashes anew."""
    h = shingles_of(text, words)
    out = []
    for table in range(tables):
        if table:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        out.append(fingerprint_of_hashes(h))
    return out


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return fingerprints_of(text, words)[0]


def fingerprints(description: Column, words: int = SHINGLE_WORDS, tables: int = 1) -> Column:
    """An array of ``tables`` times 64 bits as longs."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.array(fingerprints_of(t, words, tables), np.uint64).view(np.int64) for t in s])

    return run.asNondeterministic()(description)  # so that a filter on it doesn't compute it twice


def _links(vals: np.ndarray, group: np.ndarray, side: np.ndarray, bits: int, others: list[np.ndarray] = [], apart: int = 0) -> np.ndarray:
    """Pairs of nodes of the binary tries over ``vals``, walked together; returns for each row the first row it is linked to.

    Rows are sorted by group and value.  A node is a row range whose values share the leading bits.  ``side`` is 0 in a group that joins
    with itself; a group with sides 1 and 2 joins the one with the other.  With ``others`` a pair also has at most ``apart`` differing bits
    in its values and these further fingerprints together.
    """
    n = len(vals)
    parent = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def root(i):
        r = parent[i]
        while True:
            q = parent[r]
            if (q == r).all():
                parent[i] = r
                return r
            r = q

    def link(i, j):
        while len(i):
            i, j = root(i), root(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))

    def compare(l1, h1, l2, h2):
        n1, n2 = h1 - l1, h2 - l2
        size = n1 * n2
        start = np.cumsum(size) - size
        k = np.arange(int(size.sum())) - np.repeat(start, size)
        w = np.repeat(n2, size)
        i, j = np.repeat(l1, size) + k // w, np.repeat(l2, size) + k % w
        near = (i < j) & (np.bitwise_count(vals[i] ^ vals[j]) <= bits)
        i, j = i[near], j[near]
        if others:
            total = sum((np.bitwise_count(v[i] ^ v[j]).astype(np.int64) for v in (vals, *others)), np.zeros(len(i), np.int64))
            i, j = i[total <= apart], j[total <= apart]
        link(i, j)

    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1]), True][: n + 1]) if n else np.zeros(1, int)
    lo, hi = cut[:-1], cut[1:]
    own = side[lo] == 0
    two = np.flatnonzero((side[lo][:-1] == 1) & (side[lo][1:] == 2) & (group[lo][:-1] == group[lo][1:])) if len(lo) > 1 else np.zeros(0, int)
    todo = [(0, np.r_[lo[own], lo[two]], np.r_[hi[own], hi[two]], np.r_[lo[own], lo[two + 1]], np.r_[hi[own], hi[two + 1]], np.zeros(own.sum() + len(two), int))]
    while todo:
        d, l1, h1, l2, h2, err = todo.pop()
        if len(l1) > FRONTIER:
            half = len(l1) // 2
            todo += [(d, *(x[:half] for x in (l1, h1, l2, h2, err))), (d, *(x[half:] for x in (l1, h1, l2, h2, err)))]
            continue
        small = ((h1 - l1) * (h2 - l2) <= LEAVES) | (d == 64)
        if small.any():
            compare(l1[small], h1[small], l2[small], h2[small])
            l1, h1, l2, h2, err = (x[~small] for x in (l1, h1, l2, h2, err))
        if not len(l1):
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((vals >> np.uint64(63 - d)) & np.uint64(1), dtype=np.uint32)]
        c = ones[d]
        m1, m2 = h1 - (c[h1] - c[l1]).astype(np.int64), h2 - (c[h2] - c[l2]).astype(np.int64)
        same = l1 == l2
        parts = [(l1, m1, l2, m2, err), (m1, h1, m2, h2, err), (l1, m1, m2, h2, err + 1), (m1[~same], h1[~same], l2[~same], m2[~same], err[~same] + 1)]
        l1, h1, l2, h2, err = (np.concatenate(x) for x in zip(*parts))
        alive = (l1 < h1) & (l2 < h2) & (err <= bits)
        todo.append((d + 1, *(x[alive] for x in (l1, h1, l2, h2, err))))
    return root(np.arange(n))


def trie_links(prints: DataFrame, bits: int = BITS, others: Sequence[str] = (), apart: int = 0) -> DataFrame:
    """Edges ``a, b`` that connect what is within ``bits`` differing bits; ``prints``: distinct ``value`` (long) with a ``node`` (long).

    ``others`` names columns with further fingerprints (long).  A pair then links only if all its fingerprints together differ in at most
    ``apart`` bits, which keeps unrelated texts apart however many there are.

    Two values within the budget agree on one of ``bits + 1`` stretches of the 64.  So the trie is built once for every rotation that
    brings a stretch to the front, and a walk starts at pairs of equal top nodes; Spark deals the tries out by top node.  Within a task,
    node pairs are walked together, differing bits add up, and a pair over the budget is dropped.  A top node with more than
    ``NODE_LIMIT`` values is dealt out again as pairs of its subtrees eight bits further down, as far as these are within the budget.
    A task gives a tree of edges for what it found connected, so a dense family of n values gives less than n edges.
    """
    spark = prints.sparkSession
    blocks = bits + 1
    size = 64 // blocks
    rotated = [F.struct(F.lit(k).alias("block"), F.expr(f"shiftleft(value, {k * size}) | shiftrightunsigned(value, {64 - k * size})" if k else "value").alias("turned")) for k in range(blocks)]
    d = prints.select("node", *others, F.explode(F.array(*rotated)).alias("r")).select("node", *others, "r.*").withColumn("top", F.shiftrightunsigned("turned", 64 - size))
    crowded = d.groupBy("block", "top").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NODE_LIMIT)
    crowded = cut_lineage(crowded)  # at most rows / NODE_LIMIT
    usual = d.join(crowded, ["block", "top"], "left_anti").withColumns({"qa": F.lit(-1), "qb": F.lit(-1), "side": F.lit(0)})
    sub = F.shiftrightunsigned("turned", 64 - size - 8).bitwiseAND(255).cast("int")
    masks = F.array(*[F.lit(m) for m in range(256) if bin(m).count("1") <= bits])
    dense = d.join(crowded.drop("n"), ["block", "top"]).withColumn("q", sub).withColumn("other", F.explode(F.transform(masks, lambda m: F.col("q").bitwiseXOR(m))))
    dense = dense.withColumns({"qa": F.least("q", "other"), "qb": F.greatest("q", "other"), "side": F.when(F.col("q") == F.col("other"), 0).when(F.col("q") < F.col("other"), 1).otherwise(2)})
    cols = ["node", *others, "block", "turned", "top", "qa", "qb", "side"]
    dealt = usual.select(cols).unionByName(dense.select(cols)).repartition(width(spark), "block", "top", "qa", "qb")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        p = pd.concat(held, ignore_index=True)
        vals = p.turned.to_numpy(np.int64).view(np.uint64)
        keys = [p[c].to_numpy(np.int64) for c in ("block", "top", "qa", "qb")]
        order = np.lexsort([vals, p.side.to_numpy(), *reversed(keys)])
        vals, side, node = vals[order], p.side.to_numpy(np.int64)[order], p.node.to_numpy(np.int64)[order]
        keys = [k[order] for k in keys]
        group = np.cumsum(np.r_[False, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        first = _links(vals, group, side, bits, [p[c].to_numpy(np.int64)[order].view(np.uint64) for c in others], apart)
        tied = first != np.arange(len(vals))
        yield pd.DataFrame({"a": node[tied], "b": node[first[tied]]})

    return dealt.mapInPandas(walk, "a long, b long")


def near_duplicate_notes(
    experiments: DataFrame,
    experiment_id: str = "experiment_id",
    description: str = "description",
    words: int = SHINGLE_WORDS,
    bits: int = BITS,
    tables: int = 1,
    checks: int = 0,
    apart: int = 0,
) -> DataFrame:
    """``experiment_id, fingerprint, component_id`` for every row of ``experiments(experiment_id long, description string)``.

    ``fingerprint`` is the SimHash as a long; ``component_id`` the smallest id that links of at most ``bits`` differing bits reach.
    Missing, empty and blank descriptions have fingerprint zero and link like any other.  Repeated rows keep a row each; copies share a
    fingerprint, which is joined once.  A row without an id keeps its fingerprint, links nothing and has no component.  Other columns,
    whatever their names, are ignored; an empty table gives no rows.

    With more ``tables``, descriptions have so many independent fingerprints and link if any of them is within the budget: what one
    fingerprint misses by chance another finds.  ``fingerprint`` is the first.  With ``checks`` (fewer than ``tables``), such a pair also
    has at most ``apart`` differing bits in that fingerprint and the next ``checks`` ones together: among n descriptions a single budget
    meets about n * n unrelated pairs with a fixed small chance, and the check makes that chance negligible.
    """
    ship_package(experiments.sparkSession)
    if checks >= tables:
        checks = tables - 1
    d = experiments.select(F.col(experiment_id).cast("long").alias("experiment_id"), fingerprints(F.col(description), words, tables).alias("all"))
    d = cut_lineage(d)
    prints = cut_lineage(d.filter("experiment_id is not null").groupBy("all").agg(F.min("experiment_id").alias("node")))
    others = [f"other{i}" for i in range(checks)]
    edges = None
    for k in range(tables):
        own = prints.select(F.col("all")[k].alias("value"), "node", *[F.col("all")[(k + 1 + i) % tables].alias(c) for i, c in enumerate(others)])
        if tables > 1:  # what agrees in this table: all that is near to the first is joined to it at once and walks no trie
            first = own.groupBy("value").agg(F.min(F.struct("node", *others)).alias("first"))
            away = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"first.{c}"))) for c in others), F.lit(0))
            own = own.join(first, "value").withColumns({"leads": F.col("node") == F.col("first.node"), "near": away <= apart if others else F.lit(True)})
            own = cut_lineage(own.select("value", "node", *others, F.col("first.node").alias("to"), (F.col("leads") | ~F.col("near")).alias("walks")))
            same = own.filter(~F.col("walks")).select(F.col("node").alias("a"), F.col("to").alias("b"))
            own = own.filter("walks").select("value", "node", *others)
            edges = same if edges is None else edges.unionByName(same)
        found = trie_links(own, bits, others, apart)
        edges = found if edges is None else edges.unionByName(found)
    of = prints.join(components(edges), "node", "left").select("all", F.coalesce("component", "node").alias("component_id"))
    of = cut_lineage(of)
    out = d.join(of, "all", "left")
    return out.select("experiment_id", F.col("all")[0].alias("fingerprint"), F.when(F.col("experiment_id").isNotNull(), F.col("component_id")).alias("component_id"))
