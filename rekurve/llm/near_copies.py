"""Near copies by the true similarity of their word shingles: fingerprint tries and minimum hashes bring pairs together, the shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rekurve.llm.common import components, cut_lineage, fresh_worker, likely, marked, ship_package, temporary, width
from rekurve.llm.simhash import BITS, fingerprint_of_hashes, shingles_of, trie_links

#: A pair that shares 0.8 of its shingles agrees on a minimum hash with chance 0.8, on all of a band with 0.33, and on one band or more with 0.99995.
BANDS, BAND_ROWS = 25, 5
FACTORS = np.random.default_rng(7).integers(0, 1 << 31, BANDS * BAND_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
#: Turns in which a text is held against one text that shares a band with it; then all that is still unconnected.
TURNS = 3
#: Shingles of the texts whose sets one task holds for each of two sides.
PART_SHINGLES = 200_000


def sketch_of(text: str | None, words: int) -> tuple[bytes, int, int, list[int]]:
    """A digest of the set of shingles, its size, the SimHash, and a key for each band of minimum hashes; a text without words has no band."""
    all_of_them = shingles_of(text, words)
    h = np.unique(all_of_them)
    digest = xxhash.xxh3_128_digest(h.tobytes())
    if not len(h):
        return digest, 0, 0, []
    x, least = (h >> np.uint64(32)).astype(np.uint32), np.full(len(FACTORS), (1 << 32) - 1, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * FACTORS).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.astype(np.uint64).reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return digest, len(h), int(np.uint64(fingerprint_of_hashes(all_of_them)).view(np.int64)), key.view(np.int64).tolist()


def sketches(text: Column, words: int) -> Column:
    @F.pandas_udf("digest binary, size int, print long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        for s in batches:
            yield pd.DataFrame([sketch_of(t, words) for t in s], columns=["digest", "size", "print", "bands"])

    return run.asNondeterministic()(text)


def shingle_sets(text: Column, words: int) -> Column:
    """The sorted distinct shingle hashes, eight bytes each."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh_worker()
        for s in batches:
            yield pd.Series([np.unique(shingles_of(t, words)).tobytes() for t in s])

    return run.asNondeterministic()(text)


class Tree:
    """Groups of nodes by their edges; an edge inside a group is left out."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[i] = j
        return i != j


class Sets:
    """Sets of shingle hashes side by side: how much each of some shares with one more set."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.cumsum(self.size) - self.size
        self.values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids, self.flag = ids.astype(np.int32), np.zeros(len(self.values), bool)

    def alike(self, hashes: np.ndarray, which: np.ndarray, least: float) -> np.ndarray:
        """Those of ``which`` that share ``least`` of what they and ``hashes`` have together; none of the sets is empty."""
        at = np.searchsorted(self.values, hashes)
        at = at[at < len(self.values)]
        mine = at[self.values[at] == hashes[: len(at)]]  # hashes are sorted, so only the last ones are beyond all values
        self.flag[mine] = True
        out = []
        for k in range(0, len(which), 256):
            w = which[k : k + 256]
            n = self.size[w]
            first = np.cumsum(n) - n
            common = np.add.reduceat(self.flag[self.ids[np.repeat(self.start[w] - first, n) + np.arange(int(n.sum()))]].astype(np.int64), first)
            out.append(w[common >= least * (n + len(hashes) - common) - 1e-9])
        self.flag[mine] = False
        return np.concatenate(out) if out else which[:0]


def linked(sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of the pairs ``a, b``, a tree of edges over those whose sets share ``least`` of what they have together."""
    nodes = list(sets)
    place, held, tree, out = {n: i for i, n in enumerate(nodes)}, Sets(list(sets.values())), Tree(len(nodes)), []
    x, y = (np.fromiter((place[n] for n in side.tolist()), np.int64, len(side)) for side in (a, b))
    often = np.bincount(np.r_[x, y], minlength=len(nodes))
    x, y = np.where(often[x] >= often[y], x, y), np.where(often[x] >= often[y], y, x)  # x has the hubs
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    for own in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
        hub = int(x[own[0]])
        out += [(nodes[i], nodes[hub]) for i in held.alike(sets[nodes[hub]], y[own], least).tolist() if tree.join(i, hub)]
    return out


def with_sets(texts: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """``asked``, a written table with a row for each of its nodes, with their sets of shingles; of ``texts`` hardly more than theirs is shuffled."""
    return likely(texts, "node", marked(asked, "node")).join(asked, "node").select(*asked.columns, shingle_sets(F.col("text"), words).alias("hashes"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Edges ``a, b`` that connect what the pairs ``a, b`` whose texts share ``least`` of their shingles connect.

    Sets whose sizes differ too much for that are not made.  The other nodes of the pairs are dealt into parts of about ``PART_SHINGLES``
    shingles; a pair belongs to its two parts, and a text's set goes once to every pair of parts where it is asked for.  A task decides
    all pairs of two parts and gives a tree of edges.
    """
    size = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"))
    p = pairs.select("a", "b").join(size("a"), "a").join(size("b"), "b")
    p = cut_lineage(p.filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9))
    ends = p.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.col(f"size_{c}").alias("size")) for c in "ab"]))).distinct()
    parts = max(1, -(-(ends.agg(F.sum("size")).first()[0] or 0) // PART_SHINGLES))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("long")
    dealt = p.select("a", "b", F.least(part("a"), part("b")).alias("low"), F.greatest(part("a"), part("b")).alias("high"))
    needs = dealt.select(F.explode(F.array("a", "b")).alias("node"), F.struct(F.col("low").alias("part_low"), F.col("high").alias("part_high")).alias("at"))
    needs = cut_lineage(needs.groupBy("node").agg(F.collect_set("at").alias("at")))  # at most a place for each part
    needs = with_sets(texts, needs, words).select("node", "hashes", F.inline("at"))

    def decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = linked({n: np.frombuffer(h, np.uint64) for n, h in zip(right["node"], right["hashes"])}, left["a"].to_numpy(), left["b"].to_numpy(), least) if len(left) else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("low", "high").cogroup(needs.groupBy("part_low", "part_high")).applyInPandas(decide, "a long, b long")


def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, node, component``, those of a key together: the nodes whose component is not that of the first node of their key, with that node."""
    held = None
    for p in batches:
        if not p.num_rows:
            continue
        key, node, comp = (p.column(c).to_numpy() for c in ("key", "node", "component"))
        if held is not None:
            key, node, comp = np.r_[held[0], key], np.r_[held[1], node], np.r_[held[2], comp]
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
        held = key[-1], node[first[-1]], comp[first[-1]]
        apart = comp != comp[first]
        yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(node[first][apart])], ["node", "to"])


def unconnected(members: DataFrame, nodes: DataFrame, of: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Edges ``a, b`` for all that is near and not connected within a key of ``members(key, node, component)``; keys have several components.

    A member outside of its key's largest component is held against that whole component, and members outside against each other.  The
    sets of one side are cut into parts and those of the other into chunks of about ``PART_SHINGLES``; every part meets every chunk in a
    task, which gives a tree of edges and no pairs.  So a component goes to as many tasks as it has parts, times the chunks of those
    outside; only texts that are all unconnected, although they share a band, are compared each with each.  Sets that share ``least``
    differ in size by that factor at most, so they are dealt by classes of size, of which only neighbours meet.
    """
    count = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = count.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    outside = cut_lineage(members.join(cut_lineage(main), "key").filter("component <> main"))
    asking = outside.select(F.lit(False).alias("own"), F.col("main").alias("target"), "node", "component").distinct()
    whole = nodes.select("node").join(of, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    whole = whole.join(asking.select(F.col("target").alias("component")).distinct(), "component", "left_semi")
    asked = whole.select(F.lit(False).alias("own"), F.col("component").alias("target"), "node", "component")
    several = outside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    others = outside.join(several, "key", "left_semi").select(F.lit(True).alias("own"), F.col("key").alias("target"), "node", "component")
    of_both = asking.withColumn("asks", F.lit(True)).unionByName(asked.withColumn("asks", F.lit(False)))
    of_both = of_both.unionByName(others.withColumn("asks", F.explode(F.array(F.lit(True), F.lit(False)))))
    step = max(-math.log(least), 1e-3) * (1 + 1e-6)  # a little more than the factor, so that rounding parts no two that may be near
    d = of_both.join(nodes.select("node", "size"), "node").withColumn("class", F.floor(F.ln("size") / step).cast("int"))
    d = cut_lineage(d.withColumn("class", F.explode(F.when(F.col("asks"), F.array(*[F.col("class") + k for k in (-1, 0, 1)])).otherwise(F.array("class")))))
    shingles = lambda asks: F.ceil(F.sum(F.when(F.col("asks") == asks, F.col("size")).otherwise(0)) / PART_SHINGLES).cast("int")
    cuts = d.groupBy("own", "target", "class").agg(shingles(False).alias("parts"), shingles(True).alias("chunks")).filter("parts > 0 and chunks > 0")
    d = d.join(cut_lineage(cuts), ["own", "target", "class"])
    spot = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    d = d.withColumn("part", F.explode(F.when(F.col("asks"), every("parts")).otherwise(F.array(spot("parts", 0)))))
    d = d.withColumn("chunk", F.explode(F.when(F.col("asks"), F.array(spot("chunks", 1))).otherwise(every("chunks"))))
    d = cut_lineage(d.groupBy("node").agg(F.collect_list(F.struct("own", "target", "class", "part", "chunk", "asks", "component")).alias("at")))
    d = with_sets(texts, d, words).select("node", "hashes", F.inline("at"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        asks = g["asks"].to_numpy(bool)
        x, y = g[asks], g[~asks]
        out = []
        if len(x) and len(y):
            held = Sets([np.frombuffer(h, np.uint64) for h in y["hashes"]])
            node, comp = y["node"].to_numpy(np.int64), y["component"].to_numpy(np.int64)
            codes, tree = pd.factorize(np.r_[comp, x["component"].to_numpy(np.int64)])[0], Tree(len(g))
            for i, (n, c, h) in enumerate(zip(x["node"], x["component"], x["hashes"])):
                own = np.frombuffer(h, np.uint64)
                alike = np.minimum(held.size, len(own)) >= least * np.maximum(held.size, len(own)) - 1e-9
                near = held.alike(own, np.flatnonzero((comp != c) & alike), least)
                out += [(n, int(node[j])) for j in near.tolist() if tree.join(int(codes[j]), int(codes[len(y) + i]))]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return d.groupBy("own", "target", "class", "part", "chunk").applyInPandas(compare, "a long, b long")


def near_copies(docs: DataFrame, row: str, text: str, words: int, least: float) -> DataFrame:
    """``row, component_id`` for every row of ``docs``: the smallest row that links reach; ``row`` is a long that repeats in no other row.

    Two texts link if their sets of shingles of ``words`` words (lower case; a shorter text is one shingle) have a Jaccard similarity of
    ``least`` or more; missing texts and those without words link with each other.  No link is below the bound.  Repeated rows and equal
    sets are one node, other columns are ignored, whatever their names, and an empty table gives no rows.

    Candidates come first from the binary tries over SimHash fingerprints, which connect what differs little.  Nodes that agree in a band of
    minimum hashes are candidates too: in each turn a node gets one of the nodes that lead its bands, which connects a large group of
    copies by as many comparisons as it has texts, and at last all that shares a band and is not connected is met.  ``docs`` is read more
    than once, so it has to be a written table or one that repeats its rows exactly.
    """
    ship_package(docs.sparkSession)
    d = cut_lineage(docs.select(F.col(row).alias("node"), sketches(F.col(text), words).alias("s")).select("node", "s.*"))
    same = cut_lineage(d.groupBy("digest").agg(F.min("node").alias("node")))
    nodes = cut_lineage(d.join(same.select("node"), "node", "left_semi"))
    texts = docs.select(F.col(row).alias("node"), F.col(text).alias("text"))
    links = of = tested = None

    def connect(pairs: DataFrame | None = None, rest: DataFrame | None = None) -> None:
        """Decide the pairs ``a, b`` (a < b) that were not met before, or all that is unconnected in ``rest``, and what is connected then."""
        nonlocal links, of, tested
        with temporary(docs.sparkSession) as keep:
            if rest is not None:
                good = keep(cut_lineage(unconnected(rest, nodes, of, texts, words, least)))
            else:
                if tested is not None:
                    pairs = pairs.join(tested, ["a", "b"], "left_anti")
                pairs = keep(cut_lineage(pairs))
                good = keep(cut_lineage(verified(pairs, nodes, texts, words, least)))
                tested = pairs if tested is None else tested.unionByName(pairs)
            links = good if links is None else links.unionByName(good)
            of = keep(cut_lineage(components(links)))

    prints = nodes.filter("size > 0").select("node", F.col("print").alias("value"))
    lone = cut_lineage(prints.groupBy("value").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    alike = prints.join(lone.filter("n > 1"), "value").filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = trie_links(lone.select("value", F.col("first").alias("node")), BITS)
    connect(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(alike).distinct())

    m = nodes.select("node", F.explode("bands").alias("key"))
    for turn in range(TURNS + 1):
        m = m.join(of, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        m = cut_lineage(m)
        mixed = m.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        m = cut_lineage(m.join(cut_lineage(mixed), "key", "left_semi"))
        if m.isEmpty():
            break
        if turn < TURNS:
            draw = F.xxhash64("node", F.lit(turn))
            dealt = m.withColumn("draw", draw).repartitionByRange(width(docs.sparkSession), "key", "draw", "node").sortWithinPartitions("key", "draw", "node")
            pairs = dealt.select("key", "node", "component").mapInArrow(lead, "node long, to long")
            pairs = pairs.groupBy("node").agg(F.min_by("to", F.xxhash64("to", "node", F.lit(turn))).alias("to"))
            connect(pairs.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct())
        else:
            connect(rest=m)
        m = m.select("key", "node")
    found = same.join(of, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return d.select(F.col("node").alias(row), "digest").join(cut_lineage(found), "digest").drop("digest")
