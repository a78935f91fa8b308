"""Burst tries over the states of cells: which cells share how much of their history, without a task that holds a whole hot branch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rekurve.llm.common import cut_lineage, ranks, ship_package, width

#: States below one trie head that a container may hold; a larger one is burst.
LIMIT = 2048
#: States in a row of a stored sequence.
CHUNK = 64
#: Ids that are joined to one text for a digest at a time.
IDS = 512
WORD = r"[^\x20\x09-\x0D]+"
NODES = "cell_id long, depth long, parent_cell_id long, n_cells long, n_children long, n_leaves long, saved_words long, ending long"


def states(roi_traces: DataFrame, cell_id: str = "cell_id", frame: str = "frame", state: Sequence[str] = ("qc_motion", "qc_reason")) -> DataFrame:
    """``cell_id, depth, state, words``: the states of each cell in order, from depth 1; see ``state_tree``."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in state]
    name = F.md5(F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]).cast("binary"))
    d = roi_traces.select(F.col(cell_id).cast("long").alias("cell_id"), F.col(frame).alias("frame"), name.alias("name"), F.regexp_count(texts[-1], F.lit(WORD)).cast("long").alias("words"))
    d = cut_lineage(d.filter("cell_id is not null").withColumns({"name": F.unhex("name"), "row": F.monotonically_increasing_id()}))
    d = ranks(d, ["cell_id"], ["frame", "name", "row"])
    return d.select("cell_id", (F.col("rank") + 1).alias("depth"), F.col("name").alias("state"), "words")


def families(own: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every cell rebuilt from its family's first cell: ``cell_id, depth, state, words`` and all ``cell_id``; ``own`` is as ``states`` gives it.

    The project keeps no families of cells, so this step is general.  A cell's family begins with the cell ``cell_id - cell_id % family`` (the
    remainder has the sign of ``cell_id``, as in SQL).  With h, the CRC-32 of the digits of ``cell_id`` modulo ``heads``,
    the first h states are those of that cell (fewer if it has fewer), then come the cell's own states after its first h.
    """
    own = cut_lineage(own)
    cells = own.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.when(F.col("depth") < heads, F.struct("depth", "state", "words")))).alias("first"))  # fewer than ``heads`` of a cell
    cells = cells.withColumns({"base": F.col("cell_id") - F.col("cell_id") % family, "h": (F.crc32(F.col("cell_id").cast("string").cast("binary")) % heads).cast("int")})
    base = cells.filter("cell_id = base").select("base", "first")
    cells = cells.drop("first").join(base, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast(base.schema["first"].dataType)), F.lit(1), F.col("h")))
    cells = cut_lineage(cells.select("cell_id", "h", "first"))
    taken = cells.select("cell_id", F.inline("first"))
    rest = own.join(cells.select("cell_id", "h", F.size("first").alias("k")), "cell_id").filter("depth > h")
    return taken.unionByName(rest.select("cell_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "state", "words")), cells.select("cell_id")


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of containers; rows are the chunks of sequences, those of a container together, and within it those of a sequence in order.

    The sequences of a container are sorted; one after the other adds a node for each state after what it shares with the one before.
    """
    names = [c.split()[0] for c in NODES.split(", ")]

    def tree(sequences: list[tuple[bytes, list[int], int, int]], start: int, nodes: dict[str, list]) -> None:
        sequences.sort()
        before, way = b"", []
        for text, words, cell, weight in sequences:
            n, m = len(text) // 16, min(len(text), len(before))
            if text[:m] == before[:m]:
                same = m // 16
            else:
                same = int(np.argmax(np.frombuffer(text, np.uint8, m) != np.frombuffer(before, np.uint8, m))) // 16
            at = len(nodes["depth"])
            fresh = n - same
            nodes["depth"] += range(start + same, start + n)
            nodes["up"] += [way[same - 1] if same else -1, *range(at, at + fresh - 1)]
            nodes["words"] += words[same:]
            nodes["n_cells"] += [0] * (fresh - 1) + [weight]
            nodes["cell_id"] += [cell] * fresh
            nodes["ending"] += [None] * (fresh - 1) + [cell]
            way[same:] = range(at, at + fresh)
            before = text

    def given(nodes: dict[str, list], tops: dict[int, tuple[int, bytes]]) -> pd.DataFrame:
        up, depth, words = (np.array(nodes[c], np.int64) for c in ("up", "depth", "words"))
        cell, n_cells = np.array(nodes["cell_id"], np.int64), np.array(nodes["n_cells"], np.int64)
        saved, leaves, children = np.zeros(len(up), np.int64), np.zeros(len(up), np.int64), np.zeros(len(up), np.int64)
        order = np.argsort(-depth, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):  # a depth at a time, from below
            leaves[at] = np.maximum(leaves[at], 1)
            saved[at] += (n_cells[at] - 1) * words[at]
            own = at[up[at] >= 0]
            for total, add in ((n_cells, n_cells[own]), (leaves, leaves[own]), (saved, saved[own]), (children, 1)):
                np.add.at(total, up[own], add)
            np.minimum.at(cell, up[own], cell[own])
        top = np.array(list(tops), np.int64)
        parent = cell[up]
        parent[top] = [p for p, _ in tops.values()]
        heads = np.full(len(up), None, object)
        heads[top] = [h for _, h in tops.values()]
        ending = pd.array(nodes["ending"], dtype="Int64")
        return pd.DataFrame(dict(zip(names, (cell, depth, parent, n_cells, children, leaves, saved, ending)))).assign(head=heads)

    fields = ("depth", "up", "words", "n_cells", "cell_id", "ending")
    nodes, tops, now, held, info = {f: [] for f in fields}, {}, None, {}, None

    def close():
        tops[len(nodes["depth"])] = info[1:]
        tree([(b"".join(t), w, cell, weight) for cell, (t, w, weight) in held.items()], info[0], nodes)

    for p in batches:
        for container, start, parent, head, cell, weight, chunk, items in p[["container", "start", "parent", "head", "cell_id", "weight", "chunk", "items"]].itertuples(index=False):
            if container != now:
                if now is not None:
                    close()
                if len(nodes["depth"]) > 50_000:
                    yield given(nodes, tops)
                    nodes, tops = {f: [] for f in fields}, {}
                now, held, info = container, {}, (start, parent, head)
            text, words, _ = held.setdefault(cell, ([], [], weight))
            for x in items[max(0, start - 1 - chunk * CHUNK) :]:
                text.append(x["state"])
                words.append(x["words"])
    if now is not None:
        close()
        yield given(nodes, tops)


def burst(active: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Oversized containers, and what is in the containers that they burst into.

    A container is first followed as far as all its sequences agree, whole chunks at a time and then within a chunk, however far that is;
    there, at depth ``last``, its sequences part by their next state.  A sequence alone is followed to its end.
    """
    whole = active.join(held.select("cell_id", "chunk", "hash"), "cell_id").filter("chunk >= (start - 1) div %d" % CHUNK)
    sizes = active.groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("n_cells"), F.min("cell_id").alias("first"), F.max("length").alias("longest"))
    sizes = cut_lineage(sizes)
    agreed = whole.groupBy("container", "chunk").agg(F.count(F.lit(1)).alias("c"), F.min("hash").alias("a"), F.max("hash").alias("b"))
    parting = agreed.join(sizes.select("container", "n"), "container").filter("c < n or a <> b").groupBy("container").agg(F.min("chunk").alias("chunk"))
    at = active.join(cut_lineage(parting), "container").join(held.select("cell_id", "chunk", "items"), ["cell_id", "chunk"], "left")
    at = cut_lineage(at.withColumn("seen", F.coalesce(F.transform("items", lambda x: x["state"]), F.array().cast("array<binary>"))).drop("items"))
    ends = at.groupBy("container", "chunk").agg(F.min("seen").alias("a"), F.max("seen").alias("b"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i)))
    ends = ends.withColumn("same", F.when((F.size("a") == 0) | (F.size("b") == 0), 0).otherwise(same)).select("container", (F.col("chunk") * CHUNK + F.col("same")).alias("last"))
    heads = active.groupBy("container").agg(F.first("start").alias("start"), F.first("parent").alias("parent"), F.first("head").alias("head"))
    heads = heads.join(sizes, "container").join(ends, "container", "left").withColumn("last", F.coalesce("last", "longest")).drop("longest", "n")
    ended = active.join(heads.select("container", "last"), "container").filter("length = last").select("container", F.col("cell_id").alias("ending"))  # one at most
    heads = cut_lineage(heads.join(ended, "container", "left"))
    below = at.join(heads.select("container", "last", "first"), "container").filter("length > last")
    follows = F.get("seen", (F.col("last") - F.col("chunk") * CHUNK).cast("int"))
    below = below.select("cell_id", "weight", "length", F.unhex(F.md5(F.concat("container", follows))).alias("container"), (F.col("last") + 1).alias("start"), F.col("first").alias("parent"), F.col("container").alias("head"))
    return heads, cut_lineage(below)


def state_tree(rebuilt: DataFrame, cells: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The prefix tree of the cells' sequences of states: its nodes, and where each cell ends.

    ``rebuilt(cell_id long, depth long, state binary, words long)`` has the states of the cells from depth 1 without a gap, as ``states``
    (of ``roi_traces(cell_id, frame, qc_motion, qc_reason)``) and ``families`` give them; ``cells(cell_id)`` has all cells once, those
    without a state too.  A node is a distinct sequence of first states; a cell that begins with it is a member; the root is the empty one.

    Nodes: ``cell_id`` (its smallest member) and ``depth`` name a node; ``parent_cell_id`` (null for the root), ``n_cells`` (members),
    ``n_children``, ``n_leaves`` (nodes without children in its subtree, itself included), ``saved_words`` (over its subtree, members
    beyond the first times the words of the last state) and ``ending`` (the smallest cell whose states end here, else null).  Second
    result: ``cell_id, ending`` for every cell, so that members of a node that end there can be joined.  No cells give no nodes.

    Equal sequences are one with a weight.  The others lie in containers below trie heads, at first by their first state.  A container
    with more than ``limit`` states is burst: it becomes a head, and what follows goes into a container for each next state.  Containers
    that are small enough are sorted and swept into nodes, many by one task.  Heads add up what stands below them, last ones first.
    Sequences are kept in rows of ``CHUNK`` states, so one very long history is dealt out like any other rows.
    """
    spark = rebuilt.sparkSession
    ship_package(spark)
    cells = cut_lineage(cells)
    place = ((F.col("depth") - 1) / CHUNK).cast("long")
    d = rebuilt.groupBy("cell_id", place.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("depth", "state", "words"))).alias("items"))
    d = d.select("cell_id", "chunk", F.transform("items", lambda x: F.struct(x["state"].alias("state"), x["words"].alias("words"))).alias("items"))
    d = cut_lineage(d.withColumn("hash", F.aggregate("items", F.lit(b""), lambda h, x: F.unhex(F.md5(F.concat(h, x["state"]))))))
    of = [F.bit_xor(F.xxhash64(F.lit(k), "chunk", "hash")).alias(f"x{k}") for k in (1, 2)]
    whole = d.groupBy("cell_id").agg(F.sum(F.size("items")).alias("length"), *of)
    whole = cut_lineage(cells.join(whole, "cell_id", "left").select("cell_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("length", "x1", "x2")]))
    kinds = cut_lineage(whole.groupBy("length", "x1", "x2").agg(F.min("cell_id").alias("ending"), F.count(F.lit(1)).alias("weight")))
    members = whole.join(kinds.drop("weight"), ["length", "x1", "x2"]).select("cell_id", "ending")
    kinds = kinds.filter("length > 0").select(F.col("ending").alias("cell_id"), "length", "weight")
    held = cut_lineage(d.join(kinds.select("cell_id"), "cell_id", "left_semi"))

    none = F.lit(b"")
    first = held.filter("chunk = 0").select("cell_id", F.col("items")[0]["state"].alias("container"))
    least = cells.agg(F.min("cell_id")).first()[0]
    d = kinds.join(first, "cell_id").select("cell_id", "weight", "length", "container", F.lit(1).cast("long").alias("start"), F.lit(least).cast("long").alias("parent"), none.alias("head"))
    d, rounds, small = cut_lineage(d), [], []
    while True:
        large = cut_lineage(d.groupBy("container").agg(F.sum(F.col("length") - F.col("start") + 1).alias("n")).filter(F.col("n") > limit).select("container"))
        if large.isEmpty():
            small.append(d)
            break
        small.append(d.join(large, "container", "left_anti"))
        heads, d = burst(cut_lineage(d.join(large, "container", "left_semi")), held)
        rounds.append(heads)
    d = small[0]
    for more in small[1:]:
        d = d.unionByName(more)
    d = d.join(held.select("cell_id", "chunk", "items"), "cell_id").filter("chunk >= (start - 1) div %d" % CHUNK)
    d = d.repartition(width(spark), "container").sortWithinPartitions("container", "cell_id", "chunk")
    nodes = cut_lineage(d.mapInPandas(sweep, NODES + ", head binary"))

    def under(tops: DataFrame) -> DataFrame:
        return tops.groupBy("head").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))

    swept = cut_lineage(under(nodes.filter("head is not null").withColumnRenamed("saved_words", "saved")))
    out, tops = [nodes.drop("head")], None

    def below(heads: DataFrame) -> DataFrame:
        found = swept
        if tops is not None:
            found = swept.unionByName(under(tops)).groupBy("head").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
        return heads.join(found.withColumnRenamed("head", "container"), "container", "left")

    for heads in reversed(rounds):
        done = below(heads).withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
        chain = done.join(held.select(F.col("cell_id").alias("first"), "chunk", "items"), "first").filter("chunk >= (start - 1) div %d and chunk * %d < last" % (CHUNK, CHUNK))
        chain = chain.select("container", "chunk", F.transform("items", lambda x, i: F.struct((F.col("chunk") * CHUNK + i + 1).alias("depth"), x["words"].alias("words"))).alias("items"), "start", "last")
        chain = chain.withColumn("items", F.filter("items", lambda x: (x["depth"] >= F.col("start")) & (x["depth"] <= F.col("last"))))
        chain = chain.select("container", "chunk", "items")
        sums = chain.select("container", "chunk", F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("own"))
        after = Window.partitionBy("container").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)  # two numbers for each chunk
        sums = sums.select("container", "chunk", F.coalesce(F.sum("own").over(after), F.lit(0)).alias("after"))
        within = Window.partitionBy("container", "chunk").orderBy(F.desc("depth"))
        chain = chain.join(sums, ["container", "chunk"]).select("container", "chunk", "after", F.inline("items"))
        chain = chain.select("container", "depth", (F.col("after") + F.sum("words").over(within)).alias("words"))
        chain = cut_lineage(chain.join(done, "container").withColumn("saved_words", F.col("saved") + (F.col("n_cells") - 1) * F.col("words")))
        is_last, is_top = F.col("depth") == F.col("last"), F.col("depth") == F.col("start")
        out.append(chain.select(F.col("first").alias("cell_id"), "depth", F.when(is_top, F.col("parent")).otherwise(F.col("first")).alias("parent_cell_id"), "n_cells", F.when(is_last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", "saved_words", F.when(is_last, F.col("ending")).alias("ending")))
        tops = chain.filter(is_top).select("head", "n_leaves", F.col("saved_words").alias("saved"))
    root = whole.agg(F.min("cell_id").alias("cell_id"), F.count(F.lit(1)).alias("n_cells"), F.min(F.when(F.col("length") == 0, F.col("cell_id"))).alias("ending"))
    root = below(root.filter("n_cells > 0").withColumn("container", none))
    root = root.select("cell_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_cell_id"), "n_cells", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_words"), "ending")
    found = out[0]
    for more in [*out[1:], root]:
        found = found.unionByName(more)
    return found, members


def id_digests(members: DataFrame) -> DataFrame:
    """``ending, digest``: for each value the SHA-256 of its ``cell_id``, ascending, in decimal digits with commas between.

    Up to ``IDS`` of them are sorted and joined as one array.  Of a value with more, neighbouring ids are first joined by stretches of
    ``IDS`` in parallel, and one pass over the stretches in order feeds the hash, which only can take them one after the other.
    """
    spark = members.sparkSession
    d = cut_lineage(members.select("ending", "cell_id"))
    many = cut_lineage(d.groupBy("ending").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > IDS).select("ending"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("cell_id")), lambda x: x.cast("string")), ",")
    few = d.join(many, "ending", "left_anti").groupBy("ending").agg(text.alias("t")).select("ending", F.sha2(F.col("t").cast("binary"), 256).alias("digest"))
    if many.isEmpty():
        return few
    r = ranks(d.join(many, "ending", "left_semi"), ["ending"], ["cell_id"])
    r = r.groupBy("ending", F.expr(f"rank div {IDS}").alias("at")).agg(text.alias("t")).repartition(width(spark), "ending").sortWithinPartitions("ending", "at")

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for p in batches:
            for value, t in zip(p["ending"], p["t"]):
                if value != now:
                    if now is not None:
                        yield pd.DataFrame({"ending": [now], "digest": [h.hexdigest()]})
                    now, h = value, hashlib.sha256(t.encode())
                else:
                    h.update(("," + t).encode())
        if now is not None:
            yield pd.DataFrame({"ending": [now], "digest": [h.hexdigest()]})

    return few.unionByName(r.mapInPandas(feed, "ending long, digest string"))


def with_digests(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes with ``ends_sha256``, the digest of the cells whose states end there; where there is none, that of no text."""
    nodes = cut_lineage(nodes)
    ended = nodes.filter("ending is not null").join(id_digests(members), "ending").withColumnRenamed("digest", "ends_sha256")
    rest = nodes.filter("ending is null").withColumn("ends_sha256", F.sha2(F.lit(b""), 256))
    return ended.unionByName(rest)
