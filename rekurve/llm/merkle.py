"""A Merkle manifest of recording files: trees by experiment below one root, stored as aligned blocks in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rekurve.llm.common import cut_lineage, ranks, ship_package

#: Levels of a block: it holds up to 2 ** LEVELS nodes of the level it begins with, and their subtree up to one block root.
LEVELS = 10
FIELDS = ("file_id", "filename", "experiment_id", "raw_data_json")
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """The SHA-256 of a record's fields in order, each as its UTF-8 length, a colon and its value as text, a missing one as ``-``."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    nothing = F.lit("")
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(F.coalesce(s["left"], nothing), node, F.coalesce(s["right"], nothing)).cast("binary"), 256))


def siblings_text(proof: Column) -> Column:
    """All siblings of a proof in their order, left before right, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: F.array(s["left"], s["right"]))), "")


def address(rows: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (the root has 0) lie in a complete binary tree of ``rows`` levels of nodes.

    The tree is cut at half of its height: first the top part, then the bottom parts from left to right, each laid out in the same way.
    A way from a leaf to the root so meets few stretches of memory, whatever the size of a cache line or page.
    """
    if rows == 1:
        return np.zeros_like(index)
    top = rows // 2
    if depth < top:
        return address(top, depth, index)
    bottom, below = rows - top, depth - top
    return (1 << top) - 1 + (index >> below) * ((1 << bottom) - 1) + address(bottom, below, index & ((1 << below) - 1))


@lru_cache(maxsize=64)
def addresses(levels: int) -> list[np.ndarray]:
    """By depth, the address of every node of a block."""
    return [address(levels + 1, depth, np.arange(1 << depth)) for depth in range(levels + 1)]


def height(block: int, count: int, levels: int) -> int:
    """Levels of a block: all of them, but as few as its nodes need where it is the only one of its tree."""
    return levels if block else (count - 1).bit_length()


def grow(leaves: list[str], levels: int) -> tuple[bytes, str]:
    """The subtree over ``leaves`` in van Emde Boas order, 32 bytes a node (a place without a node stays zero), and its root."""
    at, row = addresses(levels), leaves
    store = np.zeros(((2 << levels) - 1, 32), np.uint8)
    for depth in range(levels, -1, -1):
        store[at[depth][: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        if depth:
            row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)]
    return store.tobytes(), row[0]


def siblings(store: bytes, levels: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaves of a block, and by leaf and level upwards the sibling on the left and on the right; None where there is none."""
    at, text = addresses(levels), store.hex()
    nodes = np.array([text[i : i + 64] for i in range(0, len(text), 64)], object)
    left, right = np.full((count, levels), None, object), np.full((count, levels), None, object)
    for up in range(levels):
        index = np.arange(count) >> up
        other, width = index ^ 1, ((count - 1) >> up) + 1
        found = other < width
        for side, here in ((left, found & (other < index)), (right, found & (other > index))):
            side[here, up] = nodes[at[levels - up][other[here]]]
    return nodes[at[levels][:count]], left, right


def _grown(group: str, carry: Sequence[str], most: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot").combine_chunks()
        levels = height(t["block"][0].as_py(), t.num_rows, most)
        store, root = grow([d.hex() for d in t["digest"].to_pylist()], levels)
        one = {group: t[group][:1], "block": t["block"][:1], "count": pa.array([t.num_rows], pa.int32()), "store": pa.array([store], pa.binary()), "root": pa.array([bytes.fromhex(root)], pa.binary())}
        return pa.table(one | {c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].chunk(0)) for c in carry})

    return run


def blocks(nodes: DataFrame, group: str, carry: Sequence[str], levels: int) -> list[DataFrame]:
    """The trees over ``nodes(group, rank, digest, *carry)``, one for each value of ``group``, as written tables of blocks, lowest first.

    A level's nodes are cut into aligned blocks; block roots are the nodes of the next table, until every tree has one block.
    """
    tables, held = [], list(carry)
    while True:
        kinds = {f.name: f.dataType for f in nodes.schema.fields}
        schema = T.StructType([T.StructField(group, kinds[group]), T.StructField("block", T.LongType()), T.StructField("count", T.IntegerType()), T.StructField("store", T.BinaryType()), T.StructField("root", T.BinaryType()), *[T.StructField(c, T.ArrayType(kinds[c])) for c in held]])
        d = nodes.select(group, F.shiftright("rank", levels).alias("block"), F.col("rank").bitwiseAND((1 << levels) - 1).alias("slot"), "digest", *held)
        tables.append(cut_lineage(d.groupBy(group, "block").applyInArrow(_grown(group, held, levels), schema)))
        if tables[-1].filter("block > 0").isEmpty():
            return tables
        nodes, held = tables[-1].select(group, F.col("block").alias("rank"), F.col("root").alias("digest")), []


def _served(group: str, carry: Sequence[str], names: list[str], most: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        outs = []
        for k in range(t.num_rows):
            r = t.slice(k, 1)
            block, count, above = r["block"][0].as_py(), r["count"][0].as_py(), r["path"][0].as_py()
            levels = height(block, count, most)
            leaves, left, right = siblings(r["store"][0].as_py(), levels, count)
            width = levels + len(above)
            both = []
            for side, name in ((left, "left"), (right, "right")):
                rest = np.empty((count, len(above)), object)
                rest[:] = [s[name] for s in above]
                both.append(pa.array(np.hstack([side, rest]).ravel(), pa.string()))
            path = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * width), pa.StructArray.from_arrays(both, ["left", "right"]))
            rep = pa.array(np.zeros(count, np.int64))
            cols = {group: r[group].take(rep), "rank": pa.array((block << most) + np.arange(count)), "leaf": pa.array(leaves, pa.string()), "subroot": r["subroot"].take(rep), "root": r["whole"].take(rep), "path": path}
            cols |= {c: pa.chunked_array([x.flatten() for x in r[c].chunks]) for c in carry}
            outs.append(pa.table({c: cols[c] for c in names}))
        return pa.concat_tables(outs)

    return run


def paths(tables: list[DataFrame], group: str, carry: Sequence[str], above: DataFrame, levels: int) -> DataFrame:
    """For all nodes that the trees in ``tables`` stand on: ``group, rank, leaf, subroot, root, path`` and what they carry.

    ``above(group, subroot, whole, path)`` has the subroot of each tree, the root over all and the siblings on the way there.  The
    siblings of block roots are read first and handed down to their blocks, each of which then serves its own nodes.
    """
    kind, above = tables[0].schema[group].dataType, above.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(range(len(tables))):
        held = list(carry) if level == 0 else []
        a = above.withColumnsRenamed({group: "_group", "block": "_block"})
        d = tables[level].join(a, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))).drop("_group", "_block", "root")
        fields = [T.StructField(group, kind), T.StructField("rank", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root")], T.StructField("path", PATH)]
        fields += [T.StructField(c, tables[0].schema[c].dataType.elementType) for c in held]
        above = d.groupBy(group, "block").applyInArrow(_served(group, held, [f.name for f in fields], levels), T.StructType(fields))
        if level:
            above = cut_lineage(above.select(group, F.col("rank").alias("block"), "subroot", F.col("root").alias("whole"), "path"))
    return above


def file_manifest(raw_files: DataFrame, fields: Sequence[str] = FIELDS, file_id: str = "file_id", experiment_id: str = "experiment_id", claim: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``file_id, leaf, claim, subroot, root, proof`` for every row of ``raw_files(file_id, filename, experiment_id, raw_data_json)``.

    A file's leaf is ``leaf_digest`` of its ``fields``.  The leaves of an experiment, by ascending ``file_id``, are the bottom of a tree in
    which every two neighbours (at the end maybe one) become the SHA-256 of their hexadecimal digests, until one is left: ``subroot``.
    The subroots, by ``experiment_id`` (text by its UTF-8 bytes), become ``root`` in the same way.  ``proof`` is the siblings on the way
    from leaf to root, an entry for each level with ``left``, ``right`` or neither.  ``folded(leaf, proof)`` is the root again; for
    ``claim``, a digest in hexadecimal that somebody presents for the file (default: the leaf), ``folded(claim, proof)`` is it only if the
    claim is right.

    A missing ``experiment_id`` is an experiment of its own, before all others; a missing ``file_id`` comes before all others of its
    experiment, and files that agree on it are in the order of their leaves.  Repeated rows are leaves each.  Missing fields and empty ones
    differ.  Other columns, whatever their names, are ignored; an empty table gives no rows.

    Texts are read once, for their digest.  Leaves are ranked by ranges, so an experiment of any size is spread over tasks; blocks of 2 ** ``levels``
    leaves are built and stored one by one, and then blocks of block roots, as often as a tree needs it (four times for 10 ** 12 files).
    """
    ship_package(raw_files.sparkSession)
    leaf = leaf_digest(*[F.col(f) for f in fields])
    d = raw_files.select(F.col(experiment_id).alias("experiment_id"), F.col(file_id).alias("file_id"), F.unhex(leaf).alias("digest"), F.unhex(leaf if claim is None else claim).alias("claim"))
    d = cut_lineage(d.withColumn("row", F.monotonically_increasing_id()))
    trees = blocks(ranks(d, ["experiment_id"], ["file_id", "digest", "row"]), "experiment_id", ["file_id", "claim"], levels)
    subroots = trees[-1].select(F.lit(0).alias("all"), "experiment_id", F.col("root").alias("digest"))
    crown = blocks(ranks(subroots, ["all"], ["experiment_id"]), "all", ["experiment_id"], levels)
    top = crown[-1].select("all", F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("root")).alias("whole"), F.array().cast(PATH).alias("path"))
    above = cut_lineage(paths(crown, "all", ["experiment_id"], top, levels).select("experiment_id", F.col("leaf").alias("subroot"), F.col("root").alias("whole"), "path"))
    out = paths(trees, "experiment_id", ["file_id", "claim"], above, levels)
    return out.select("file_id", "leaf", F.lower(F.hex("claim")).alias("claim"), "subroot", "root", F.col("path").alias("proof"))
