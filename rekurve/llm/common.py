"""Shared steps of the corpus operators: bounded range splits, gapless positions, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rekurve.plans.session import STAGES, cut_lineage, ship_package

#: Keys looked at for each range boundary; bounds what range_splits gathers.
SAMPLE_PER_RANGE = 64
#: Cells of the map with which ``likely`` looks for keys; 64 of them are a row, which bounds what is broadcast.
CELLS = 1 << 25


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are removed at the end, but for those that went straight through the function it gives.

    What leaves the block must read nothing else.
    """
    begun, kept = len(STAGES), []

    def keep(written: DataFrame) -> DataFrame:
        kept.append(STAGES[-1])
        return written

    yield keep
    gone = [p for p in STAGES[begun:] if p not in kept]
    STAGES[begun:] = kept
    for p in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_worker() -> None:
    """Give back what earlier tasks left in a Python worker, which Spark keeps for later ones: garbage in cycles and freed memory of the C library and Arrow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def held_out(experiment_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from; a missing id counts as held out."""
    return F.coalesce(F.crc32(experiment_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def share_hash(*cols: Column, salt: int = 0) -> Column:
    """A repeatable draw in [0, 1) for a row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *cols), 11) / F.lit(float(1 << 53))


def marked(keys: DataFrame, key: str) -> DataFrame:
    """The map of ``keys`` for ``likely``: 64 cells a row, a bit for each cell that a key falls into."""
    cells = keys.select(F.pmod(F.xxhash64(key), F.lit(CELLS)).alias("cell"))
    return cut_lineage(cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits")))


def likely(rows: DataFrame, key: str, marks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``key`` may be among those of ``marked``: all that are, and a few more; with ``left_anti`` the others, which surely are not.

    It keeps wide rows out of the shuffle of a join that needs few of them.
    """
    word, bits = free_name(rows, "word"), free_name(rows, "bits")
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    hit = F.call_function("shiftright", F.col(bits), cell.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(marks.select(F.col("word").alias(word), F.col("bits").alias(bits))), (F.shiftright(cell, 6) == F.col(word)) & hit, how)


def range_splits(df: DataFrame, key: Column, n: int, rows: int | None = None) -> list:
    """At most n - 1 increasing values of ``key`` that cut the rows into about equal ranges.

    They come from about ``SAMPLE_PER_RANGE * n`` keys, however large the table is; a bad draw makes ranges uneven, never wrong.
    """
    rows = df.count() if rows is None else rows
    if n < 2 or rows < 2:
        return []
    s = df.select(key.alias("k")).filter(share_hash(F.col("k"), salt=11) < min(1.0, SAMPLE_PER_RANGE * n / rows))
    s = s.agg(F.sort_array(F.collect_list("k")).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / n).cast("int")))
    found = s.select(F.array_distinct(F.filter(at, lambda x: x.isNotNull())).alias("c")).first()[0]
    return list(found)


def literal(value) -> Column:
    if isinstance(value, tuple):
        return F.struct(*[F.lit(v).alias(f) for f, v in value._asdict().items()] if hasattr(value, "_asdict") else [F.lit(value[f]).alias(f) for f in value.__fields__])
    return F.lit(bytes(value) if isinstance(value, bytearray) else value)


def range_index(key: Column, splits: list) -> Column:
    """How many splits are at most ``key``, by binary search."""
    n = len(splits)
    if not n:
        return F.lit(0)
    held = F.array(*[literal(s) for s in splits])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= n) & (F.get(held, i + s - 1) <= key), i + s).otherwise(i))


def positions(df: DataFrame, by: list[str], ident: list[str], rows: int, per_task: int = 20_000, name: str = "position") -> DataFrame:
    """Number the rows of each group from 0 without a gap; no task orders more than about ``per_task`` of them.

    Rows are dealt by a hash of ``ident`` into parts; a part starts where the counts of the parts before it end.
    Rows that agree on ``ident`` must be few or have it made unique first.
    """
    parts = max(1, -(-rows // per_task))
    d = df.withColumn("_part", F.pmod(F.xxhash64(*ident), F.lit(parts)).cast("int"))
    counts = d.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*by, "_part").orderBy(*ident)
    return d.withColumn("_own", F.row_number().over(own) - 1).join(starts, [*by, "_part"]).withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def ranks(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in its group, from 0 without a gap, by ``order`` (missing values first).

    Rows are cut into ranges of ``by`` and ``order`` and written, so a group of any size lies in neighbouring ranges and no task gets it
    whole; ``order`` must tell all rows of a group apart.  A range numbers its rows as they pass, and only the group that a range begins
    with is moved on, by what the ranges before hold of it: one number for each range, which is all that is sent to every task.
    """
    spark = df.sparkSession
    ship_package(spark)
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    d = df.repartitionByRange(width(spark), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, seen = None, 0, 0  # the keys of the row before, where its group began, and rows so far
        for p in batches:
            if not p.num_rows:
                continue
            new = np.zeros(p.num_rows, bool)
            for k, c in enumerate(by):
                col = pa.concat_arrays([p.column(c)[:1] if held is None else held[k], p.column(c)])
                same = pc.fill_null(pc.equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False)
                none = pc.is_null(col).to_numpy(zero_copy_only=False)
                new |= ~(same | (none[1:] & none[:-1]))
            held = [p.column(c)[-1:] for c in by]
            at = seen + np.arange(p.num_rows)
            start = np.maximum.accumulate(np.where(new, at, begun))
            begun, seen = int(start[-1]), seen + p.num_rows
            yield pa.RecordBatch.from_arrays([*p.columns, pa.array(at), pa.array(at - start)], [*p.schema.names, "_at", "_own"])

    d = cut_lineage(d.mapInArrow(number, T.StructType([*d.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_own", T.LongType())])))
    ends = d.groupBy("_part").agg(F.min_by(F.struct(*by), "_at").alias("head"), F.max_by(F.struct(*by, "_own"), "_at").alias("tail"))
    both = F.array(F.struct(F.col("head").alias("of"), F.lit(0).cast("long").alias("n")), F.struct(F.struct(*[f"tail.{c}" for c in by]).alias("of"), (F.col("tail._own") + 1).alias("n")))
    before = Window.partitionBy("of").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    moved = ends.select("_part", F.inline(both)).withColumn("_moved", F.sum("n").over(before)).filter("n = 0 and _moved > 0").select("_part", "_moved")
    d = d.join(F.broadcast(cut_lineage(moved)), "_part", "left")  # at most a row for each range
    return d.withColumn(name, F.col("_own") + F.when(F.col("_at") == F.col("_own"), F.coalesce("_moved", F.lit(0))).otherwise(0)).drop("_part", "_at", "_own", "_moved")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of an edge ``a, b`` (longs); component is the smallest node that can be reached.

    Each round hooks every node onto its smallest neighbour, follows parents to the roots, and replaces the graph by the one between
    roots, which is at most half as large.  All tables are written to the shared folder, so a lost executor costs a task, not the run.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")))
        while True:
            up = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            q = cut_lineage(p.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
            p = q.select("node", "parent")
            if q.filter("moved").isEmpty():
                break
        if out is None:
            out = p.withColumnRenamed("parent", "component")
        else:
            roots = p.select(F.col("node").alias("component"), "parent")
            out = cut_lineage(out.join(roots, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        a, b = p.select(F.col("node").alias("a"), F.col("parent").alias("ra")), p.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        e = cut_lineage(e.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return edges.sparkSession.createDataFrame([], "node long, component long") if out is None else out


__all__ = ["SAMPLE_PER_RANGE", "components", "cut_lineage", "free_name", "fresh_worker", "held_out", "likely", "literal", "marked", "positions", "range_index", "range_splits", "ranks", "share_hash", "ship_package", "temporary", "width"]
