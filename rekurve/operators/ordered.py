"""Ordered work inside groups, without ever putting a whole hot group into one task.

A *frame* is a dense 0-based position inside a group.  ``frame_index`` assigns it, the other functions use it:
``frame div segment_rows`` cuts a group into bounded segments, window functions run per segment, and rows near a
border are copied into the neighbouring segment so that bounded frames see everything they need.  Unbounded frames
(running sums, fill-forward) add a carry computed from one summary row per segment.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT_ROWS = 1_000_000
SEGMENT_CONF = "spark.rekurve.segmentRows"
#: Quantiles of a whole table above SELECT_ROWS are found by counts in SELECT_BINS ranges of values, narrowed until so few values are left.
SELECT_ROWS, SELECT_BINS = 100_000, 4096


def segment_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SEGMENT_CONF, str(SEGMENT_ROWS)))


def bounded(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a counted bound is known: ``frame_index`` notes in its column's metadata the keys whose groups it found
    to fit into a segment.  Projections, filters and one-to-one joins keep that note; ``unbound`` removes it."""
    return any(set(f.metadata["bounded_by"]) <= set(keys) for f in df.schema.fields if "bounded_by" in f.metadata)


def unbound(df: DataFrame) -> DataFrame:
    """Forget the bound, for steps that multiply rows."""
    noted = {f.name for f in df.schema.fields if "bounded_by" in f.metadata}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={}) if c in noted else F.col(f"`{c}`") for c in df.columns])


def attach(df: DataFrame, keys: Sequence[str], **aggs: Column | Callable) -> DataFrame:
    """Add per-group aggregates to every row: ``name=F.avg("y")``, or ``name=lambda o: o(F.sum("a")) / o(F.sum("b"))``.

    Groups with a known bound use a window, which shares the shuffle of the neighbouring steps.  Otherwise the rows are
    aggregated with map-side combine and joined back, where a hot group can be split.
    """
    windows = bounded(df, keys)
    w = Window.partitionBy(*keys) if windows else None
    over = (lambda c: c.over(w)) if windows else (lambda c: c)
    cols = [(over(a) if isinstance(a, Column) else a(over)).alias(n) for n, a in aggs.items()]
    if windows:
        return df.select("*", *cols)
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*cols)))  # exactly one row
    return df.join(df.groupBy(*keys).agg(*cols), list(keys))


def reindex(df: DataFrame, position: Column, frame: str = "frame") -> DataFrame:
    """Renumber frames inside their groups, keeping the noted bound."""
    return df.withColumn(frame, position.alias(frame, metadata=df.schema[frame].metadata))


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> list:
    """Groups above ``limit`` rows; at most rows/limit of them, so the list is small by construction."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > limit).collect()


def _segment_by_splits(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: list, rows: int) -> DataFrame:
    """Add ``_seg`` so that segments of hot groups are ordered, disjoint ranges of about ``rows`` rows; 0 elsewhere.

    Split points come from a hash-selected part of the order keys, so a recomputed task finds the same ones.
    """
    spark = df.sparkSession
    on = list(keys) or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))
    types = {f.name: f.dataType for f in df.schema.fields}
    info_schema = ", ".join(f"`{k}` {types[k].simpleString()}" for k in on) + ", _n long"
    info = spark.createDataFrame([tuple(r[k] for k in keys) + (r["_n"],) if keys else (0, r["_n"]) for r in hot], info_schema)
    info = info.withColumn("_b", F.ceil(F.col("_n") / rows).cast("int"))
    info = info.withColumn("_m", F.greatest(F.lit(1), F.floor(F.col("_n") / (16 * F.col("_b")))).cast("long"))
    place = F.struct(*[F.col(c) for c in order])
    picked = (
        df.join(F.broadcast(info), on)
        .filter(F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.col("_m")) == 0)
        .groupBy(*on)
        .agg(F.sort_array(F.collect_set(place)).alias("_s"), F.first("_b").alias("_b"))
        .select(
            *on,
            F.array_distinct(
                F.expr("transform(sequence(1, _b), i -> get(_s, cast(floor(i * size(_s) / (_b + 1)) as int)))")
            ).alias("_splits"),
        )
    )
    # about 2 * rows(df) / rows split points in total
    joined = df.join(F.broadcast(picked), on, "left").withColumn("_place", place)
    widest = max(r["_n"] // rows + 2 for r in hot)
    powers = [1 << b for b in reversed(range(int(widest).bit_length() + 1))]
    steps = "array(" + ",".join(map(str, powers)) + ")"
    found = F.expr(
        f"aggregate({steps}, 0, (lo, s) -> if(lo + s <= size(_splits) and get(_splits, lo + s - 1) <= _place, lo + s, lo))"
    )
    out = joined.withColumn("_seg", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(found)).drop("_splits", "_place")
    return out


def frame_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "frame") -> DataFrame:
    """Dense 0-based position of each row in its group by ``order`` (ascending; give full tie-breaks)."""
    rows = segment_rows(df)
    hot = hot_groups(df, keys, rows)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*order)
        pos = F.row_number().over(w).cast("long") - 1
        return df.withColumn(out, pos.alias(out, metadata={"bounded_by": list(keys)}))
    on = list(keys) or ["_all"]
    seg = _segment_by_splits(df, keys, order, hot, rows)
    sizes = seg.groupBy(*on, "_seg").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy(*on).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).filter("_start > 0").drop("_c")
    local = Window.partitionBy(*on, "_seg").orderBy(*order)
    return (
        seg.withColumn("_rn", F.row_number().over(local).cast("long") - 1)
        .join(F.broadcast(starts), [*on, "_seg"], "left")  # only later segments of hot groups: rows/segment_rows
        .withColumn(out, F.col("_rn") + F.coalesce("_start", F.lit(0)))
        .drop("_rn", "_start", "_seg", "_all")
    )


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    build: Callable[[Window], dict[str, Column]],
    before: int = 1,
    after: int = 0,
    frame: str = "frame",
) -> DataFrame:
    """Add columns computed over a frame-ordered window that looks at most ``before``/``after`` rows away."""
    if bounded(df, keys):
        return df.select("*", *[c.alias(n) for n, c in build(Window.partitionBy(*keys).orderBy(frame)).items()])
    rows = segment_rows(df)
    seg = F.floor(F.col(frame) / rows).cast("long")
    off = F.col(frame) % rows
    targets = [F.array(seg)]
    if before:
        targets.append(F.when(off >= rows - before, F.array(seg + 1)).otherwise(F.array().cast("array<bigint>")))
    if after:
        targets.append(F.when((off < after) & (seg > 0), F.array(seg - 1)).otherwise(F.array().cast("array<bigint>")))
    near_border = (off >= rows - before) if before else F.lit(False)
    if after:
        near_border = near_border | (off < after)
    wide = df.withColumn("_win", F.explode(F.when(near_border, F.concat(*targets)).otherwise(F.array(seg))))
    w = Window.partitionBy(*keys, "_win").orderBy(frame)
    cols = build(w)
    return (
        wide.select("*", *[c.alias(n) for n, c in cols.items()])
        .filter(F.col("_win") == seg)
        .drop("_win")
    )


def running(df: DataFrame, keys: Sequence[str], value: Column, out: str, agg: Callable = F.sum, merge: Callable = lambda a, b: a + b, frame: str = "frame", reverse: bool = False) -> DataFrame:
    """Inclusive running aggregate by frame (from the end if ``reverse``): a window per segment, merged with the aggregate of the segments before it."""
    towards = (lambda c: F.desc(c)) if reverse else (lambda c: F.asc(c))
    if bounded(df, keys):
        return df.withColumn(out, agg(value).over(Window.partitionBy(*keys).orderBy(towards(frame)).rowsBetween(Window.unboundedPreceding, 0)))
    rows = segment_rows(df)
    work = df.withColumn("_seg", F.floor(F.col(frame) / rows).cast("long")).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_seg").orderBy(towards(frame)).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn(out, agg("_v").over(local))
    totals = work.groupBy(*keys, "_seg").agg(agg("_v").alias("_tot"))
    ahead = Window.partitionBy(*keys).orderBy(towards("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per segment: small beside the rows, and joined as Spark sees fit
    carry = totals.select(*keys, "_seg", agg("_tot").over(ahead).alias("_carry")).filter("_carry is not null")
    merged = F.when(F.col("_carry").isNull(), F.col(out)).when(F.col(out).isNull(), F.col("_carry")).otherwise(merge(F.col(out), F.col("_carry")))
    return work.join(carry, [*keys, "_seg"], "left").withColumn(out, merged).drop("_seg", "_v", "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], value: Column, out: str, frame: str = "frame") -> DataFrame:
    """Inclusive running sum by frame."""
    return running(df, keys, value, out, frame=frame)


def fill_forward(df: DataFrame, keys: Sequence[str], value: str, out: str, frame: str = "frame") -> DataFrame:
    """Last non-null value at or before the frame."""
    if bounded(df, keys):
        w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    rows = segment_rows(df)
    work = df.withColumn("_seg", F.floor(F.col(frame) / rows).cast("long"))
    local = Window.partitionBy(*keys, "_seg").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("_local", F.last(value, ignorenulls=True).over(local))
    ends = work.groupBy(*keys, "_seg").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(frame))).alias("_end")
    )
    ahead = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_seg", F.last("_end", ignorenulls=True).over(ahead).alias("_carry")).filter(
        "_carry is not null"
    )
    return (
        work.join(F.broadcast(carry), [*keys, "_seg"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_seg", "_local", "_carry")
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Distinct values with counts and average ranks: ``keys, [by], value, cnt, below, total, avg_rank``.

    Copies of a value collapse before anything is sorted (``weight`` counts already collapsed rows); ranks are over all ``by`` groups of a key together.
    """
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = clean.groupBy(*keys, *by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("cnt"))
    tot = per.groupBy(*keys, value).agg(F.sum("cnt").alias("total")) if by else per.withColumnRenamed("cnt", "total")
    placed = running_sum(frame_index(tot, keys, [value], "_f"), keys, F.col("total"), "_cum", "_f")
    placed = placed.select(
        *keys,
        value,
        "total",
        (F.col("_cum") - F.col("total")).alias("below"),
        (F.col("_cum") - F.col("total") + (F.col("total") + 1) / 2).alias("avg_rank"),
    )
    if by:
        return per.join(placed, [*keys, value])
    return placed.withColumn("cnt", F.col("total"))


def _selected(v: DataFrame, n: int, low: float, high: float, places: Sequence[int]) -> list[float]:
    """Values at these places (0-based, ascending) of the ``n`` values ``v`` from ``low`` to ``high``.

    A pass counts the values in equal ranges, so only counts are shuffled; the next one looks at the range that holds the place.
    """
    found: dict[int, float] = {}
    todo = [(low, high, n, 0, sorted(set(places)))]
    while todo:
        lo, hi, size, below, at = todo.pop()
        if lo == hi:
            found |= dict.fromkeys(at, lo)
            continue
        inside = v.filter(F.col("v").between(lo, hi))
        few = size <= SELECT_BINS
        share = F.floor((F.col("v") - lo) / (hi - lo) * SELECT_BINS)
        ranges = inside.groupBy((F.col("v") if few else F.least(share, F.lit(SELECT_BINS - 1))).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(ranges.collect(), key=lambda r: r["b"]):  # at most SELECT_BINS rows
            own = [k for k in at if below <= k < below + r["n"]]
            if own:
                todo.append((r["lo"], r["hi"], r["n"], below, own))
            below += r["n"]
    return [found[k] for k in places]


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles per group as ``array<double>`` in ``out``.

    Bounded groups use ``percentile``; hot groups are ranked by distinct value in segments instead, and a whole table is narrowed by counts.
    """
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not keys:
        v = clean.select((F.col(value).cast("double") + 0.0).alias("v"))  # no -0.0
        n, low, high = v.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
        if n > min(SELECT_ROWS, segment_rows(df)) and math.isfinite(high - low):
            at = [p * (n - 1) for p in probs]
            ends = _selected(v, n, low, high, [i for x in at for i in (math.floor(x), math.ceil(x))])
            mixed = [a if a == z else (math.ceil(x) - x) * a + (x - math.floor(x)) * z for x, a, z in zip(at, ends[::2], ends[1::2])]
            return df.sparkSession.createDataFrame([(mixed,)], f"{out} array<double>")
    if bounded(df, keys) or not hot_groups(clean, keys, segment_rows(df)):
        ps = F.array(*[F.lit(float(p)) for p in probs])
        return clean.groupBy(*keys).agg(F.percentile(value, ps).alias(out))
    ranked = value_ranks(clean, keys, value)
    n = ranked.groupBy(*keys).agg(F.sum("total").alias("_n"))
    ranked = ranked.join(n, list(keys)) if keys else ranked.crossJoin(F.broadcast(n))
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("total"))
        aggs.append(F.max(F.when(holds(F.floor(pos)), F.col(value))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(holds(F.ceil(pos)), F.col(value))).alias(f"_hi{i}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_w{i}"))
    mix = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}") for i in range(len(probs))]
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, F.array(*mix).alias(out))


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str], rows: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of at least ``rows`` rows (the last one fewer) that hold whole groups of rows sorted by group, and where each group begins."""
    held, count = [], 0
    for p in batches:
        held.append(p)
        count += len(p)
        if count < rows:
            continue
        b = pd.concat(held, ignore_index=True)
        starts = group_starts(b, keys)
        done = int(starts[-1])
        if done:
            yield b.iloc[:done], starts[:-1]
        held, count = [b.iloc[done:]], len(b) - done
    if count:
        b = pd.concat(held, ignore_index=True)
        yield b, group_starts(b, keys)


def group_starts(b: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Where each group begins among rows sorted by group; missing keys are a value like any other."""
    new = np.zeros(len(b), bool)
    new[0] = True
    for k in keys:
        codes = pd.factorize(b[k], use_na_sentinel=False)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)
