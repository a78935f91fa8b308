"""Permutation and bootstrap (X17-X22).  Draws are functions of seed, replicate and id, so a recomputed task repeats them.

A row has a 32-bit word from md5 of seed and id; its draw in a replicate is that word and the replicate's own, mixed.  Replicates of
sums are made where the rows lie, a block of rows by all replicates at a time in NumPy, and only their sums are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rekurve.functions import tails
from rekurve.operators.ordered import attach, frame_index, quantiles
from rekurve.plans.session import cut_lineage


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Even out rows before each is multiplied by the number of replicates."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)


def draw(seed: int, *parts) -> Column:
    """32-bit number from md5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


MIX, MASK = 0x45D9F3B, 0xFFFFFFFF
#: Draws from which on a row occurs once, twice and so on: the Poisson distribution with mean one in parts of 2 ** 32.
OCCURS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)]
#: Rows that are drawn at once for all replicates, and groups whose sums a task holds.
BLOCK, HELD = 256, 64


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def mixed(word: Column) -> Column:
    """A 32-bit word in a long, well mixed."""
    fold = lambda x: x.bitwiseXOR(F.shiftright(x, 16))
    for _ in range(2):
        word = (_with(word, fold) * F.lit(MIX).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))
    return _with(word, fold)


def mixed_words(x: np.ndarray) -> np.ndarray:
    """The same for an array of unsigned 32-bit words."""
    for _ in range(2):
        x = x ^ (x >> np.uint32(16))
        x = x * np.uint32(MIX)
    return x ^ (x >> np.uint32(16))


def occurrences(word: Column, rep: Column) -> Column:
    """How often a row with this word occurs in a replicate: Poisson with mean one."""
    return _with(mixed(word.bitwiseXOR(mixed(rep.cast("long")))), lambda h: sum(((h >= F.lit(c).cast("long")).cast("int") for c in OCCURS), F.lit(0)))


def occurrence_matrix(words: np.ndarray, reps: int) -> np.ndarray:
    """The same for all words (rows) and replicates (columns)."""
    h = mixed_words(words.astype(np.uint32)[:, None] ^ mixed_words(np.arange(reps, dtype=np.uint32))[None, :])
    out = np.zeros(h.shape, np.uint8)
    for c in OCCURS:
        if c <= MASK:
            out += h >= np.uint32(c)
    return out


def permutation_test(df: DataFrame, group: str, value: str, row_id: str, first: str, second: str, reps: int, seed: int = 1) -> DataFrame:
    """Mean difference of every relabeling next to the observed one: ``rep, diff, observed``.

    A relabeling takes the n1 rows with the smallest draws.  Their cut is known up to a few standard deviations before anything is drawn:
    rows below that window only add to a replicate's sum, rows above it are left out, and just those inside, a share of about
    14 / sqrt(n), are shuffled and ordered.  Should a cut lie outside after all, the window is widened.
    """
    two = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    isa = F.col(group) == first
    obs = two.agg(F.count(F.when(isa, 1)), F.count(F.lit(1)), F.sum(value), F.avg(F.when(isa, F.col(value))) - F.avg(F.when(~isa, F.col(value)))).first()
    n1, n, total, observed = obs
    if not n1 or n1 == n:
        raise ValueError("both groups need values")
    rows = two.select(draw(seed, row_id).alias("word"), F.col(row_id).alias("id"), F.col(value).cast("double").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    share, spreads = n1 / n, 7.0
    while True:
        around = spreads * math.sqrt(share * (1 - share) / n)
        low, high = (min(max(int(x * 2**32), 0), 2**32) for x in (share - around, share + around))

        def relabel(batches: Iterator[pd.DataFrame], low: int = low, high: int = high) -> Iterator[pd.DataFrame]:
            count, sums = np.zeros(reps, np.int64), np.zeros(reps)
            turns = mixed_words(np.arange(reps, dtype=np.uint32))
            for p in batches:
                words, v = p["word"].to_numpy(np.int64).astype(np.uint32), p["v"].to_numpy(float)
                for k in range(0, len(p), BLOCK):
                    h = mixed_words(words[k : k + BLOCK, None] ^ turns).astype(np.int64)
                    below = h < low
                    count += below.sum(0)
                    sums += v[k : k + BLOCK] @ below
                    i, rep = np.nonzero(~below & (h < high))
                    yield pd.DataFrame({"rep": rep, "h": h[i, rep], "id": p["id"].to_numpy()[k + i], "v": v[k + i], "c": 1})
            yield pd.DataFrame({"rep": np.arange(reps), "h": pd.array([None] * reps, "Int64"), "id": pd.Series([None] * reps, dtype=object), "v": sums, "c": count})

        found = cut_lineage(rows.mapInPandas(relabel, f"rep int, h long, id {kind}, v double, c long"))
        whole = cut_lineage(found.groupBy("rep").agg(F.sum(F.when(F.col("h").isNull(), F.col("c"))).alias("before"), F.sum(F.when(F.col("h").isNull(), F.col("v"))).alias("whole"), F.count("h").alias("inside")))
        if whole.filter((F.col("before") > n1) | (F.col("before") + F.col("inside") < n1)).isEmpty():
            break
        spreads *= 4
    pos = F.row_number().over(Window.partitionBy("rep").orderBy("h", "id"))
    edge = found.filter("h is not null").join(whole.select("rep", (n1 - F.col("before")).alias("need")), "rep").withColumn("pos", pos).filter("pos <= need")
    s1 = F.col("whole") + F.coalesce("part", F.lit(0.0))
    out = whole.join(edge.groupBy("rep").agg(F.sum("v").alias("part")), "rep", "left")
    return out.select("rep", (s1 / n1 - (F.lit(float(total)) - s1) / (n - n1)).alias("diff"), F.lit(observed).alias("observed"))


def permutation_p(reps: DataFrame, smoothed: bool = False) -> DataFrame:
    hit = F.sum((F.abs("diff") >= F.abs("observed") - 1e-12).cast("int"))
    n = F.count(F.lit(1))
    return reps.agg(F.first("observed").alias("observed"), ((hit + 1) / (n + 1) if smoothed else hit / n).alias("p_value"), n.alias("reps"))


def bootstrap(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], reps: int, stat: Callable[[Column], Column] = F.avg, seed: int = 1) -> DataFrame:
    """V1: any Spark aggregate of a with-replacement sample per group and replicate: ``group, rep, stat``.

    A row occurs in each replicate as often as a Poisson draw with mean one says, independent of all other rows; ``order`` tells the rows
    of a group apart.  Nothing is joined: rows are repeated where they lie and aggregated there before the one exchange.  A replicate in
    which no row of a group occurs has no row.  Every row is made once for each of its replicates: a statistic of parts that combine is
    far cheaper by ``bootstrap_parts``.
    """
    group = list(group)
    rows = df.filter(F.col(value).isNotNull()).select(*group, value, draw(seed, *group, *order).alias("_word"))
    rows = spread(rows).select(*group, value, "_word", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    rows = rows.withColumn("_times", occurrences(F.col("_word"), F.col("rep"))).filter("_times > 0")
    rows = rows.select(*group, "rep", value, F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return rows.groupBy(*group, "rep").agg(stat(F.col(value)).alias("stat"))


COMBINE = {"sum": (np.add, F.sum, 0.0), "min": (np.fmin, F.min, np.inf), "max": (np.maximum, F.max, -np.inf)}


def bootstrap_parts(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], reps: int, how: Sequence[str], block: Callable[[np.ndarray, np.ndarray], np.ndarray], seed: int = 1) -> DataFrame:
    """V1: a statistic made of parts that combine, for the same draws as ``bootstrap``, thousands of replicates at a time: ``group, rep, n, s0, s1 ..``.

    ``block`` gets values and how often each occurs (value x replicate) and returns a row per part; parts of blocks are combined by ``how``
    (sum, min or max).  A task keeps the parts of each group and replicate, which are all that is shuffled.
    """
    group, how = list(group), ["sum", *how]
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"), draw(seed, *group, *order).alias("_word"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=[*group]) if group else pd.DataFrame(index=range(len(held)))
            return out.assign(s=[m.ravel() for m in held.values()])

        for p in batches:
            codes = p.groupby(group, dropna=False, sort=False).ngroup().to_numpy() if group else np.zeros(len(p), int)
            words, v = p["_word"].to_numpy(np.int64).astype(np.uint32), p["_v"].to_numpy(float)
            for c in range(int(codes.max(initial=-1)) + 1):
                at = np.flatnonzero(codes == c)
                key = tuple(None if pd.isna(x) else x for x in p[group].iloc[at[0]]) if group else ()
                if key not in held:
                    held[key] = np.repeat([[COMBINE[h][2]] for h in how], reps, axis=1)
                total = held[key]
                for k in range(0, len(at), BLOCK):
                    i = at[k : k + BLOCK]
                    times = occurrence_matrix(words[i], reps)
                    total[0] += times.sum(0, dtype=np.int64)
                    for one, h, new in zip(total[1:], how[1:], block(v[i], times)):
                        COMBINE[h][0](one, new, out=one)
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    schema = "".join(f"`{c}` {types[c]}, " for c in group) + "s array<double>"
    part = spread(rows).mapInPandas(parts, schema)
    one = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.struct(r.alias("rep"), *[F.get("s", r + F.lit(k * reps)).alias(f"s{k}") for k in range(len(how))]))
    g = part.select(*group, F.inline(one)).groupBy(*group, "rep").agg(*[COMBINE[h][1](f"s{k}").alias(f"s{k}") for k, h in enumerate(how)]).filter("s0 > 0")
    return g.select(*group, "rep", F.col("s0").cast("long").alias("n"), *[F.col(f"s{k + 1}").alias(f"s{k}") for k in range(len(how) - 1)])


def bootstrap_moments(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], reps: int, seed: int = 1) -> DataFrame:
    """``group, rep, n, mean, var`` (of the sample): a block of rows is multiplied by its matrix of occurrences."""
    middle = df.agg(F.avg(F.col(value).cast("double"))).first()[0] or 0.0  # sums of squares around it lose nothing

    def block(v: np.ndarray, times: np.ndarray) -> np.ndarray:
        d = v - middle
        return np.stack([d, d * d]) @ times.astype(float)

    g = bootstrap_parts(df, group, value, order, reps, ["sum", "sum"], block, seed)
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("s1") - F.col("s0") * F.col("s0") / F.col("n"))) / (F.col("n") - 1))
    return g.select(*group, "rep", "n", (F.lit(middle) + F.col("s0") / F.col("n")).alias("mean"), var.alias("var"))


def bootstrap_range(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], reps: int, seed: int = 1) -> DataFrame:
    """V1: ``group, rep, stat``, the largest less the smallest value of each replicate."""

    def block(v: np.ndarray, times: np.ndarray) -> np.ndarray:
        here = times > 0
        return np.stack([np.where(here, v[:, None], np.inf).min(0), np.where(here, v[:, None], -np.inf).max(0)])

    g = bootstrap_parts(df, group, value, order, reps, ["min", "max"], block, seed)
    return g.select(*group, "rep", (F.col("s1") - F.col("s0")).alias("stat"))


def difference_interval(boot: DataFrame, group: str, first: str, second: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of the difference of two groups' bootstrap statistics; one row."""
    a = boot.filter(F.col(group) == first).select("rep", F.col("stat").alias("a"))
    z = boot.filter(F.col(group) == second).select("rep", F.col("stat").alias("z"))
    d = a.join(z, "rep").select((F.col("a") - F.col("z")).alias("d"))
    q = quantiles(d, [], "d", [(1 - level) / 2, 1 - (1 - level) / 2])
    return q.crossJoin(F.broadcast(d.agg(F.avg("d").alias("mean"), F.count("d").alias("reps")))).select("mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "reps")


def bca_interval(df: DataFrame, boot: DataFrame, group: str, value: str, level: float = 0.95) -> DataFrame:
    """X19 for the mean: bias from the replicates, acceleration from the third moment (leave-one-out means in closed form)."""
    m = df.groupBy(group).agg(F.avg(value).alias("est"), F.count(value).alias("n"), F.skewness(value).alias("skew"))
    j = boot.select(group, "stat").join(m, group)  # the replicates may have columns n of their own
    g = j.groupBy(group).agg(
        F.avg((F.col("stat") < F.col("est")).cast("double")).alias("below"), F.first("est").alias("est"), F.first("n").alias("n"), F.first("skew").alias("skew"),
        F.sort_array(F.collect_list("stat")).alias("s"),  # one value per replicate
    )
    g = g.withColumn("z0", tails.normal_quantile(F.col("below"))).withColumn("acc", F.col("skew") / (6 * F.sqrt("n")))
    for name, z in (("lo", -1.959963984540054), ("hi", 1.959963984540054)):
        zz = F.col("z0") + F.lit(z)
        adj = F.col("z0") + zz / (1 - F.col("acc") * zz)
        p = 1 - tails.normal_two_sided(adj) / 2
        p = F.when(adj >= 0, p).otherwise(1 - p)
        pos = p * (F.size("s") - 1)
        low = F.get("s", F.floor(pos).cast("int"))
        high = F.get("s", F.ceil(pos).cast("int"))
        g = g.withColumn(name, low + (high - low) * (pos - F.floor(pos)))
    return g.select(group, "est", "z0", "acc", "lo", "hi")


def bootstrap_effect(df: DataFrame, group: str, value: str, order: Sequence[str], first: str, second: str, reps: int, seed: int = 1) -> DataFrame:
    """Hedges g per replicate."""
    b = bootstrap_moments(df.filter(F.col(group).isin(first, second)), [group], value, order, reps, seed)
    a = b.filter(F.col(group) == first).select("rep", F.struct("n", "mean", "var").alias("a"))
    z = b.filter(F.col(group) == second).select("rep", F.struct("n", "mean", "var").alias("z"))
    n1, n2 = F.col("a.n"), F.col("z.n")
    sp = F.sqrt(((n1 - 1) * F.col("a.var") + (n2 - 1) * F.col("z.var")) / (n1 + n2 - 2))
    return a.join(z, "rep").select("rep", (F.try_divide(F.col("a.mean") - F.col("z.mean"), sp) * (1 - 3 / (4 * (n1 + n2) - 9))).alias("g"))


def residual_bootstrap_rows(df: DataFrame, keys: Sequence[str], t: str, y: str, fitted: Column, reps: int, seed: int = 1) -> DataFrame:
    """X21 input: curves of ``fitted + resampled residual``; (curve, rep) is the key of the refits."""
    keys = list(keys)
    rows = df.select(*keys, t, F.col(y).alias("_y"), fitted.alias("_fit"))
    rows = frame_index(rows, keys, [t, "_y"], "_f")
    rows = cut_lineage(attach(rows, keys, _n=F.count(F.lit(1))))
    ex = rows.select(*keys, t, "_fit", "_n", "_f", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    ex = ex.withColumn("_pick", draw(seed, *keys, "rep", "_f") % F.col("_n")).drop("_f")
    res = rows.select(*keys, F.col("_f").alias("_pick"), (F.col("_y") - F.col("_fit")).alias("_res"))
    return ex.join(res, [*keys, "_pick"]).select(*keys, "rep", t, (F.col("_fit") + F.col("_res")).alias("y"))


def curve_bootstrap_means(aligned: DataFrame, group: str, curve: str, reps: int, seed: int = 1, x: str = "x", y: str = "yi") -> DataFrame:
    """X22 input: mean curve of curves drawn with replacement, per group and replicate.

    Curves get integer multiplicities, so the points are read once per replicate they occur in and never joined to draws.
    """
    ids = frame_index(aligned.select(group, curve).distinct(), [group], [curve])
    ids = cut_lineage(attach(ids, [group], n=F.count(F.lit(1))))
    picks = ids.select(group, "n", "frame", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    mult = picks.select(group, "rep", (draw(seed, group, "rep", "frame") % F.col("n")).alias("frame")).groupBy(group, "rep", "frame").agg(F.count(F.lit(1)).alias("m"))
    chosen = mult.join(ids.select(group, "frame", curve), [group, "frame"])
    return aligned.join(chosen, [group, curve]).groupBy(group, "rep", "j").agg(F.first(x).alias("x"), (F.sum(F.col("m") * F.col(y)) / F.sum("m")).alias("mean"))
