"""Group statistics from moments, ranks and counts (section 2.11)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rekurve.functions import tails
from rekurve.operators import ordered as od
from rekurve.operators.groups import pairs
from rekurve.operators.ordered import attach, frame_index, quantiles, running_sum, value_ranks, whole_groups, windowed
from rekurve.plans.session import cut_lineage, ship_package

#: Rows of counts that a task holds at once, and cells of a table of values by groups.
WINS_ROWS, WINS_CELLS = 50_000, 1_000_000


def moments(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def welch(mom: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every pair of groups."""
    p = pairs(mom, group, keys)
    a, z = F.col("var_1") / F.col("n_1"), F.col("var_2") / F.col("n_2")
    t = F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(a + z))
    df = F.try_divide((a + z) * (a + z), a * a / (F.col("n_1") - 1) + z * z / (F.col("n_2") - 1))
    return p.withColumn("t_stat", t).withColumn("df", df)


def student(mom: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled variance."""
    p = pairs(mom, group, keys)
    n1, n2 = F.col("n_1"), F.col("n_2")
    sp = ((n1 - 1) * F.col("var_1") + (n2 - 1) * F.col("var_2")) / (n1 + n2 - 2)
    return p.withColumn("t_stat", F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(sp * (1 / n1 + 1 / n2)))).withColumn("df", n1 + n2 - 2)


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", tails.t_two_sided(F.col("t_stat"), F.col("df")))


def _wins(counts: DataFrame, kind: str) -> DataFrame:
    """Of counts ``c`` by value ``v`` and group ``g``, for each range ``part`` of values: wins ``u`` of group ``g1`` over ``g2`` inside it, and ``x``, what
    the two have in ties together; a row with ``g1 = g2`` has a group's size there and its own cubes less its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wins, ties = [], np.zeros((0, 0)), np.zeros((0, 0))  # groups seen in this range
        size, cubes, part = np.zeros(0), np.zeros(0), None
        for p, starts in whole_groups(batches, ["v"], WINS_ROWS):
            part = int(p["part"].iloc[0])
            names += sorted(set(p["g"]) - set(names))
            more = len(names) - len(size)
            size, cubes = np.pad(size, (0, more)), np.pad(cubes, (0, more))
            wins, ties = np.pad(wins, (0, more)), np.pad(ties, (0, more))
            code = pd.Categorical(p["g"], categories=names).codes
            c, starts = p["c"].to_numpy(float), np.append(starts, len(p))
            for i in range(0, len(starts) - 1, step := max(1, WINS_CELLS // len(names))):
                at = starts[i : i + step + 1]
                m = np.zeros((len(at) - 1, len(names)))
                m[np.repeat(np.arange(len(at) - 1), np.diff(at)), code[at[0] : at[-1]]] = c[at[0] : at[-1]]
                wins += m.T @ (size + np.cumsum(m, 0) - m / 2)
                both = (m * m).T @ m
                ties += 3 * (both + both.T)
                size, cubes = size + m.sum(0), cubes + (m**3).sum(0)
        if part is not None:
            np.fill_diagonal(wins, size)
            np.fill_diagonal(ties, cubes - size)
            i, j = np.nonzero(np.triu(np.ones(wins.shape)))
            yield pd.DataFrame({"part": part, "g1": pd.Series([names[k] for k in i], dtype=object), "g2": pd.Series([names[k] for k in j], dtype=object), "u": wins[i, j], "x": ties[i, j], "r": wins[j, i]})

    ship_package(counts.sparkSession)
    ranged = counts.repartitionByRange("v").sortWithinPartitions("v").select(F.spark_partition_id().alias("part"), "g", "v", F.col("c").cast("double").alias("c"))
    return ranged.mapInPandas(run, f"part int, g1 {kind}, g2 {kind}, u double, x double, r double")


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """X3 for every pair of groups, with tie correction and continuity; ``u1`` counts wins of the first group.

    Rows collapse to (group, value) counts, which are cut into ranges of values and counted there for all pairs at once; a range adds for
    each pair its own wins and, by sizes alone, those over the ranges before it.
    """
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(group).isNotNull())
    counts = clean.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = _wins(counts, df.schema[group].dataType.simpleString())
    flip = F.col("g1") > F.col("g2")  # groups come in the order in which they were seen
    w = w.select("part", F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"), F.when(flip, F.col("r")).otherwise(F.col("u")).alias("u"), "x")
    w = cut_lineage(w)
    inside = w.filter("g1 < g2").groupBy("g1", "g2").agg(F.sum("u").alias("u"), F.sum("x").alias("x"))
    own = w.filter("g1 = g2").select("part", F.col("g1").alias("g"), F.col("u").alias("n"), F.col("x").alias("t"))
    grid = own.select("part").distinct().crossJoin(own.select("g").distinct()).join(own, ["part", "g"], "left").fillna(0.0, ["n", "t"])  # ranges times groups
    grid = cut_lineage(grid.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    first, second = (grid.select("part", F.col("g").alias(f"g{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "t", "before")]) for k in (1, 2))
    cross = first.join(second, "part").filter("g1 < g2").groupBy("g1", "g2").agg(
        F.sum(F.col("n1") * F.col("before2")).alias("over"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("t1") + F.col("t2")).alias("t")
    )
    j = cross.join(inside, ["g1", "g2"], "left")
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    ties = F.col("t") + F.coalesce("x", F.lit(0.0))
    u1 = F.col("over") + F.coalesce("u", F.lit(0.0))
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, sd)
    return j.select("g1", "g2", n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u1.alias("u1"), z.alias("z"))


def rank_effects(mw: DataFrame) -> DataFrame:
    """Effect sizes that follow from U; no pair of values is ever formed."""
    prod = F.col("n1") * F.col("n2")
    return mw.select("*", (F.col("u1") / prod).alias("cles"), (2 * F.col("u1") / prod - 1).alias("cliffs_delta"), (1 - 2 * F.least(F.col("u1"), prod - F.col("u1")) / prod).alias("rank_biserial"))


def mean_effects(mom: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen d (pooled) and Hedges g."""
    p = pairs(mom, group, keys)
    n1, n2 = F.col("n_1"), F.col("n_2")
    sp = F.sqrt(((n1 - 1) * F.col("var_1") + (n2 - 1) * F.col("var_2")) / (n1 + n2 - 2))
    d = F.try_divide(F.col("mean_1") - F.col("mean_2"), sp)
    return p.withColumn("cohen_d", d).withColumn("hedges_g", d * (1 - 3 / (4 * (n1 + n2) - 9)))


def anova(mom: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """F, degrees of freedom, eta squared and omega squared from group moments."""
    m = attach(mom, list(keys), _n=F.sum("n"), _gm=lambda o: o(F.sum(F.col("n") * F.col("mean"))) / o(F.sum("n")))
    g = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_gm"), 2)).alias("ssb"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw")
    )
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    msw = F.col("ssw") / df2
    return g.select(
        *keys, "n", df1.alias("df1"), df2.alias("df2"), F.try_divide(F.col("ssb") / df1, msw).alias("f_stat"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta2"),
        ((F.col("ssb") - df1 * msw) / (F.col("ssb") + F.col("ssw") + msw)).alias("omega2"),
    )


def rank_sums(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rank sum and count per group, total count and tie term)."""
    r = value_ranks(df, list(keys), value, [group])
    per = r.groupBy(*keys, group).agg(F.sum(F.col("cnt") * F.col("avg_rank")).alias("rank_sum"), F.sum("cnt").alias("n"))
    tie = r.select(*keys, value, "total").distinct().groupBy(*keys).agg(F.sum("total").alias("total"), F.sum(F.pow("total", 3) - F.col("total")).alias("ties"))
    return per, tie


def kruskal(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """H with tie correction."""
    per, tie = rank_sums(df, group, value, keys)
    g = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"))
    j = g.join(tie, list(keys)) if keys else g.crossJoin(F.broadcast(tie))  # one row each
    n = F.col("total").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return j.select(*keys, "k", F.col("total").alias("n"), h.alias("h"), (F.col("k") - 1).alias("df"))


def dunn(df: DataFrame, group: str, value: str) -> DataFrame:
    """Z of mean rank differences and the number of comparisons for Bonferroni."""
    per, tie = rank_sums(df, group, value)
    p = pairs(per.withColumn("mean_rank", F.col("rank_sum") / F.col("n")).drop("rank_sum"), group).crossJoin(F.broadcast(tie))  # one row
    n = F.col("total").cast("double")
    var = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("n_1") + 1 / F.col("n_2"))
    out = p.select("g1", "g2", F.try_divide(F.col("mean_rank_1") - F.col("mean_rank_2"), F.sqrt(var)).alias("z"))
    return out.crossJoin(F.broadcast(per.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("comparisons"))))


def dunn_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_adj", F.least(F.lit(1.0), tails.normal_two_sided(F.col("z")) * F.col("comparisons")))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """ANOVA of absolute deviations from the group median."""
    med = quantiles(df, [group], value, [0.5]).select(group, F.col("q")[0].alias("_med"))
    return anova(moments(df.join(med, group).withColumn("_dev", F.abs(F.col(value) - F.col("_med"))), [], group, "_dev"))


def shapiro(df: DataFrame, group: str, value: str) -> DataFrame:
    """W by Royston's approximation (calibrated up to 5000 values) and its p value, from positions and normal scores.

    A group of fewer than 3 values keeps its row with NULL and a ``reason``.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(value).alias("_n"))
    clean = df.filter(F.col(value).isNotNull()).select(group, value)
    pos = attach(frame_index(clean, [group], [value]), [group], n=F.count(F.lit(1)), _mean=F.avg(value))
    m = tails.normal_quantile((F.col("frame") + 1 - 0.375) / (F.col("n") + 0.25))
    pos = pos.withColumn("m", m).withColumn("x", F.col(value) - F.col("_mean"))
    at = lambda k, c: F.max(F.when(F.col("frame") == k, F.col(c)))
    g = pos.groupBy(group).agg(
        F.first("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), F.sum(F.col("x") * F.col("x")).alias("ss"),
        at(F.lit(0), "x").alias("x1"), at(F.lit(1), "x").alias("x2"), at(F.col("n") - 1, "x").alias("xn"), at(F.col("n") - 2, "x").alias("xm"),
        at(F.col("n") - 1, "m").alias("m1"), at(F.col("n") - 2, "m").alias("m2"),
    ).filter("n >= 3")
    u = 1 / F.sqrt("n")
    c1, c2 = F.col("m1") / F.sqrt("mm"), F.col("m2") / F.sqrt("mm")
    # fixed values: Royston's polynomial coefficients
    poly = lambda cs, x: sum((F.lit(c) * F.pow(x, i) for i, c in enumerate(cs)), F.lit(0.0))
    an = c1 + poly([0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], u)
    am = c2 + poly([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
    g = g.withColumn("an", F.when(F.col("n") == 3, 0.7071067811865476).otherwise(an)).withColumn("am", am)
    many = F.col("n") > 5
    phi = F.when(many, (F.col("mm") - 2 * F.pow("m1", 2) - 2 * F.pow("m2", 2)) / (1 - 2 * F.pow("an", 2) - 2 * F.pow("am", 2))).otherwise((F.col("mm") - 2 * F.pow("m1", 2)) / (1 - 2 * F.pow("an", 2)))
    ends = F.col("an") * (F.col("xn") - F.col("x1"))
    inner1 = (F.col("mx") - F.col("m1") * (F.col("xn") - F.col("x1"))) / F.sqrt("phi")
    inner2 = (F.col("mx") - F.col("m1") * (F.col("xn") - F.col("x1")) - F.col("m2") * (F.col("xm") - F.col("x2"))) / F.sqrt("phi")
    b = F.when(F.col("n") == 3, ends).when(many, ends + F.col("am") * (F.col("xm") - F.col("x2")) + inner2).otherwise(ends + inner1)
    w = F.least(F.lit(1.0), b * b / F.col("ss"))
    g = g.withColumn("phi", phi).withColumn("w", w)
    n, ln = F.col("n"), F.ln("n")
    small = n <= 11
    gam = poly([-2.273, 0.459], n)
    y = F.when(small, -F.ln(gam - F.ln(1 - F.col("w")))).otherwise(F.ln(1 - F.col("w")))
    mu = F.when(small, poly([0.5440, -0.39978, 0.025054, -6.714e-4], n)).otherwise(poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln))
    sd = F.exp(F.when(small, poly([1.3822, -0.77857, 0.062767, -0.0020322], n)).otherwise(poly([-0.4803, -0.082676, 0.0030302], ln)))
    g = g.withColumn("z", (y - mu) / sd)
    two = tails.normal_two_sided(F.col("z"))
    p3 = F.greatest(F.lit(0.0), 1.909859 * (F.asin(F.sqrt("w")) - 1.047198))
    p = F.when(F.col("n") == 3, p3).otherwise(F.when(F.col("z") > 0, two / 2).otherwise(1 - two / 2))
    found = sizes.join(g.select(group, "w", p.alias("p_value")), F.col("_g").eqNullSafe(F.col(group)), "left")
    return found.select(F.col("_g").alias(group), F.col("_n").alias("n"), "w", "p_value", F.when(F.col("_n") < 3, "fewer than 3 values").alias("reason"))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; above 1000 by its asymptotic series, which is exact to the last digit there."""
    few = F.expr("aggregate(sequence(1, cast({m} as int)), 0.0D, (s, i) -> s + 1.0D / i)".replace("{m}", "least(_m, 1000)"))
    return F.when(m <= 1000, few).otherwise(F.ln(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))


def adjust(df: DataFrame, p: str, method: str = "bh", keys: Sequence[str] = (), out: str = "p_adj") -> DataFrame:
    """None, bonferroni, holm, bh, by; NULL p values stay NULL and do not count.

    Equal p values have equal adjusted ones, so a family is ranked by distinct value; running minima and maxima go by ordered
    segments, and a family of any size is spread over tasks.
    """
    if method == "none":
        return df.withColumn(out, F.col(p))
    keys = list(keys)
    if method == "bonferroni":
        d = od.attach(df, keys, _m=F.count(p))
        return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_m")))).drop("_m")
    df = cut_lineage(df)  # read several times below
    v = od.frame_index(od.value_ranks(df, keys, p), keys, [p], "_f")
    v = od.attach(v, keys, _m=F.sum("total"))
    if method == "holm":
        raw = F.col(p) * (F.col("_m") - F.col("below"))
        v = od.running(v, keys, raw, "_adj", F.max, F.greatest, "_f")
    else:
        raw = F.col(p) * F.col("_m") / (F.col("below") + F.col("total")) * (harmonic(F.col("_m")) if method == "by" else F.lit(1.0))
        v = od.running(v, keys, raw, "_adj", F.min, F.least, "_f", reverse=True)
    j = df.join(v.select(*keys, p, "_adj"), [*keys, p], "left")
    return j.select(*df.columns, F.when(F.col("_adj").isNotNull(), F.least(F.lit(1.0), F.col("_adj"))).alias(out))


def choose_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """The test that fits the data, from group sizes and normality; one row."""
    s = shapiro(df, group, value).filter("reason is null")
    n = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    g = n.join(s.select(group, "p_value"), group, "left").agg(
        F.count(F.lit(1)).alias("groups"), F.min("size").alias("smallest"), F.min(F.coalesce(F.col("p_value") > 0.05, F.lit(False))).alias("normal")
    )
    param = F.col("normal") & (F.col("smallest") >= 10)
    test = F.when(F.col("groups") == 2, F.when(param, "welch_t").otherwise("mann_whitney")).when(F.col("groups") > 2, F.when(F.col("normal"), "anova").otherwise("kruskal"))
    return g.withColumn("test", test).withColumn("warning", F.when(F.col("smallest") < 5, "fewer than 5 values in a group"))


def pairwise(df: DataFrame, group: str, value: str, method: str = "bh") -> DataFrame:
    """Test chosen per pair by normality and size, effect size, adjusted p, and the omnibus eta squared."""
    mom = moments(df, [], group, value)
    norm = shapiro(df, group, value).filter("reason is null").select(F.col(group).alias("g"), (F.col("p_value") > 0.05).alias("ok"))
    t = with_p(welch(mom, group)).select("g1", "g2", "n_1", "n_2", "t_stat", F.col("p_value").alias("p_t"))
    mw = rank_effects(mann_whitney(df, group, value)).select("g1", "g2", "z", "rank_biserial")
    eff = mean_effects(mom, group).select("g1", "g2", "hedges_g")
    j = t.join(mw, ["g1", "g2"]).join(eff, ["g1", "g2"])
    j = j.join(norm.select(F.col("g").alias("g1"), F.col("ok").alias("ok1")), "g1", "left").join(norm.select(F.col("g").alias("g2"), F.col("ok").alias("ok2")), "g2", "left")
    param = F.coalesce(F.col("ok1") & F.col("ok2"), F.lit(False)) & (F.least("n_1", "n_2") >= 10)
    j = j.withColumn("test", F.when(param, "welch_t").otherwise("mann_whitney"))
    j = j.withColumn("p_value", F.when(param, F.col("p_t")).otherwise(F.least(F.lit(1.0), tails.normal_two_sided(F.col("z")))))
    j = j.withColumn("effect", F.when(param, F.col("hedges_g")).otherwise(F.col("rank_biserial"))).select("g1", "g2", "test", "p_value", "effect")
    return adjust(j, "p_value", method).crossJoin(F.broadcast(anova(mom).select("eta2")))  # one row


def against_control(df: DataFrame, group: str, value: str, control: str, alpha: float = 0.05) -> DataFrame:
    """X11: pooled t of every group against the control, with the overall ANOVA."""
    mom = moments(df, [], group, value)
    c = mom.filter(F.col(group) == control).select(F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("var").alias("var0"))
    j = mom.filter(F.col(group) != control).crossJoin(F.broadcast(c))  # one row
    sp = ((F.col("n") - 1) * F.col("var") + (F.col("n0") - 1) * F.col("var0")) / (F.col("n") + F.col("n0") - 2)
    j = j.withColumn("t_stat", (F.col("mean") - F.col("mean0")) / F.sqrt(sp * (1 / F.col("n") + 1 / F.col("n0")))).withColumn("df", F.col("n") + F.col("n0") - 2)
    a = anova(mom).select("f_stat", "df1", "df2")
    return j.crossJoin(F.broadcast(a)).select(group, "n", "mean", "t_stat", "df", "f_stat", "df1", "df2")


def control_decision(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    t = with_p(tests).withColumn("anova_p", tails.f_upper(F.col("f_stat"), F.col("df1"), F.col("df2")))
    return t.withColumn("significant", F.when(F.col("p_value") < alpha, "Yes").otherwise("No"))


def tost(mom: DataFrame, group: str, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """The two one-sided t statistics of a Welch comparison against an equivalence interval."""
    w = welch(mom, group, keys)
    se = F.sqrt(F.col("var_1") / F.col("n_1") + F.col("var_2") / F.col("n_2"))
    d = F.col("mean_1") - F.col("mean_2")
    return w.withColumn("t_low", (d - low) / se).withColumn("t_high", (d - high) / se)


def tost_p(tests: DataFrame) -> DataFrame:
    hi = tails.t_upper(F.col("t_low"), F.col("df"))
    lo = 1 - tails.t_upper(F.col("t_high"), F.col("df"))
    return tests.withColumn("p_value", F.greatest(hi, lo)).withColumn("equivalent", F.col("p_value") < 0.05)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency of two labels; one row.  Rows without one of the labels don't count.

    Only cells that occur are formed: an empty cell adds its expected count, and all expected counts add up to the total.
    """
    n = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra, rb = n.groupBy(a).agg(F.sum("o").alias("ra")), n.groupBy(b).agg(F.sum("o").alias("rb"))
    tot = n.agg(F.sum("o").alias("t"))
    cells = n.join(ra, a).join(rb, b).crossJoin(F.broadcast(tot))  # one row
    e = F.col("ra") * F.col("rb") / F.col("t")
    chi2 = F.sum(F.pow(F.col("o") - e, 2) / e - e) + F.first("t")
    return cells.agg(chi2.alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"), F.coalesce(F.sum("o"), F.lit(0)).alias("n"))


def wasserstein(df: DataFrame, group: str, features: Sequence[str], first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """First Wasserstein distance per feature between two groups, in units of the pooled standard deviation."""
    keys = list(keys)
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("m")
    long = df.filter(F.col(group).isin(first, second)).select(*keys, group, m).select(*keys, group, "m.*").filter("v is not null")
    on = [*keys, "feature"]
    isa = F.col(group) == first
    sizes = long.groupBy(*on).agg(F.count(F.when(isa, 1)).alias("na"), F.count(F.when(~isa, 1)).alias("nb"), F.stddev_pop("v").alias("sd"))
    vals = long.groupBy(*on, "v").agg(F.count(F.when(isa, 1)).alias("ca"), F.count(F.when(~isa, 1)).alias("cb"))
    vals = frame_index(vals.join(sizes, on), on, ["v"])
    gap = running_sum(vals, on, F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"), "gap")
    nxt = windowed(gap, on, lambda w: {"dx": F.lead("v").over(w) - F.col("v")}, before=0, after=1)
    return nxt.groupBy(*on).agg(F.sum(F.abs("gap") * F.col("dx") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("w1"))


def qq_points(df: DataFrame, group: str, value: str) -> DataFrame:
    """Ordered values with plotting positions; ``normal_scores`` adds the quantiles."""
    f = frame_index(df.filter(F.col(value).isNotNull()).select(group, value), [group], [value])
    f = attach(f, [group], n=F.count(F.lit(1)))
    return f.select(group, "frame", value, ((F.col("frame") + 0.5) / F.col("n")).alias("prob"))


def normal_scores(points: DataFrame) -> DataFrame:
    return points.withColumn("score", tails.normal_quantile(F.col("prob")))


# ---- linear mixed model with a random intercept ---------------------------------------------------------------------------
def mixed_model(df: DataFrame, group: str, value: str, batch: str, reference: str, keys: Sequence[str] = (), rounds: int = 3) -> DataFrame:
    """Value ~ group, random intercept per batch, for every group against ``reference``.

    A batch enters only through six sums, and for a given variance ratio the fixed effects have a closed form, so the
    restricted likelihood is evaluated on a grid of ratios that is refined around the best one.
    """
    keys = [*keys, "contrast"]
    names = df.filter(F.col(group) != reference).select(F.col(group).alias("contrast")).distinct()
    # the reference rows belong to every contrast: one copy per group, collapsed to batch sums first
    base = df.groupBy(*keys[:-1], batch, group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    own = base.filter(F.col(group) != reference).withColumn("contrast", F.col(group))
    ref = base.filter(F.col(group) == reference).join(F.broadcast(names))  # one row per group
    both = own.unionByName(ref)
    x = F.col(group) != reference
    per = both.groupBy(*keys, batch).agg(
        F.sum("n").alias("n"), F.sum(F.when(x, F.col("n")).otherwise(0)).alias("m"), F.sum("s").alias("sy"), F.sum(F.when(x, F.col("s")).otherwise(0.0)).alias("sxy"), F.sum("q").alias("q")
    )
    grid = F.array(*[F.lit(0.0)], *[F.lit(10 ** (-4 + 6 * i / 39)) for i in range(40)])
    cand = per.withColumn("lam", F.explode(grid))
    best = _reml(cand, keys)
    for i in range(rounds):
        width = 0.4 / 8**i
        around = best.select(*keys, F.col("lam").alias("_l"))
        mult = F.array(*[F.lit(10 ** (width * (j - 8) / 8)) for j in range(17)])
        best = _reml(per.join(around, keys).withColumn("lam", F.explode(F.transform(mult, lambda f: f * F.col("_l")))).drop("_l").dropDuplicates([*keys, batch, "lam"]), keys)
    return best


def _reml(cand: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col("lam") / (1 + F.col("n") * F.col("lam"))
    n, m, sy, sxy = F.col("n"), F.col("m"), F.col("sy"), F.col("sxy")
    g = cand.groupBy(*keys, "lam").agg(
        F.sum("n").alias("nn"), F.count(F.lit(1)).alias("batches"), F.sum(n - c * n * n).alias("a"), F.sum(m - c * n * m).alias("b"), F.sum(m - c * m * m).alias("d"),
        F.sum(sy - c * n * sy).alias("e"), F.sum(sxy - c * m * sy).alias("f"), F.sum(F.col("q") - c * sy * sy).alias("h"), F.sum(F.ln(1 + n * F.col("lam"))).alias("ld"),
    )
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    b0, b1 = F.expr("(d * e - b * f)") / det, F.expr("(a * f - b * e)") / det
    g = g.withColumn("det", det).filter("det > 0").withColumn("intercept", b0).withColumn("beta", b1)
    g = g.withColumn("rss", F.expr("h - intercept * e - beta * f")).withColumn("dof", F.col("nn") - 2).filter("dof > 0")
    g = g.withColumn("sigma2", F.col("rss") / F.col("dof"))
    g = g.withColumn("dev", F.expr("dof * ln(sigma2) + ld + ln(det) + dof * (1 + ln(2 * pi()))"))
    rest = [x for x in ("lam", "nn", "batches", "intercept", "beta", "sigma2", "det", "a", "dev")]
    w = g.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("dev", "lam")).alias("w")).select(*keys, "w.*")
    se = F.sqrt(F.col("sigma2") * F.col("a") / F.col("det"))
    return w.select(
        *keys, F.col("nn").alias("n"), "batches", "lam", "intercept", "beta", se.alias("se"), (F.col("beta") / se).alias("z"), (F.col("beta") - 1.96 * se).alias("lo"), (F.col("beta") + 1.96 * se).alias("hi"),
        "sigma2", (F.col("beta") / F.sqrt(F.col("sigma2") * (1 + F.col("lam"))) * (1 - 3 / (4 * F.col("nn") - 9))).alias("hedges_g"), F.col("dev"), (F.col("dev") + 8).alias("aic"), (F.col("dev") + 4 * F.ln("nn")).alias("bic"),
    )


def multi_parameter(df: DataFrame, params: Sequence[str], group: str, batch: str, reference: str) -> DataFrame:
    """A mixed model per parameter and group, with false-discovery control and volcano columns."""
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("double").alias("v")) for c in params])).alias("m")
    long = df.select(group, batch, m).select(group, batch, "m.*").filter("v is not null")
    r = mixed_model(long, group, "v", batch, reference, ["param"]).withColumn("p_value", tails.normal_two_sided(F.col("z")))
    r = adjust(r, "p_value", "bh", out="q_value")
    fold = F.log2(F.when((F.col("intercept") + F.col("beta")) / F.col("intercept") > 0, (F.col("intercept") + F.col("beta")) / F.col("intercept")))
    return r.withColumn("log2_fold", fold).withColumn("neg_log10_p", -F.log10("p_value")).withColumn("neg_log10_q", -F.log10("q_value"))


# ---- posterior tables -----------------------------------------------------------------------------------------------------
def r_hat(draws: DataFrame, param: str, chain: str, value: str) -> DataFrame:
    """Potential scale reduction from chain moments, with the usual gate."""
    c = draws.groupBy(param, chain).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    g = c.groupBy(param).agg(F.avg("n").alias("n"), F.var_samp("m").alias("bn"), F.avg("v").alias("w"), F.sum("n").alias("draws"))
    rh = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("bn")) / F.col("w"))
    return g.select(param, "draws", rh.alias("r_hat"), ((rh <= 1.01) & (F.col("draws") >= 400)).alias("pass"))


def predictive_summary(draws: DataFrame, point: Sequence[str], value: str, observed: DataFrame, y: str) -> DataFrame:
    """Error of predictive means and coverage of the 95 % interval; one row."""
    q = quantiles(draws, list(point), value, [0.025, 0.975])
    m = draws.groupBy(*point).agg(F.avg(value).alias("mean"))
    j = m.join(q, list(point)).join(observed, list(point))
    r = F.col("mean") - F.col(y)
    inside = (F.col(y) >= F.col("q")[0]) & (F.col(y) <= F.col("q")[1])
    return j.agg(F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.avg(inside.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("points"))


def waic(loglik: DataFrame, point: Sequence[str], ll: str) -> DataFrame:
    """Expected log density, effective parameters and standard error from pointwise log-likelihood draws."""
    d = attach(loglik, list(point), _top=F.max(ll))
    p = d.groupBy(*point).agg((F.max("_top") + F.ln(F.avg(F.exp(F.col(ll) - F.col("_top"))))).alias("lppd"), F.var_samp(ll).alias("p"))
    e = F.col("lppd") - F.coalesce("p", F.lit(0.0))
    return p.agg(F.sum(e).alias("elpd"), F.sum("p").alias("p_waic"), F.sqrt(F.count(F.lit(1)) * F.var_samp(e)).alias("se"), (-2 * F.sum(e)).alias("waic"))
