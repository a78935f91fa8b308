"""Group summaries and comparisons of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rekurve.operators.ordered import quantiles


def summarize(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """A1: one row per group and metric."""
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])).alias("m")
    long = df.select(*by, m).select(*by, "m.*")
    q = quantiles(long, [*by, "metric"], "value", [0.25, 0.5, 0.75])
    g = long.groupBy(*by, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem")
    )
    return g.join(q, [*by, "metric"]).select(*by, "metric", "n", "mean", "sd", "sem", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def regime(k: Column, diffusion: float = 1.0, binding: float = 0.1) -> Column:
    return F.when(k > diffusion, "diffusion").when(k < binding, "binding").otherwise("intermediate")


def weighted_kinetics(df: DataFrame, by: list[str]) -> DataFrame:
    """A3: abundance-weighted rates.  Needs ``model, mobile_fraction`` and what the model has of ``rate_constant``,
    ``k_fast, k_medium, k_slow``, ``prop_fast, prop_medium, prop_slow`` (0-1 or 0-100) and ``amp_fast, amp_slow``."""
    have = set(df.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
    share = lambda n: F.when(c(n) > 1.0, c(n) / 100.0).otherwise(c(n))
    total = F.coalesce(c("amp_fast"), F.lit(0.0)) + F.coalesce(c("amp_slow"), F.lit(0.0))
    none = (F.col("model") == "double") & c("prop_fast").isNull() & c("prop_slow").isNull() & (total > 0)
    single = F.col("model") == "single"
    pf = F.when(single, F.lit(1.0)).when(none, c("amp_fast") / total).otherwise(share("prop_fast"))
    ps = F.when(single, F.lit(None)).when(none, c("amp_slow") / total).otherwise(share("prop_slow"))
    pm = F.when(F.col("model") == "triple", share("prop_medium"))
    kf = F.when(single, F.coalesce(c("rate_constant"), c("k_fast"))).otherwise(c("k_fast"))
    part = lambda k, w, side: F.struct(k.cast("double").alias("k"), w.cast("double").alias("w"), side.alias("side"))
    mid = F.when(c("k_medium") > 0.3, "fast").otherwise("slow")
    comp = F.array(part(kf, pf, F.lit("fast")), part(c("k_medium"), pm, mid), part(c("k_slow"), ps, F.lit("slow")))
    long = df.select(*by, F.explode(comp).alias("c")).select(*by, "c.*").filter("k is not null and w is not null")
    long = long.withColumn("regime", regime(F.col("k")))
    on = lambda s: F.col("side") == s
    aggs = []
    for s in ("fast", "slow"):
        k = F.when(on(s), F.col("k"))
        aggs += [(F.sum(F.when(on(s), F.col("k") * F.col("w"))) / F.sum(F.when(on(s), F.col("w")))).alias(f"weighted_k_{s}"), (F.stddev_pop(k) / F.sqrt(F.count(k))).alias(f"weighted_k_{s}_sem")]
    for r in ("diffusion", "binding", "intermediate"):
        aggs.append((100 * F.sum(F.when(F.col("regime") == r, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"population_{r}"))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("mobile_fraction").alias("mobile_mean"),
        (F.stddev_samp("mobile_fraction") / F.sqrt(F.count("mobile_fraction"))).alias("mobile_sem"), F.stddev_samp("mobile_fraction").alias("mobile_sd"),
        F.count("mobile_fraction").alias("mobile_n"),
    )
    return base.join(long.groupBy(*by).agg(*aggs), by, "left")


def pairs(summary: DataFrame, group: str, on: Sequence[str] = ()) -> DataFrame:
    """All ordered pairs of group rows (one row per group, so the product is of summaries, never of data)."""
    rest = [c for c in summary.columns if c != group and c not in on]
    a = summary.select(*on, F.col(group).alias("g1"), *[F.col(c).alias(f"{c}_1") for c in rest])
    z = summary.select(*on, F.col(group).alias("g2"), *[F.col(c).alias(f"{c}_2") for c in rest])
    return a.join(z, list(on)).filter("g1 < g2") if on else a.join(z, F.col("g1") < F.col("g2"))


def compare_kinetics(weighted: DataFrame, group: str = "grp") -> DataFrame:
    """A5: pooled t, Cohen d, population shifts and fold changes for every pair of groups."""
    p = pairs(weighted, group)
    n1, n2, s1, s2 = F.col("mobile_n_1"), F.col("mobile_n_2"), F.col("mobile_sd_1"), F.col("mobile_sd_2")
    sp2 = ((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)
    diff = F.col("mobile_mean_1") - F.col("mobile_mean_2")
    return p.select(
        "g1", "g2", F.try_divide(diff, F.sqrt(sp2 * (1 / n1 + 1 / n2))).alias("t_stat"), (n1 + n2 - 2).alias("df"),
        F.try_divide(diff, F.sqrt((s1 * s1 + s2 * s2) / 2)).alias("cohen_d"), (F.col("population_diffusion_2") - F.col("population_diffusion_1")).alias("diffusion_shift"),
        (F.col("population_binding_2") - F.col("population_binding_1")).alias("binding_shift"), F.try_divide("weighted_k_fast_2", "weighted_k_fast_1").alias("k_fast_fold"),
        F.try_divide("weighted_k_slow_2", "weighted_k_slow_1").alias("k_slow_fold"),
    )


def pool_groups(df: DataFrame, group: str, members: list[str], name: str) -> DataFrame:
    """Relabel several groups as one."""
    return df.withColumn(group, F.when(F.col(group).isin(members), F.lit(name)).otherwise(F.col(group)))


def composition(df: DataFrame, group: str, cluster: str) -> DataFrame:
    """Count and share of each cluster in its group."""
    g = df.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def contingency(df: DataFrame, group: str, cluster: str, values: list) -> DataFrame:
    """Group by cluster counts, zero filled."""
    return df.groupBy(group).pivot(cluster, values).count().fillna(0)


def fold_change(long: DataFrame, param: str, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Parameters both groups have, with fold, percent change and difference."""
    p = pairs(long.select(*keys, param, group, value), group, [*keys, param])
    a, z = F.col(f"{value}_1"), F.col(f"{value}_2")
    return p.select(*keys, param, "g1", "g2", F.try_divide(z, a).alias("fold"), (F.try_divide(z, a) * 100 - 100).alias("percent"), (z - a).alias("difference"))


def similar(lib: DataFrame, tolerance: float, **targets: float) -> DataFrame:
    """Library rows within the relative tolerance of every given target, ascending by diffusion coefficient."""
    out = lib
    for c, v in targets.items():
        out = out.filter(F.col(c).between(v * (1 - tolerance), v * (1 + tolerance)))
    return out


def similar_join(items: DataFrame, lib: DataFrame, key: str, cols: dict[str, str], tolerance: float, width: float = 0.1) -> DataFrame:
    """Every item with the library rows inside its tolerance box.

    The first column is cut into logarithmic buckets of ``width`` and the items are copied into each bucket their
    range touches, which turns the range join into an equi-join with a residual filter.  Zeros, which match zeros alone,
    have a bucket of their own.
    """
    if not 0 <= tolerance < 1:
        raise ValueError("the tolerance must be at least 0 and below 1")
    first_item, first_lib = next(iter(cols.items()))
    zero = F.lit(-(10**9)).cast("long")
    bucket = lambda c: F.floor(F.ln(c) / F.lit(width)).cast("long")
    lo, hi = F.col(first_item) * (1 - tolerance), F.col(first_item) * (1 + tolerance)
    touched = F.when(F.col(first_item) > 0, F.sequence(bucket(lo) - 1, bucket(hi) + 1)).when(F.col(first_item) == 0, F.array(zero))
    spread = items.withColumn("_b", F.explode(touched))
    keyed = lib.withColumn("_b", F.when(F.col(first_lib) > 0, bucket(F.col(first_lib))).when(F.col(first_lib) == 0, zero)).filter("_b is not null")
    j = spread.join(keyed, "_b").drop("_b")
    for i, r in cols.items():
        j = j.filter(F.col(r).between(F.col(i) * (1 - tolerance), F.col(i) * (1 + tolerance)))
    return j


def reference_ranges(lib: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """A8."""
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in cols])).alias("m")
    long = lib.select(by, m).select(by, "m.*")
    q = quantiles(long, [by, "metric"], "value", [0.25, 0.5, 0.75])
    g = long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    return g.join(q, [by, "metric"]).select(by, "metric", "n", "mean", "sd", "lo", "hi", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def suggestions(lib: DataFrame, diff_coef: float, mobile: float, n: int = 5, tolerance: float = 0.4) -> DataFrame:
    """Closest library rows with the reasons why."""
    s = similar(lib, tolerance, diff_coef=diff_coef, mobile=mobile).orderBy("diff_coef", "ref_id").limit(n)
    close_d = F.abs(F.col("diff_coef") - diff_coef) / diff_coef < 0.2
    close_m = F.abs(F.col("mobile") - mobile) < 10
    why = F.concat_ws(" ", F.concat(F.lit("Similar mobility parameters in "), "compartment"), F.when(close_d, "(D_eff within 20%)"), F.when(close_m, "(Mf within 10%)"))
    return s.select("ref_id", "name", "cls", "compartment", "diff_coef", "mobile", why.alias("rationale"))


def spot_scaling(df: DataFrame, model: str, width: str, half: str, aic: str) -> DataFrame:
    """scaling of half-time with spot area per model and the model with the smallest total AIC."""
    g = df.groupBy(model).agg(F.regr_slope(F.col(half), F.col(width) * F.col(width)).alias("slope"), F.regr_r2(F.col(half), F.col(width) * F.col(width)).alias("r2"), F.sum(aic).alias("aic"))
    best = g.agg(F.min(F.struct("aic", model)).alias("b")).select(F.col(f"b.{model}").alias("best_model"))
    return g.crossJoin(F.broadcast(best))
